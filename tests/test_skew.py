"""A person, text or key that holds a large share of all rows."""

import pytest
from pyspark.sql import functions as F

from cohortlake.operators.code_mapping import resolve_condition_codes, resolve_condition_codes_wide, source_codes
from cohortlake.operators.events import index_window_join, survival_table
from cohortlake.operators.joins import frequent_keys, left_lookup
from cohortlake.operators.regression import min_group_size


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which test data counts as large; restored afterwards."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot_events(spark):
    """One person in a hundred has two thirds of the rows."""
    return spark.range(0, 300_000, 1, 12).select(
        F.when(F.col("id") % 3 < 2, "p0").otherwise(F.concat(F.lit("p"), F.col("id") % 100)).alias("person_id"),
        F.concat(F.lit("drug "), F.col("id") % 5).alias("drug"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("d"),
    )


@pytest.fixture(scope="module")
def persons(spark):
    return spark.range(100).select(
        F.concat(F.lit("p"), F.col("id")).alias("person_id"),
        F.lit("2020-01-11").cast("date").alias("idx"),
        F.lit("m").alias("severity_type"),
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_person_is_split_in_the_window_join(spark, small_partitions, hot_events, persons):
    joined = index_window_join(hot_events, persons, "d", "idx")
    assert "skew=true" in final_plan(joined)
    # the days 10 to 40 of every 90
    assert joined.count() == hot_events.filter("day(d) is not null and datediff(d, date'2020-01-11') between 0 and 30").count()


def test_hot_person_stays_split_before_an_aggregate(spark, small_partitions, hot_events, persons):
    deaths = persons.select("person_id", F.lit("2020-06-01").cast("date").alias("death_date"))
    rows = survival_table(index_window_join(hot_events, persons, "d", "idx"), deaths, ("drug",), "d", "2020-12-31")
    assert "skew=true" in final_plan(rows)
    assert rows.filter("person_id = 'p0'").count() == 5


def test_group_sizes_need_no_window(spark, hot_events):
    kept = min_group_size(hot_events, "person_id", 1000)
    assert "Window" not in final_plan(kept)
    assert kept.select("person_id").distinct().count() == 1


@pytest.fixture(scope="module")
def hot_conditions(spark):
    """Half of all rows have concept id 0 and one text, a sixth no id, the others one of 1,000 ids."""
    id0, no_id = F.col("id") % 2 == 0, F.col("id") % 6 == 1
    key = F.when(id0, 0).when(~no_id, 1 + F.col("id") % 1000).cast("int")
    return spark.range(0, 120_000, 1, 12).select(
        F.col("id").cast("string").alias("person_id"),
        F.lit(1).alias("condition_concept_id"),
        F.lit("c").alias("condition_concept_name"),
        F.lit("2020-01-01").cast("date").alias("condition_start_date"),
        F.lit(None).cast("date").alias("condition_end_date"),
        F.when(id0, "E10").when(no_id, None).otherwise(F.concat(F.lit("ICD9CM:"), key)).alias("condition_source_value"),
        key.alias("condition_source_concept_id"),
        F.lit(1).alias("data_partner_id"),
    )


@pytest.fixture(scope="module")
def some_codes(spark):
    rows = [(0, "none", "ICD10CM", "Z0"), (1, "one", "ICD10CM", "E11"), (2, "two", "ICD10CM", "E10"), (2, "two", "ICD10CM", "E10")]
    return spark.createDataFrame(rows, "icd_concept_id int, icd_concept_name string, vocabulary_id string, concept_code string")


def test_frequent_keys_are_few_and_found(spark, hot_conditions):
    ids, pairs, persons = frequent_keys(
        hot_conditions,
        ["condition_source_concept_id"],
        ["condition_source_concept_id", "condition_source_value"],
        ["person_id"],
        parts=8,
    )
    # id 0 and NULL; the salts follow the shares of the rows
    assert sorted(ids.values()) == [6, 16] and sorted(pairs.values()) == [6, 16] and persons == {}
    assert frequent_keys(hot_conditions.limit(0), ["person_id"]) == [{}]


def test_key_with_half_of_the_rows_uses_every_reducer(spark, small_partitions, hot_conditions, some_codes):
    key = "condition_source_concept_id"
    (hot,) = frequent_keys(hot_conditions, [key])
    lookup = some_codes.filter("icd_concept_id < 2").select(F.col("icd_concept_id").alias(key), "concept_code")
    before = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        plain = left_lookup(hot_conditions, lookup, key, ["person_id"])
        spread = left_lookup(hot_conditions, lookup, key, ["person_id"], hot)
        tasks = [df.filter("concept_code = 'Z0'").select(F.spark_partition_id().alias("p")).groupBy("p").count() for df in (plain, spread)]
        plain_sizes, spread_sizes = [[row["count"] for row in task.collect()] for task in tasks]
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", before)
    assert plain_sizes == [60_000]
    assert sum(spread_sizes) == 60_000 and len(spread_sizes) == 8 and max(spread_sizes) < 20_000
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0


def test_codes_of_hot_pairs_equal_those_without_salts(spark, hot_conditions, some_codes):
    codes = source_codes(hot_conditions, some_codes)
    assert len(codes.hot) == 2
    strict = resolve_condition_codes(hot_conditions, some_codes, codes=codes).groupBy("combined_concept_code").count()
    # every row of id 2 meets two equal rows of the map
    assert {row[0]: row[1] for row in strict.collect()} == {"Z0": 60_000, "E10": 160}
    loose = resolve_condition_codes(hot_conditions, some_codes, keep_unmapped=True).groupBy("combined_concept_code").count()
    counts = {row[0]: row[1] for row in loose.collect()}
    # the texts give the other ids a code; without id and text there is none
    assert sum(counts.values()) == 100_000 + 80 and counts["E10"] == 160


def test_wide_joins_condition_rows_with_the_pairs_once(spark, small_partitions, hot_conditions, some_codes):
    cohort = hot_conditions.select("person_id", F.lit(1).alias("has_lsd"))
    wide = resolve_condition_codes_wide(cohort, hot_conditions, some_codes)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    # rows join persons and pairs; four lookups are made for the pairs
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 6
    assert sum("_salt" in line for line in joins) == 1
    # NULL finds NULL: a pair without id and text is kept, without a code
    assert wide.filter("condition_source_value is null").count() == 20_000
    assert wide.filter("condition_source_value is null and combined_concept_code is not null").count() == 0
    # the 80 rows of id 2 meet two rows of the map by id, and two again by code
    assert wide.count() == 120_000 + 3 * 80
