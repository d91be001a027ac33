from datetime import date

import pytest

from cohortlake.operators.cohort import demographics, impute_covariates, patient_facts
from cohortlake.operators.events import index_window_join, severity_outcome_drugs
from cohortlake.session import cut_lineage
from cohortlake.sources import read_table, write_bucketed, write_table

MILD = "Mild_No_ED_or_Hosp_around_COVID_index"
EXPOSURE = (
    "person_id string, condition_concept_id int, condition_source_concept_id int, condition_source_value string, "
    "specific_condition_name string, condition_start_date date, condition_end_date date, data_partner_id int"
)
FACTS = (
    "person_id string, idx date, age_at_covid string, race string, sex string, severity_type string, "
    "data_partner_id int, number_of_visits_post_covid string"
)


@pytest.fixture(scope="module")
def exposure(spark):
    return spark.createDataFrame([("a", 5, None, "t", "name", date(2020, 1, 1), None, 3)], EXPOSURE)


@pytest.fixture(scope="module")
def facts(spark):
    day = date(2020, 5, 1)
    return spark.createDataFrame(
        [
            ("a", day, "40", "White", "MALE", MILD, 1, "7"),
            ("b", day, "x", "Other", "No matching concept", None, 1, "many"),
            ("c", day, "50", None, "FEMALE", MILD, 1, None),
            ("d", None, "60", "White", "MALE", MILD, 1, "1"),
            ("e", date(2017, 12, 31), "60", "White", "MALE", MILD, 1, "1"),
        ],
        FACTS,
    )


def test_facts_and_covariates(spark, facts, exposure):
    out = patient_facts(facts, exposure, index_date="idx")
    rows = {r.person_id: r for r in out.collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].has_lsd, rows["a"].lsd_data_partner_id, rows["a"].number_of_visits_post_covid) == (1, 3, 7)
    assert (rows["b"].has_lsd, rows["b"].Age, rows["b"].Sex, rows["b"].number_of_visits_post_covid) == (0, None, None, None)
    clean = {r.person_id: (r.Age, r.Race, r.Sex) for r in impute_covariates(out).collect()}
    assert clean == {
        "a": (40.0, "White", "MALE"), "b": (45.0, "Other/Unknown", "Unknown"), "c": (50.0, "Other/Unknown", "FEMALE")
    }


def test_age_is_completed_at_the_date(spark):
    rows = [("a", 3, 2000), ("b", 7, 2000), ("c", None, 2000), ("d", 1, None)]
    person = spark.createDataFrame(
        [(p, 1, "r", 2, "g", m, y) for p, m, y in rows],
        "person_id string, race_concept_id int, race_concept_name string, gender_concept_id int, "
        "gender_concept_name string, month_of_birth int, year_of_birth int",
    )
    ids = spark.createDataFrame([(p,) for p in "abcde"], "person_id string")
    ages = {r.person_id: r.Age for r in demographics(ids, person, "2020-06-15").collect()}
    assert ages == {"a": 20, "b": 19, "c": 20, "d": None, "e": None}


def test_window_is_inclusive_and_bounds_do_not_change_it(spark):
    events = spark.createDataFrame(
        [("a", date(2020, 4, 30)), ("a", date(2020, 5, 1)), ("a", date(2020, 5, 31)), ("a", date(2020, 6, 1)), ("a", None)],
        "person_id string, d date",
    )
    cohort = spark.createDataFrame([("a", date(2020, 5, 1), "m")], "person_id string, idx date, severity_type string")
    plain = index_window_join(events, cohort, "d", "idx")
    assert sorted(r.days_diff for r in plain.collect()) == [0, 30]
    bounded = index_window_join(events, cohort, "d", "idx", index_range=("2020-05-01", "2020-05-01"))
    assert bounded.exceptAll(plain).isEmpty() and plain.exceptAll(bounded).isEmpty()


def test_outcomes_are_complete_cases(spark, facts):
    drugs = spark.createDataFrame(
        [(p, 1, "drug", date(2020, 5, 3)) for p in "abcd"] + [("a", 2, "no", date(2020, 5, 3)), ("a", 1, "drug", None)],
        "person_id string, drug_concept_id int, drug_concept_name string, drug_exposure_end_date date",
    )
    members = spark.createDataFrame([(1,), (1,)], "concept_id int")
    rows = severity_outcome_drugs(drugs, facts, members, "idx").collect()
    assert [(r.person_id, r.days_diff, r.Binary_Severity, r.age_at_covid) for r in rows] == [("a", 2, 0, 40)] * 2
    assert severity_outcome_drugs(drugs, facts, members, "idx", dedupe=True).count() == 1


def test_tables_in_and_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "Maps to")], "concept_id_1 int, concept_id_2 int, relationship_id string")
    write_table(df, str(tmp_path), "concept_relationship")
    assert read_table(spark, str(tmp_path), "concept_relationship").collect() == df.collect()
    write_table(df.drop("concept_id_2"), str(tmp_path), "concept_relationship")
    with pytest.raises(ValueError, match="concept_id_2"):
        read_table(spark, str(tmp_path), "concept_relationship")


def test_cut_lineage_keeps_rows_on_disk(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    assert spark.sparkContext.getCheckpointDir() is not None


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        events = spark.range(1000).selectExpr("cast(id % 50 as string) as person_id", "id as event")
        persons = spark.range(50).selectExpr("cast(id as string) as person_id", "id as age")
        left = write_bucketed(events, str(tmp_path), "bucketed_events", buckets=4)
        right = write_bucketed(persons, str(tmp_path), "bucketed_persons", buckets=4)
        joined = left.join(right, "person_id").groupBy("person_id").count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.conf.set(key, before)
        spark.sql("drop table if exists bucketed_events")
        spark.sql("drop table if exists bucketed_persons")


def test_partitions_follow_the_shuffle_size(spark):
    from cohortlake.session import tune

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    tune(spark, shuffle_bytes=10 * 1024**3)
    assert spark.conf.get(key) == "80"
    spark.conf.set(key, before)


def test_cells_that_do_not_fit_are_listed(spark):
    from cohortlake.sources.typed import rejected_cells, typed

    rows = [(1, "12.7", "2020-01-31", 5), (2, "", "soon", 6), (3, None, None, None), (2, "1e3", "2020-02-30", 6), (4, "1e12", None, 7)]
    df = spark.createDataFrame(rows, "k int, visits string, day string, extra int")
    types = {"VISITS": "int", "day": "date", "extra": "int", "absent": "float"}
    out = typed(df, types)
    assert dict(out.dtypes) == {"k": "int", "visits": "int", "day": "date", "extra": "int"}
    assert [r.visits for r in out.collect()] == [12, None, None, 1000, None]
    lost = sorted(tuple(r) for r in rejected_cells(df, types, ["k"]).collect())
    assert lost == [
        (2, "day", "2020-02-30", "date"), (2, "day", "soon", "date"), (2, "visits", "", "int"), (4, "visits", "1e12", "int")
    ]
    assert rejected_cells(df, {"extra": "int"}, ["k"]).count() == 0 and rejected_cells(df.limit(0), types, ["k"]).count() == 0
    with pytest.raises(ValueError, match="no cast to bytes"):
        typed(df, {"k": "bytes"})
