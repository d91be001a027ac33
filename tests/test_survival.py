import math

import pytest
from pyspark.sql import functions as F

from cohortlake.operators.events import death_summary, survival_table
from cohortlake.operators.survival import density_by_group, kaplan_meier, risk_table

# Published leukaemia trial, treated arm: (weeks, relapse).
TREATED_ARM = [
    (6, 1), (6, 1), (6, 1), (6, 0), (7, 1), (9, 0), (10, 1), (10, 0), (11, 0), (13, 1), (16, 1),
    (17, 0), (19, 0), (20, 0), (22, 1), (23, 1), (25, 0), (32, 0), (32, 0), (34, 0), (35, 0),
]
PUBLISHED = {6: 0.857, 7: 0.807, 10: 0.753, 13: 0.690, 16: 0.627, 22: 0.538, 23: 0.448}


@pytest.fixture(scope="module")
def trial(spark):
    return spark.createDataFrame([(d, s, "6-MP") for d, s in TREATED_ARM], "days int, status int, drug_name string")


def test_published_curve(trial):
    km = {int(r.time): r for r in kaplan_meier(trial, distinct_rows=False).collect()}
    for week, value in PUBLISHED.items():
        assert km[week].estimate == pytest.approx(value, abs=6e-4)
    assert km[6].n_risk == 21 and km[6].n_event == 3 and km[6].n_censor == 1
    assert km[35].n_risk == 1
    values = [km[week].estimate for week in sorted(km)]
    assert values == sorted(values, reverse=True)
    # bounds on the log scale
    row = km[10]
    assert row.conf_low == pytest.approx(row.estimate * math.exp(-1.959964 * row.std_error))


def test_distinct_rows_lower_the_risk_set(trial):
    km = {int(r.time): r for r in kaplan_meier(trial).collect()}
    assert km[6].n_risk == len(set(TREATED_ARM)) and km[6].n_event == 1


def test_last_death_ends_the_curve(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 0, "a"), (3, 1, "a")], "days int, status int, drug_name string")
    last = kaplan_meier(df, distinct_rows=False).filter("time = 3").first()
    assert last.estimate == 0.0 and math.isinf(last.std_error)
    assert last.conf_low is None and last.conf_high is None


def test_before_any_event(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], "days int, status int, drug_name string")
    rows = kaplan_meier(df, distinct_rows=False).collect()
    assert [(r.estimate, r.std_error, r.conf_low, r.conf_high) for r in rows] == [(1.0, 0.0, 1.0, 1.0)] * 2


def test_excluded_and_missing_strata(spark):
    rows = [(1, 1, "a"), (1, 1, "b"), (1, 1, None), (None, 1, "a")]
    df = spark.createDataFrame(rows, "days int, status int, drug_name string")
    assert [r.strata for r in kaplan_meier(df, exclude=("b",)).collect()] == ["a"]


@pytest.mark.parametrize("width", [1.0, 4.0, 7.5])
def test_ranges_change_nothing(spark, trial, width):
    """Cut into ranges, with times below 0 and a curve that ends, the curve is that of one window."""
    early = spark.createDataFrame([(-9, 1, "b"), (-3, 0, "b"), (2, 1, "b"), (5, 1, "b")], "days int, status int, drug_name string")
    rows = trial.unionByName(early)
    got = {(r.strata, r.time): r for r in kaplan_meier(rows, distinct_rows=False, range_width=width).collect()}
    want = {(r.strata, r.time): r for r in kaplan_meier(rows, distinct_rows=False, range_width=1e6).collect()}
    assert set(got) == set(want)
    for key, row in want.items():
        assert got[key][:4] == row[:4]
        assert got[key][4:8] == tuple(None if v is None else pytest.approx(v, rel=1e-12) for v in row[4:8])


def test_curve_over_a_million_times(spark):
    """One stratum of a million distinct times: no task sorts more than a range of them."""
    df = spark.range(1_000_000).select(
        F.col("id").alias("days"), (F.col("id") % 3 == 0).cast("int").alias("status"), F.lit("a").alias("drug_name")
    )
    km = kaplan_meier(df, distinct_rows=False).persist()
    log, want = 0.0, {}
    for t in range(1_000_000):
        if t % 3 == 0 and t < 999_999:
            log += math.log1p(-1 / (1_000_000 - t))
        if t % 99_991 == 0:
            want[t] = (1_000_000 - t, math.exp(log))
    got = {int(r.time): (r.n_risk, r.estimate) for r in km.filter(F.col("time").cast("long") % 99_991 == 0).collect()}
    assert {t: n for t, (n, _) in got.items()} == {t: n for t, (n, _) in want.items()}
    assert all(got[t][1] == pytest.approx(value, rel=1e-9) for t, (_, value) in want.items())
    assert km.count() == 1_000_000
    spread = km.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 500_000
    km.unpersist()


def test_risk_table(trial):
    km = kaplan_meier(trial, distinct_rows=False)
    rows = {r.display_time: (r.at_risk, r.events) for r in risk_table(km, (0, 10, 50)).collect()}
    assert rows == {0.0: (21, 0), 10.0: (15, 5), 50.0: (0, 9)}


def test_density_integrates_to_one(spark):
    df = spark.range(400).select((F.col("id") % 37).cast("int").alias("days_diff"), F.lit("x").alias("Binary_Severity"))
    rows = sorted(density_by_group(df, grid_n=200).collect(), key=lambda r: r.x)
    step = rows[1].x - rows[0].x
    assert 0.85 < sum(r.density for r in rows) * step < 1.0


DEATH = "person_id string, death_date date, cause_concept_id int, cause_concept_name string, "
DEATH += "death_type_concept_id int, data_partner_id int"


def test_death_lists_are_sorted_and_whole(spark):
    from datetime import date

    rows = [
        ("a", date(2020, 1, 5), 10, "z", 1, 1),
        ("a", date(2020, 1, 3), 9, "y", 1, 1),
        ("a", date(2020, 1, 3), 9, "y", 1, 1),
        ("a", None, 7, "x", 1, 1),
        ("b", date(2020, 1, 9), None, None, None, 2),
        ("c", date(2019, 12, 31), 1, "q", 1, 2),
    ]
    cohort = spark.createDataFrame(
        [(p, date(2020, 1, 1), "m") for p in "abc"], "person_id string, idx date, severity_type string"
    )
    out = {r.person_id: r for r in death_summary(spark.createDataFrame(rows, DEATH), cohort, "idx").collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].cause_concept_id == "9;9;10" and out["a"].cause_concept_name == "y;y;z"
    assert out["a"].death_date == date(2020, 1, 3) and out["a"].days_diff == 2
    # a list of nothing is empty text, not NULL
    assert out["b"].cause_concept_id == ""


def test_survival_rows(spark):
    from datetime import date

    exposures = spark.createDataFrame(
        [
            ("a", "x", date(2020, 1, 1)),
            ("a", "x", date(2020, 1, 4)),
            ("b", "x", date(2020, 1, 1)),
            ("c", "x", None),
            ("d", "x", date(2020, 3, 1)),
        ],
        "person_id string, drug string, ended date",
    )
    deaths = spark.createDataFrame(
        [("a", date(2020, 1, 10)), ("a", date(2020, 1, 10)), ("d", date(2020, 2, 1))],
        "person_id string, death_date date",
    )
    rows = survival_table(exposures, deaths, ("drug",), "ended", "2020-12-31").collect()
    assert {(r.person_id, r.days, r.status) for r in rows} == {("a", 6, 1), ("b", 365, 0)}


def test_density_of_many_distinct_values(spark):
    """One group of 200,000 distinct values, read as rows in many tasks, and a group without a name."""
    df = spark.range(200_000).select((F.col("id") / 1000).alias("days_diff"), F.lit("a").alias("Binary_Severity"))
    few = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "days_diff double, Binary_Severity string")
    rows = density_by_group(df.unionByName(few), grid_n=40).collect()
    a = sorted((r.x, r.density) for r in rows if r.group == "a")
    assert len(a) == 40 and a[20][1] == pytest.approx(1 / 200, rel=1e-3)
    n, values = 3, [1.0, 2.0, 4.0]
    mean = sum(values) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
    h = 0.9 * min(sd, 1.5 / 1.34) * n**-0.2
    for x, density in sorted((r.x, r.density) for r in rows if r.group is None):
        want = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert density == pytest.approx(want, abs=1e-12)
