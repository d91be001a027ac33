"""Physical plans: what must not be there at any size, and what must."""

import pytest

from cohortlake.operators.joins import left_lookup
from cohortlake.plans.queries import STUDY_QUERIES, all_queries, study


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(STUDY_QUERIES))
def test_no_product_and_no_row_python(spark, small_dir, name):
    plan = plan_of(all_queries()[name](spark, small_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_dates_reach_the_scan(spark, small_dir):
    plan = plan_of(study(spark, small_dir).cohort_procedures)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_shipdate" in line)
    assert "PushedFilters" in scan and "l_shipdate" in scan.split("PushedFilters")[1]
    # unused columns are not read
    assert "l_extendedprice" not in scan


def test_survival_does_not_read_what_it_does_not_need(spark, small_dir):
    plan = plan_of(study(spark, small_dir).drug_survival)
    # the exposure of persons plays no part in the curves
    assert "condition_source_value" not in plan


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_missing_keys_are_spread(spark, no_broadcast):
    rows = [(i, None if i % 4 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k int")
    lookup = spark.createDataFrame([(i, f"v{i}") for i in range(0, 400, 8)], "k int, v string")
    out = left_lookup(df, lookup, "k", ("id",))
    assert "hashpartitioning(k" in plan_of(out) and "_spare" in plan_of(out).split("hashpartitioning(k")[1][:40]
    assert out.count() == 400 and out.filter("v is not null").count() == 50


def test_large_sides_are_not_broadcast(spark, small_dir, no_broadcast):
    for name in ("index_window_join", "match_codes_any_route", "most_specific_condition", "map_phecodes"):
        assert "BroadcastHashJoin" not in plan_of(all_queries()[name](spark, small_dir))
