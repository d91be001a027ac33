import statistics

import pytest
from pyspark.sql import functions as F

from cohortlake.operators.ranks import exact_medians, running_total


@pytest.mark.parametrize("limit", [10**6, 20])
def test_running_total(spark, limit):
    """One group holds most rows; cut into ranges it gives the same sums."""
    df = spark.range(500).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 10)).alias("g"),
        (F.col("id") * 37 % 500).alias("o"),
        (F.col("id") % 5).alias("w"),
    )
    got = {(r.g, r.o): r.running for r in running_total(df, ["g"], [F.desc("o")], F.col("w"), group_limit=limit).collect()}
    rows = sorted(((r.g, -r.o, r.w) for r in df.collect()))
    sums, expected = {}, {}
    for g, minus_o, w in rows:
        sums[g] = sums.get(g, 0) + w
        expected[g, -minus_o] = sums[g]
    assert got == expected


@pytest.mark.parametrize("limit", [10**6, 5])
def test_medians(spark, limit):
    values = {"odd": [3.0, 1.0, 2.0, 2.0, 9.0], "even": [1.0, 4.0, 2.0, 8.0], "same": [5.0] * 7, "one": [6.5]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    rows += [("odd", None), ("even", float("nan")), ("none", None)]
    rows += [("wide", float(i * 17 % 101)) for i in range(101)]
    got = {r.name: r["median"] for r in exact_medians(
        spark.createDataFrame(rows, "name string, value double"), "name", "value", limit).collect()}
    expected = {k: statistics.median(vs) for k, vs in values.items()} | {"wide": 50.0}
    assert got == expected
