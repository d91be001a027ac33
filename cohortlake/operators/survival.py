"""Kaplan-Meier estimates, risk tables and densities of times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.ranks import quantiles
from cohortlake.session import cut_lineage

Z95 = 1.959963984540054
# Length of the stretch of time that one task sums up.
RANGE_WIDTH = 4096.0


def kaplan_meier(
    df: DataFrame,
    time: str = "days",
    status: str = "status",
    strata: str = "drug_name",
    exclude: Sequence[str] = (),
    distinct_rows: bool = True,
    range_width: float = RANGE_WIDTH,
) -> DataFrame:
    """Product-limit estimate per stratum and distinct time, with 95 % bounds.

    ``distinct_rows`` counts equal (time, status, stratum) rows once; status is 1
    for an event and 0 otherwise. Rows become counts per stratum and time first, so hot
    strata combine on the map side. A stratum's time axis is cut into ranges of
    ``range_width``: each range sums up its own times, then gets what the ranges before
    it leave, so that no task sorts more than one range, which for whole-day times has at
    most ``range_width`` rows. Give a smaller width for finer times.
    """
    rows = df.select(F.col(strata).alias("strata"), F.col(time).cast("double").alias("time"), F.col(status).alias("s"))
    rows = rows.filter(F.col("strata").isNotNull() & F.col("time").isNotNull() & F.col("s").isNotNull())
    if exclude:
        rows = rows.filter(~F.col("strata").isin(*exclude))
    event, censored = F.when(F.col("s") == 1, 1).otherwise(0), F.when(F.col("s") == 1, 0).otherwise(1)
    count = F.max if distinct_rows else F.sum
    counts = rows.groupBy("strata", "time").agg(
        count(event).cast("long").alias("n_event"), count(censored).cast("long").alias("n_censor")
    )
    # read three times below: the counts are kept, so that the rows are read once
    counts = cut_lineage(counts)
    n, d = F.col("n_risk"), F.col("n_event")
    here = d + F.col("n_censor")
    ranged = counts.withColumn("_range", F.floor(F.col("time") / range_width))
    in_range = Window.partitionBy("strata", "_range").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    by_range = Window.partitionBy("strata").orderBy("_range")
    from_range = by_range.rowsBetween(0, Window.unboundedFollowing)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)

    # those who leave in a range or after it, less those who left in it before this time
    entering = ranged.groupBy("strata", "_range").agg(F.sum(here).alias("_here"))
    entering = entering.select("strata", "_range", F.sum("_here").over(from_range).alias("_entering"))
    at_risk = ranged.join(entering, ["strata", "_range"]).withColumn(
        "n_risk", F.col("_entering") - F.sum(here).over(in_range) + here
    )
    # the step where everybody left dies takes the curve to 0 for good
    steps = at_risk.select(
        "strata", "_range", "time", "n_risk", "n_event", "n_censor",
        F.when(d == n, 1).otherwise(0).alias("_last"),
        F.when(d < n, F.log1p(-d / n)).otherwise(0.0).alias("_log_step"),
        F.when(d < n, d / (n * (n - d))).otherwise(0.0).alias("_var_step"),
    )
    passed = steps.groupBy("strata", "_range").agg(
        F.max("_last").alias("_last"), F.sum("_log_step").alias("_log"), F.sum("_var_step").alias("_var")
    )
    passed = passed.select(
        "strata",
        "_range",
        F.coalesce(F.max("_last").over(before), F.lit(0)).alias("_dead_before"),
        F.coalesce(F.sum("_log").over(before), F.lit(0.0)).alias("_log_before"),
        F.coalesce(F.sum("_var").over(before), F.lit(0.0)).alias("_var_before"),
    )
    summed = steps.join(passed, ["strata", "_range"]).select(
        "*",
        F.greatest("_dead_before", F.max("_last").over(in_range)).alias("_dead"),
        (F.col("_log_before") + F.sum("_log_step").over(in_range)).alias("_log"),
        F.sqrt(F.col("_var_before") + F.sum("_var_step").over(in_range)).alias("_se"),
    )
    alive = F.col("_dead") == 0
    return summed.select(
        "time",
        "n_risk",
        "n_event",
        "n_censor",
        F.when(alive, F.exp("_log")).otherwise(0.0).alias("estimate"),
        F.when(alive, F.col("_se")).otherwise(math.inf).alias("std_error"),
        F.when(alive, F.least(F.lit(1.0), F.exp(F.col("_log") + Z95 * F.col("_se")))).alias("conf_high"),
        F.when(alive, F.exp(F.col("_log") - Z95 * F.col("_se"))).alias("conf_low"),
        "strata",
    )


def risk_table(km: DataFrame, times: Sequence[float]) -> DataFrame:
    """Persons at risk and events so far at the display times, per stratum."""
    shown = km.select("*", F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("at"))
    leaving = F.col("n_event") + F.col("n_censor")
    return shown.groupBy("strata", F.col("at").alias("display_time")).agg(
        F.sum(F.when(F.col("time") >= F.col("at"), leaving).otherwise(0)).alias("at_risk"),
        F.sum(F.when(F.col("time") <= F.col("at"), F.col("n_event")).otherwise(0)).alias("events"),
    )


def density_by_group(
    df: DataFrame,
    value: str = "days_diff",
    group: str = "Binary_Severity",
    grid_n: int = 512,
    bw: float | None = None,
    resolution: float | None = None,
) -> DataFrame:
    """Gaussian kernel density per group on an even grid over all values.

    Equal values are counted first; ``resolution`` rounds values before. The counted
    values stay rows: each adds its part to the grid points of its group, the parts are
    summed up on the map side, and quartiles come from running counts, so that no group
    has to fit one row or task.
    The default bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5), with the standard deviation
    where the other is 0, and the absolute value, or 1, where all values are equal.
    """
    at = F.col(value).cast("double")
    spark = df.sparkSession
    # the number keeps the rows spread: each is unfolded along the grid further down
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    binned = cut_lineage(
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(group).alias("group"), (at if resolution is None else F.round(at / resolution) * resolution).alias("x"))
        .agg(F.count(F.lit(1)).alias("w"))
        .repartition(tasks, "group", "x")
    )
    w, x, n = F.col("w"), F.col("x"), F.col("n")
    ends = binned.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    groups = binned.groupBy("group").agg(
        F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("mean"), F.max(F.abs(x)).alias("same")
    )
    groups = groups.filter(n > 1).withColumnRenamed("group", "of")

    def with_groups(found: DataFrame) -> DataFrame:
        """The counted values with what is known of their group; a missing name is a group too."""
        return binned.join(found, F.col("group").eqNullSafe(F.col("of")))

    if bw is not None:
        sized = groups.withColumn("h", F.lit(float(bw)))
    else:
        squares = with_groups(groups).groupBy("of").agg(F.sum(w * F.pow(x - F.col("mean"), 2.0)).alias("squares"))
        quarters = quantiles(binned, "group", "x", "w", (0.25, 0.75))
        spreads = squares.join(quarters, F.col("of").eqNullSafe(F.col("group"))).select(
            F.col("of").alias("owner"), "squares", ((F.col("q")[1] - F.col("q")[0]) / 1.34).alias("iqr")
        )
        known = groups.join(spreads, F.col("of").eqNullSafe(F.col("owner"))).withColumn("sd", F.sqrt(F.col("squares") / (n - 1)))
        iqr, sd, same = F.col("iqr"), F.col("sd"), F.col("same")
        spread = F.when((iqr > 0) & (iqr < sd), iqr).when(sd > 0, sd).when(same > 0, same).otherwise(1.0)
        sized = known.select("of", "n", (0.9 * spread * F.pow(n, F.lit(-0.2))).alias("h"))
    place = ends["lo"] + (ends["hi"] - ends["lo"]) * F.col("i") / max(grid_n - 1, 1)
    parts = with_groups(sized.select("of", "n", "h")).select(
        "group", "x", "w", "n", "h", F.explode(F.sequence(F.lit(0), F.lit(grid_n - 1))).alias("i")
    )
    kernel = w * F.exp(-0.5 * F.pow((place - x) / F.col("h"), 2.0)) / (n * F.col("h") * math.sqrt(2 * math.pi))
    summed = parts.groupBy("group", "i").agg(F.sum(kernel).alias("density"))
    return summed.select("group", place.alias("x"), "density")
