"""Exact running totals, ranks and medians for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import cut_lineage

# Largest group a single window task may sort; larger ones are cut into ranges.
GROUP_LIMIT = 2_000_000


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    weight: Column,
    out: str = "running",
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` within each group.

    Groups within the limit use one window. Beyond it the rows are range
    partitioned by group and order, each range sums its own rows, and the totals
    of the ranges before it are added, so no group has to fit one task. The
    order must be total within a group.
    """
    frozen = cut_lineage(df)
    largest = frozen.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_limit:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return frozen.withColumn(out, F.sum(weight).over(window))

    sliced = cut_lineage(
        frozen.repartitionByRange(*group, *order).withColumns({"_slice": F.spark_partition_id(), "_weight": weight})
    )
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(F.sum("_weight").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.sum("_weight").over(inside))
    return (
        local.join(offsets, [*group, "_slice"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_slice", "_weight", "_local", "_offset")
    )


def exact_medians(long: DataFrame, name: str, value: str, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact median per name, NULL values left out.

    Equal values are counted before the shuffle; the one or two middle ranks are
    then found on the running counts.
    """
    counts = (
        long.filter(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(name, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counts, [name], [value], F.col("_n"), "_upto", group_limit)
    totals = ranked.groupBy(name).agg(F.max("_upto").alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    first = F.col("_upto") - F.col("_n") + 1

    def holds(rank: Column) -> Column:
        return first.__le__(rank) & (rank <= F.col("_upto"))

    return (
        ranked.join(totals, name)
        .groupBy(name)
        .agg(
            (
                (F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2
            ).alias("median")
        )
    )


def quantiles(
    counts: DataFrame, group: str, value: str, weight: str, shares: Sequence[float], group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Exact quantiles of counted values per group: ``group, q``, an array in the order of ``shares``.

    Between two ranks the quantile lies on the line between their values. The ranks are
    found on running counts; a missing group name is a group.
    """
    ranked = running_total(counts, [group], [value], F.col(weight), "_upto", group_limit)
    totals = ranked.groupBy(F.col(group).alias("_of")).agg(F.max("_upto").alias("_all"))
    joined = ranked.join(totals, F.col(group).eqNullSafe(F.col("_of")))
    found = []
    for share in shares:
        place = F.lit(share) * (F.col("_all") - 1)
        low, high = F.floor(place) + 1, F.ceil(place) + 1
        first = F.col("_upto") - F.col(weight) + 1
        at_low = F.max(F.when((first <= low) & (low <= F.col("_upto")), F.col(value)))
        at_high = F.max(F.when((first <= high) & (high <= F.col("_upto")), F.col(value)))
        rest = F.max(place - F.floor(place))
        found.append(at_low + (at_high - at_low) * rest)
    return joined.groupBy(group).agg(F.array(*found).alias("q"))
