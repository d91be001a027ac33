"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import stored

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest id reachable from each id that has an edge: ``id, component``.

    Each round links larger neighbours, then smaller ones, to the least known id; the
    edges of a component end up as a star around its smallest id. Edges are kept in the
    shared folder between rounds, so nothing is computed twice and none reach the
    driver. Loops and repeated edges do no harm; rows with a null end are left out.
    """
    now = edges.select(
        F.greatest(F.col(a), F.col(b)).cast("long").alias("u"), F.least(F.col(a), F.col(b)).cast("long").alias("v")
    ).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    now = stored(now.distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours, and the node itself, move to the least neighbour
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.filter("m <> u").select("u", F.col("m").alias("v"))
        wide = large.union(own).distinct()
        # then smaller neighbours and the node gather at the least of them
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        small = wide.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


