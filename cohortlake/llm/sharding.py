"""Sharding by a weighted hash tree: region, then rack, then shard.

At each level every child draws a number from a hash of the key and the child's name,
scaled by the weight of the shards below it, and the best draw wins: the chance to win
is the child's share of the weight. A draw depends on the child alone, so a change of
weight moves keys only into or out of the subtrees whose weight has changed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import number_rows, spare_name

# Layout of the first shards; see ``tree_of``.
SHARDS_PER_RACK = 2
RACKS_PER_REGION = 2
PLANNED_SHARDS = 8


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def tree_of(shards: int) -> list[Shard]:
    """The tree for a number of shards.

    The first eight share racks and regions. Every further shard opens a region of
    its own, so that it takes keys only into itself; moving it into a shared region
    is a change of weights there, to be planned by an explicit tree.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    leaves = []
    for number in range(shards):
        rack = number // SHARDS_PER_RACK
        if number < PLANNED_SHARDS:
            leaves.append(Shard(f"region{rack // RACKS_PER_REGION}", f"rack{rack}", number))
        else:
            leaves.append(Shard(f"region-of-{number}", f"rack-of-{number}", number))
    return leaves


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of the given rate; the least one wins."""
    top = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
    return -F.log((top + 0.5) / F.lit(float(1 << 53))) / F.lit(weight)


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard of a key, by a descent of three levels. Shards of weight 0 get nothing."""
    regions: dict[str, dict[str, list[Shard]]] = defaultdict(lambda: defaultdict(list))
    for leaf in tree:
        if leaf.weight > 0:
            regions[leaf.region][leaf.rack].append(leaf)
    if not regions:
        raise ValueError("no shard has a weight")

    def best(children: list[tuple[str, float, Column]]) -> Column:
        if len(children) == 1:
            return children[0][2]
        names = F.array_min(
            F.array(*[F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("child")) for i, (name, weight, _) in enumerate(children)])
        )["child"]
        chosen = children[-1][2]
        for i in range(len(children) - 2, -1, -1):
            chosen = F.when(names == i, children[i][2]).otherwise(chosen)
        return chosen

    upper = []
    for region in sorted(regions):
        middle = []
        for rack in sorted(regions[region]):
            lower = [(f"shard/{leaf.number}", leaf.weight, F.lit(leaf.number)) for leaf in regions[region][rack]]
            middle.append((f"rack/{region}/{rack}", sum(x.weight for x in regions[region][rack]), best(lower)))
        upper.append((f"region/{region}", sum(x[1] for x in middle), best(middle)))
    return best(upper).cast("int")


def assign(
    docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shard of every row, and its shard in the ``grown`` tree.

    Returns the key, ``size`` (bytes of the text and one more), ``text_crc32``,
    ``shard``, ``slot`` (the row's number in its shard, without gaps) and
    ``grown_shard``. Texts are read once and not shuffled. A null text has size 1
    and checksum 0. A null key is a key like others; equal keys share a shard.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        shard_of(name, tree).alias("shard"),
        (shard_of(name, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_rows(rows, ["shard"], ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, tree: Sequence[Shard], key: str = "doc_id") -> None:
    """Write all rows to one folder per shard, ``shard=N``; large shards in many files."""
    column = spare_name(docs, "shard")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    docs.withColumn(column, shard_of(name, tree)).write.partitionBy(column).parquet(path)
