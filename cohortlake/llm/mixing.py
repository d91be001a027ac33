"""Mixing sources to target weights by Pfair scheduling of blocks.

A source of weight w (its share of all weights) owes block j after (j + 1) / w slots
and must not give it before j / w: the window from floor(j / w) to ceil((j + 1) / w).
Each slot goes to the released block with the earliest deadline. Then at every moment
each source has given its weighted share, with less than one block of deviation.

Weights are whole numbers, so that the schedule repeats after as many slots as they
sum up to and only one round of it has to be played. When a source has no block left,
a new phase begins, in which the others keep the relation of their weights.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import number_rows, spare_name

# Rows per block, and the sum to which shares are rounded when weights are derived.
BLOCK_ROWS = 16
WEIGHT_SUM = 1000


@dataclass(frozen=True)
class Phase:
    """Slots from ``start``; ``slots[s]`` are the places of source s in one round."""

    start: int
    first: Mapping[str, int]
    blocks: Mapping[str, int]
    round_slots: int
    slots: Mapping[str, list[int]]


def one_round(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one round, earliest deadline first among released blocks."""
    divisor = math.gcd(*weights.values())
    parts = {name: weight // divisor for name, weight in weights.items()}
    total = sum(parts.values())
    given = dict.fromkeys(parts, 0)
    slots: dict[str, list[int]] = {name: [] for name in parts}
    for slot in range(total):
        released = [
            (-(-(given[name] + 1) * total // part), name)
            for name, part in parts.items()
            if given[name] < part and given[name] * total // part <= slot
        ]
        _, chosen = min(released)
        slots[chosen].append(slot)
        given[chosen] += 1
    return slots


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[Phase]:
    """The phases of a mix: one more for each time a source runs out.

    Works on one number per source, whatever the number of rows.
    """
    left = {name: count for name, count in sorted(blocks.items()) if count > 0}
    given = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        slots = one_round({name: weights[name] for name in left})
        length = sum(len(places) for places in slots.values())

        def slot_of(name: str, block: int, slots=slots, length=length) -> int:
            places = slots[name]
            return block // len(places) * length + places[block % len(places)]

        # the phase ends with the slot in which the first source gives its last block
        end = min(slot_of(name, count - 1) for name, count in left.items()) + 1
        whole, part = divmod(end, length)
        taken = {name: whole * len(places) + sum(1 for place in places if place < part) for name, places in slots.items()}
        out.append(Phase(start, dict(given), taken, length, slots))
        start += end
        given = {name: given[name] + taken[name] for name in left}
        left = {name: count - taken[name] for name, count in left.items() if count > taken[name]}
        given = {name: given[name] for name in left}
    return out


def weights_by_size(sizes: Mapping[str, int], power: float = 0.5, total: int = WEIGHT_SUM) -> dict[str, int]:
    """Whole weights in relation to a power of the sizes; at least 1 each."""
    raw = {name: max(size, 1) ** power for name, size in sizes.items()}
    scale = total / sum(raw.values()) if raw else 0
    return {name: max(1, round(value * scale)) for name, value in raw.items()}


def whole_weights(weights: Mapping[str, float | Fraction | str]) -> dict[str, int]:
    """The smallest whole numbers in the same relation: 0.7 and 0.3 are 7 and 3.

    A decimal is taken as it is written; weights must be above 0.
    """
    exact = {name: Fraction(str(weight)) for name, weight in weights.items()}
    if any(weight <= 0 for weight in exact.values()):
        raise ValueError("weights must be above 0")
    scale = math.lcm(*[weight.denominator for weight in exact.values()])
    divisor = math.gcd(*[int(weight * scale) for weight in exact.values()])
    return {name: int(weight * scale) // divisor for name, weight in exact.items()}


def _position(source: Column, block: Column, plan: list[Phase]) -> Column:
    """The slot of a block, from the round of the phase it falls into."""
    position = F.lit(None).cast("long")
    for phase in reversed(plan):
        names = sorted(phase.blocks)
        first = _lookup({name: F.lit(phase.first[name]).cast("long") for name in names}, source)
        taken = _lookup({name: F.lit(phase.blocks[name]).cast("long") for name in names}, source)
        places = _lookup({name: F.array(*[F.lit(x) for x in phase.slots[name]]) for name in names}, source)
        at = block - first
        share = F.size(places).cast("long")
        slot = F.floor(at / share).cast("long") * phase.round_slots + F.element_at(places, (F.pmod(at, share) + 1).cast("int"))
        inside = (block >= first) & (block < first + taken)
        position = F.when(inside, slot + phase.start).otherwise(position)
    return position


def _lookup(values: Mapping[str, Column], source: Column) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), value)]
    return F.try_element_at(F.create_map(*pairs), source)


def mix(
    docs: DataFrame,
    weights: Mapping[str, float | Fraction | str] | None = None,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row with its place in the mix.

    Adds ``mix_source`` (text; a null source is ``null``), ``mix_block`` (number of the block
    in its source), ``mix_position`` (its slot) and ``mix_row`` (place in the block), with
    an underscore before a name that ``docs`` has already.
    Sorted by position and row, any stretch of rows follows the weights of the
    sources that still have rows. No row is lost or repeated.

    A source's rows are dealt to its blocks by a hash of the key; its last block may
    be short. Weights may be fractions and are kept exactly (see ``whole_weights``; a round
    of the schedule is as long as they sum up to); left out, they follow the square
    root of the sources' row counts. A source without a weight gets 1. The driver
    gets one count per source. An empty table stays empty.
    """
    name, number = spare_name(docs, "mix_source"), spare_name(docs, "mix_number")
    named = docs.withColumn(name, F.coalesce(F.col(source).cast("string"), F.lit("null")))
    counts = {row[0]: row[1] for row in named.groupBy(name).count().collect()}
    shares = dict(weights) if weights is not None else weights_by_size(counts)
    plan = phases(
        {one: -(-count // block_rows) for one, count in counts.items()},
        whole_weights({one: shares.get(one, 1) for one in counts}),
    )
    numbered = number_rows(named, [name], [key], number)
    block = F.floor(F.col(number) / block_rows).cast("long")
    return numbered.select(
        *docs.columns,
        F.col(name),
        block.alias(spare_name(docs, "mix_block")),
        (_position(F.col(name), block, plan) if plan else F.lit(None).cast("long")).alias(spare_name(docs, "mix_position")),
        F.pmod(F.col(number), F.lit(block_rows)).cast("int").alias(spare_name(docs, "mix_row")),
    )


def mixed(docs: DataFrame, weights: Mapping[str, float | Fraction | str] | None = None, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows themselves in mixing order, over all partitions in a row."""
    order = [spare_name(docs, "mix_position"), spare_name(docs, "mix_row")]
    placed = mix(docs, weights, source, key)
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
