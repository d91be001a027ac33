"""Groups of any size as tiles of bounded size, all pairs of a group in exactly one tile."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(
    df: DataFrame, group: str, size: str, member: str, limit: int, weight: str | None = None, weight_limit: int = 1
) -> DataFrame:
    """Rows dealt to tiles of about two times ``limit`` rows, sorted by tile in each partition.

    ``weight``, the bytes of the group, bounds the bytes of a tile in the same way.

    ``size`` holds the group's number of rows. A group within the limit is one tile. A
    larger one is cut into blocks by a hash of the member, and each pair of blocks is
    a tile, so that a row is repeated once per block, not once per partner. Adds
    ``tile`` (a hash of group and blocks), ``block`` and ``other``; in a tile of two
    blocks only pairs across them count.
    """
    blocks = F.ceil(F.col(size) / limit)
    if weight is not None:
        blocks = F.least(F.col(size), F.greatest(blocks, F.ceil(F.col(weight) / weight_limit)))
    blocks = blocks.cast("int")
    mine = F.pmod(F.xxhash64(member, F.lit("block")), blocks).cast("int")
    dealt = df.withColumn("block", mine).withColumn("_at", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return (
        dealt.withColumn("low", F.least("block", "_at"))
        .withColumn("high", F.greatest("block", "_at"))
        .repartition(F.col(group), F.col("low"), F.col("high"))
        .sortWithinPartitions(group, "low", "high")
        .drop("_at")
    )


def tile_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs inside consecutive groups of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    rows = np.arange(int(sizes.sum()))
    ends = np.repeat(starts + sizes, sizes)
    after = ends - rows - 1
    left = np.repeat(rows, after)
    first = np.cumsum(after) - after
    right = np.arange(len(left)) - np.repeat(first, after) + left + 1
    return left, right


def whole_tiles(
    batches: Iterator[pd.DataFrame], keys: Sequence[str], most_pairs: int, heavy: str | None = None, most_bytes: int = 1
) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole tiles with the tiles' sizes, about ``most_pairs`` pairs at a time.

    Where a column ``heavy`` is named, its bytes are held to about ``most_bytes`` as well.
    The rows must come sorted by tile; a tile that a batch cuts is joined again.
    """
    rest: list[pd.DataFrame] = []

    def cut(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        columns = [frame[key].to_numpy() for key in keys]
        new = np.ones(len(frame), dtype=bool)
        if len(frame):
            new[1:] = np.any([column[1:] != column[:-1] for column in columns], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(frame))
        pairs = np.cumsum(sizes * (sizes - 1) // 2)
        weight = np.zeros(len(sizes), dtype=np.int64)
        if heavy is not None and len(sizes):
            weight = np.cumsum(np.add.reduceat(frame[heavy].str.len().to_numpy(dtype=np.int64), starts))
        at = 0
        while at < len(sizes):
            done = pairs[at - 1] if at else 0
            end = int(np.searchsorted(pairs, done + most_pairs, side="right"))
            end = max(at + 1, min(end, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + most_bytes, side="right"))))
            last = starts[end] if end < len(starts) else len(frame)
            yield frame.iloc[starts[at] : last].reset_index(drop=True), sizes[at:end]
            at = end

    for batch in batches:
        if not len(batch):
            continue
        last = batch.iloc[-1]
        same = np.all([batch[key].to_numpy() == last[key] for key in keys], axis=0)
        if same.all() and rest and all(rest[0][key].iloc[0] == last[key] for key in keys):
            rest.append(batch)
            continue
        frame = pd.concat([*rest, batch], ignore_index=True) if rest else batch
        tail = np.all([frame[key].to_numpy() == last[key] for key in keys], axis=0)
        first = int(np.argmax(tail))
        if first:
            yield from cut(frame.iloc[:first])
        rest = [frame.iloc[first:]]
    if rest:
        yield from cut(pd.concat(rest, ignore_index=True))


def local_roots(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """The smallest place connected to each place by the given pairs."""
    root = np.arange(count)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    return root
