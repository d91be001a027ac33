"""Packing token ids into windows of equal capacity by multiway differencing.

The largest differencing method of Karmarkar and Karp merges partial partitions:
every piece starts as a partition of its own, with its length in one of k windows
and nothing in the others. The two partitions of the largest imbalance are merged
again and again, the fullest windows of one onto the emptiest of the other, so that
imbalances cancel. The last partition gives k nearly equal windows; when one holds
more than the capacity, k rises and the pieces are merged anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.token_ids import text_encoder

CAPACITY = 2048
END_ID = 1
# A document's rest beyond its full windows is cut into pieces of this length at
# most: small enough to even windows out, large enough to keep text together.
PIECE = 256
# Windows merged at once; bounds a task's memory and the padding of the last one.
GROUP_WINDOWS = 1024

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded long"
)


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece; sums are as equal as the merges make them."""
    count = len(lengths)
    root = np.arange(count)
    order = np.argsort(-lengths, kind="stable")
    # (minus imbalance, number, sums in falling order, first pieces of the windows)
    heap = [(-int(lengths[i]), n, lengths[i : i + 1], order[n : n + 1]) for n, i in enumerate(order)]
    heapq.heapify(heap)
    number = count
    while len(heap) > 1:
        _, _, sums, heads = heapq.heappop(heap)
        _, _, other, tails = heapq.heappop(heap)
        both = max(len(sums) + len(other) - windows, 0)
        if both:
            # the emptiest windows of the one take the emptiest of the other crosswise
            kept, gone = heads[len(heads) - both :], tails[len(tails) - both :][::-1]
            root[gone] = kept
            sums = sums.copy()
            sums[len(sums) - both :] += other[len(other) - both :][::-1]
        sums = np.concatenate([sums, other[: len(other) - both]])
        heads = np.concatenate([heads, tails[: len(tails) - both]])
        down = np.argsort(-sums, kind="stable")
        sums, heads = sums[down], heads[down]
        least = int(sums[-1]) if len(sums) == windows else 0
        heapq.heappush(heap, (least - int(sums[0]), number, sums, heads))
        number += 1
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    return np.unique(root, return_inverse=True)[1]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece such that none holds more than ``capacity``."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differencing(lengths, windows)
        excess = np.bincount(window, weights=lengths) - capacity
        over = excess[excess > 0]
        if not len(over):
            return window
        windows += max(1, int(over.sum()) // capacity)


def _padded(total: int, capacity: int) -> int:
    return total if total & (total - 1) == 0 else capacity


def number_windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece, numbered along the order of the pieces.

    A piece of the full capacity is a window of its own; the others are packed. Packed
    windows hold pieces from all over: in the order of their means they take the places
    at which equal shares of these pieces have gone by, so that both kinds of windows
    come as often as their tokens do.
    """
    ends = np.cumsum(lengths)
    middle = ends - lengths / 2
    whole = lengths == capacity
    window = np.zeros(len(lengths), dtype=np.int64)
    window[whole] = np.arange(np.count_nonzero(whole))
    places = middle[whole]
    if not whole.all():
        rests = lengths[~whole]
        packed = pack_lengths(rests, capacity)
        means = np.bincount(packed, weights=rests * middle[~whole]) / np.bincount(packed, weights=rests)
        along = (np.arange(len(means)) + 0.5) / len(means) * rests.sum()
        spread = np.empty(len(means))
        spread[np.argsort(means, kind="stable")] = np.interp(along, np.cumsum(rests) - rests / 2, middle[~whole])
        window[~whole] = packed + len(places)
        places = np.concatenate([places, spread])
    rank = np.empty(len(places), dtype=np.int64)
    rank[np.argsort(places, kind="stable")] = np.arange(len(places))
    return rank[window]


class _Packer:
    """Windows of one partition in groups, numbered along its rows."""

    def __init__(self, partition: int, capacity: int, piece: int, group_windows: int) -> None:
        self.capacity, self.piece, self.group_windows = capacity, piece, group_windows
        self.next = partition << 36
        self.waiting: list[tuple] = []
        self.waiting_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        start = 0
        while start < total:
            left = total - start
            length = self.capacity if left >= self.capacity else min(self.piece, left)
            self.waiting.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total))
            self.waiting_ids += length
            start += length
            if self.waiting_ids >= self.group_windows * self.capacity:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.waiting:
            return
        lengths = np.array([one[2] for one in self.waiting], dtype=np.int64)
        window = number_windows(lengths, self.capacity)
        sums = np.bincount(window, weights=lengths).astype(np.int64).tolist()
        filled = [0] * len(sums)
        for i in np.argsort(window, kind="stable").tolist():
            one, number = self.waiting[i], int(window[i])
            padded = self.capacity if one[2] == self.capacity else _padded(sums[number], self.capacity)
            yield (*one, self.next + number, filled[number], padded)
            filled[number] += one[2]
        self.next += len(sums)
        self.waiting, self.waiting_ids = [], 0


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    piece: int = PIECE,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """Pieces of all documents with the windows ("sequences") they lie in.

    One row per piece: the document, where the piece begins in it (``start``), its
    ``length`` and ``ids`` (little-endian unsigned 32 bits), the document's ids with
    the end id (``doc_tokens``), the window, the place in it, and the length the
    window is padded to: the capacity, or nothing where its sum is a power of two.

    A document's full windows stand alone; its rest is cut into pieces and packed
    with the rests of the same partition, a group of ``group_windows`` at a time, full
    windows included. Windows are numbered along the partitions and, group by group, along
    the rows, so that sorted rows give windows in their order. Nothing is shuffled, a hot source or very long document meets no limit, and a
    task that is run again gives the same windows for the same rows.

    A null text is empty and gives its end id alone. Null and repeated keys are
    packed like others. An empty table gives no rows.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = text_encoder(tokenizer_path, spaces_count=False)
        end = int(end_id).to_bytes(4, "little")
        packer = _Packer(TaskContext.get().partitionId(), capacity, piece, group_windows)
        names = [part.split()[0] for part in PIECE_SCHEMA.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"doc_id": "Int64"})

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            texts = [value if isinstance(value, str) else "" for value in batch["text"]]
            keys = [None if pd.isna(value) else int(value) for value in batch["key"]]
            for at in range(0, len(texts), 1000):
                for doc, ids in zip(keys[at : at + 1000], encoder.encode(texts[at : at + 1000]), strict=True):
                    for row in packer.add(doc, ids + end):
                        rows.append(row)
                        held += row[2]
                if held > 2_000_000:
                    yield frame(rows)
                    rows, held = [], 0
        encoder.forget()
        rows.extend(packer.flush())
        if rows:
            yield frame(rows)

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInPandas(work, PIECE_SCHEMA)
