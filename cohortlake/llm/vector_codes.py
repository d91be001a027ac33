"""Vector codes by k-means in each part, with the adaptive bounds of Drake and Hamerly.

Vectors of whole numbers are cut into parts, each with a codebook of entries. In every
round each part goes to its nearest entry, and entries become the means, rounded down,
of what they got. Between rounds a part of a vector keeps its entry, the b entries next
to it with lower bounds of their distances in ascending order, and one outer bound for
all other entries. When entries have moved, the distance to the own entry is computed
anew, the bounds shrink by the moves, and the place of the new distance among them says
how many entries can have come nearer: none, some of the b, or, beyond the outer bound,
all. What the bounds leave open is settled by squared distances in whole numbers.

How many of the b were needed is counted in every round, and the next round keeps as
many as settle nearly all parts. Bounds and entries are stored with the vectors between
rounds; a round reads the state of the one before and writes its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import dropped, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0
# Components are held within these bounds, so that squared distances stay within 64 bits.
LIMIT = 1 << 26
# Entries kept next to the own one: at first, at least and at most.
FIRST_KEPT = 16
LEAST_KEPT = 2
MOST_KEPT = 64
# Share of the parts that the kept entries should settle.
SETTLED = 0.98
# Vectors handled together in a task, and groups in which the smallest ids are sought.
ROWS = 4_096
SPREAD = 32
# Bounds are stored as 32-bit floats, always rounded away from the distance.
SLACK = 1e-6

STATE = "vec_id long, label string, codes binary, entry binary, near binary, bounds binary, error long"


@dataclass
class Codebooks:
    """Entries by part as whole numbers: (parts, entries, components)."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, counts: np.ndarray, sums: np.ndarray) -> Codebooks:
        """Means rounded down; entries that got nothing stay."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        return Codebooks(entries)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * most * most * max(points.shape[1], 1) < 1 << 53:
        # whole numbers below 2^53 are exact in doubles
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p**2).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e**2).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(points), len(entries)), dtype=np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((points - entry) ** 2).sum(axis=1)
    return out


def _below(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots."""
    return (np.sqrt(squares.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def nearest(points: np.ndarray, entries: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, next entries, their bounds with the outer one last, and squared distance, all computed."""
    squares = squared(points, entries)
    kept = min(kept, len(entries) - 1)
    order = np.argsort(squares, axis=1, kind="stable")[:, : kept + 2]
    sorted_squares = np.take_along_axis(squares, order, axis=1)
    bounds = _below(sorted_squares[:, 1 : kept + 1])
    outer = _below(sorted_squares[:, kept + 1 :]) if order.shape[1] > kept + 1 else np.full((len(points), 1), np.inf, dtype=np.float32)
    return order[:, 0], order[:, 1 : kept + 1], np.concatenate([bounds, outer], axis=1), sorted_squares[:, 0]


def reassigned(
    points: np.ndarray, entries: np.ndarray, moves: np.ndarray, entry: np.ndarray, near: np.ndarray, bounds: np.ndarray, kept: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State after the entries moved, and how many kept entries each point needed, -1 for all.

    ``moves`` holds upper bounds of the distances the entries went.
    """
    width = near.shape[1]
    own = ((points - entries[entry]) ** 2).sum(axis=1)
    lower = bounds.astype(np.float64)
    lower[:, :width] -= moves[near]
    lower[:, width] -= moves.max(initial=0.0)
    # each bound holds for its entry and all after it
    lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    lower -= np.where(np.isfinite(lower), np.abs(lower) * SLACK, 0.0)
    upper = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    needed = (lower[:, :width] <= upper[:, None]).sum(axis=1)
    everything = lower[:, width] <= upper
    needed[everything] = -1

    entry, near = entry.copy(), near.copy()
    some = np.flatnonzero(needed > 0)
    if len(some):
        # the own entry and those that may be nearer, ordered by whole-number distance
        reach = int(needed[some].max())
        asked = np.arange(reach)[None, :] < needed[some][:, None]
        row, column = np.nonzero(asked)
        squares = np.full((len(some), reach + 1), np.iinfo(np.int64).max, dtype=np.int64)
        squares[:, 0] = own[some]
        there = near[some][row, column]
        squares[row, column + 1] = ((points[some[row]] - entries[there]) ** 2).sum(axis=1)
        names = np.concatenate([entry[some][:, None], near[some][:, :reach]], axis=1)
        order = np.lexsort((np.where(squares < np.iinfo(np.int64).max, names, np.arange(reach + 1) + len(entries)), squares), axis=1)
        squares = np.take_along_axis(squares, order, axis=1)
        names = np.take_along_axis(names, order, axis=1)
        entry[some], own[some] = names[:, 0], squares[:, 0]
        near[some[:, None], np.arange(reach)[None, :]] = names[:, 1:]
        fresh = np.where(asked, _below(np.where(asked, squares[:, 1:], 0)), lower[some][:, :reach])
        lower[some[:, None], np.arange(reach)[None, :]] = fresh
        lower[some] = np.minimum.accumulate(lower[some][:, ::-1], axis=1)[:, ::-1]

    # as many bounds as the next round keeps: the first one given up becomes the outer one
    if kept < width:
        near, lower = near[:, :kept], lower[:, : kept + 1]
    elif kept > width:
        more = kept - width
        near = np.concatenate([near, np.repeat(entry[:, None], more, axis=1)], axis=1)
        lower = np.concatenate([lower, np.repeat(lower[:, -1:], more, axis=1)], axis=1)
    bounds = np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
    again = np.flatnonzero(everything)
    if len(again):
        entry[again], fresh_near, fresh_bounds, own[again] = nearest(points[again], entries, kept)
        near[again, : fresh_near.shape[1]] = fresh_near
        bounds[again, : fresh_bounds.shape[1]] = fresh_bounds
    return entry, near, bounds, own, needed


def _points(codes: pd.Series, parts: int) -> np.ndarray:
    """(vectors, parts, components)"""
    width = len(codes.iloc[0]) // 4
    return np.frombuffer(b"".join(codes), dtype="<i4").reshape(len(codes), parts, width // parts).astype(np.int64)


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str, scale: float, parts: int) -> DataFrame:
    """``vec_id, label, codes`` of usable vectors: floor(scale * x) as 32-bit numbers.

    Zeros are added up to a length that ``parts`` divides.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = []
            for value in batch["codes"]:
                x = np.asarray(value, dtype=np.float64)
                if not np.isfinite(x).all():
                    codes.append(None)
                    continue
                whole = np.zeros(-(-x.size // parts) * parts, dtype="<i4")
                whole[: x.size] = np.clip(np.floor(scale * x), -LIMIT, LIMIT)
                codes.append(whole.tobytes())
            yield batch.assign(codes=codes).dropna(subset="codes")

    slim = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("codes")
    )
    return slim.filter("codes is not null").mapInPandas(work, "vec_id long, label string, codes binary")


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Parts of the vectors with the smallest ids, ascending; None without vectors.

    Each of a fixed number of groups names its smallest, so one task sees few rows. Equal
    ids stand in the order of their codes; rows without an id come last.
    """
    order = [F.asc_nulls_last("vec_id"), F.asc("codes")]
    group = F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SPREAD))
    least = rows.select("vec_id", "codes", F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("place"))
    first = least.filter(F.col("place") <= entries).orderBy(*order).limit(entries).select("codes").toPandas()
    if not len(first):
        return None
    width = len(first["codes"].iloc[0])
    return Codebooks(_points(first["codes"][first["codes"].str.len() == width], parts).transpose(1, 0, 2).copy())


def _packed(found: list[tuple], points: np.ndarray, frame: pd.DataFrame) -> pd.DataFrame:
    """State rows of some vectors from the results by part."""
    entry = np.stack([f[0] for f in found], axis=1).astype("<u2")
    near = np.concatenate([f[1] for f in found], axis=1).astype("<u2")
    bounds = np.concatenate([f[2] for f in found], axis=1).astype("<f4")
    return pd.DataFrame(
        {
            "vec_id": frame["vec_id"],
            "label": frame["label"],
            "codes": frame["codes"],
            "entry": [row.tobytes() for row in entry],
            "near": [row.tobytes() for row in near],
            "bounds": [row.tobytes() for row in bounds],
            "error": sum(f[3] for f in found),
        }
    )


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS].reset_index(drop=True)


def _start(books: Codebooks, kept: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = len(books.entries)
        for frame in _pieces(batches):
            points = _points(frame["codes"], parts)
            yield _packed([nearest(points[:, p], books.entries[p], kept) for p in range(parts)], points, frame)

    return work


def _round(before: Codebooks, books: Codebooks, kept: list[int], next_kept: list[int]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = len(books.entries)
        gone = ((books.entries - before.entries) ** 2).sum(axis=2).astype(np.float64)
        moves = np.sqrt(gone) * (1 + SLACK)
        # how many parts needed how many entries, all of them last
        tally = np.zeros((parts, MOST_KEPT + 2), dtype=np.int64)
        for frame in _pieces(batches):
            points = _points(frame["codes"], parts)
            entry = np.frombuffer(b"".join(frame["entry"]), dtype="<u2").reshape(len(frame), parts).astype(np.int64)
            near = np.frombuffer(b"".join(frame["near"]), dtype="<u2").reshape(len(frame), -1).astype(np.int64)
            bounds = np.frombuffer(b"".join(frame["bounds"]), dtype="<f4").reshape(len(frame), -1)
            found = []
            for p in range(parts):
                a, b = sum(kept[:p]), sum(kept[: p + 1])
                *state, needed = reassigned(
                    points[:, p], books.entries[p], moves[p], entry[:, p], near[:, a:b], bounds[:, a + p : b + p + 1], next_kept[p]
                )
                tally[p] += np.bincount(np.where(needed < 0, MOST_KEPT + 1, needed), minlength=MOST_KEPT + 2)
                found.append(state)
            yield _packed(found, points, frame).assign(kind="state")
        yield pd.DataFrame(
            {
                "vec_id": np.repeat(np.arange(parts), MOST_KEPT + 2),
                "label": None,
                "codes": None,
                "entry": None,
                "near": None,
                "bounds": None,
                "error": tally.ravel(),
                "kind": [f"needed {i}" for i in range(MOST_KEPT + 2)] * parts,
            }
        )

    return work


def _sums(parts: int, entries: int):
    """Counts and component sums by part and entry, one row each per task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros((parts, entries), dtype=np.int64), None
        for frame in _pieces(batches):
            points = _points(frame["codes"], parts)
            entry = np.frombuffer(b"".join(frame["entry"]), dtype="<u2").reshape(len(frame), parts)
            sums = np.zeros((parts, entries, points.shape[2]), dtype=np.int64) if sums is None else sums
            for p in range(parts):
                counts[p] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(sums[p], entry[:, p], points[:, p])
        if sums is not None:
            part, which = np.nonzero(counts)
            yield pd.DataFrame({"part": part, "entry": which, "n": counts[part, which], "sums": list(sums[part, which])})

    return work


def _totals(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    parts, entries, width = books.entries.shape
    rows = state.select("codes", "entry").mapInPandas(_sums(parts, entries), "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
    for part, entry, n, *total in rows.groupBy("part", "entry").agg(F.sum("n"), *added).collect():
        counts[part, entry], sums[part, entry] = n, total
    return counts, sums


def _adapted(tally: np.ndarray, kept: list[int], most: int) -> list[int]:
    """The number of entries each part should keep, from how many were needed."""
    out = []
    for needed, now in zip(tally, kept, strict=True):
        total = max(int(needed.sum()), 1)
        upto = np.cumsum(needed[: MOST_KEPT + 1]) / total
        enough = int(np.argmax(upto >= SETTLED)) if upto[-1] >= SETTLED else 2 * now
        out.append(int(min(max(enough, LEAST_KEPT), MOST_KEPT, most)))
    return out


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, code, error`` per vector, and the codebooks the codes refer to.

    ``code`` has two hex digits per part, ``error`` is the sum of the squared distances.
    Vectors that are null or hold null or non-finite components are left out, and so are
    those whose length is not that of the smallest id's vector. Repeated rows stay; ties go
    to the lower entry. With fewer vectors than entries the codebooks are as small. Components
    are held within 2^26 after scaling. An empty table gives no rows and no codebooks.
    """
    spark: SparkSession = vectors.sparkSession
    rows = stored(whole_numbers(vectors, key, vector, label, scale, parts), "numbers")
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), None
    _, count, width = books.entries.shape
    most = count - 1
    kept = [min(FIRST_KEPT, most)] * parts
    fitting = rows.filter(F.length("codes") == 4 * parts * width)
    state = held = stored(fitting.mapInPandas(_start(books, kept[0]), STATE), "state")
    dropped(rows)
    next_kept = kept
    for done in range(1, rounds + 1):
        counts, sums = _totals(state, books)
        before, books = books, books.moved(counts, sums)
        # the last assignment has no round after it that would use bounds
        next_kept = [0] * parts if done == rounds else next_kept
        after = stored(state.mapInPandas(_round(before, books, kept, next_kept), f"{STATE}, kind string"), "state")
        tally = np.zeros((parts, MOST_KEPT + 2), dtype=np.int64)
        needed = after.filter("kind <> 'state'").groupBy(F.col("vec_id").cast("int"), F.substring("kind", 8, 9).cast("int")).agg(F.sum("error"))
        for part, place, n in needed.collect():
            tally[part, place] = n
        kept = next_kept
        next_kept = _adapted(tally, kept, most)
        dropped(held)
        state, held = after.filter("kind = 'state'").drop("kind"), after
    code = F.hex(F.concat(*[F.substring("entry", 2 * p + 1, 1) for p in range(parts)]))
    return state.select("vec_id", "label", F.lower(code).alias("code"), "error"), books
