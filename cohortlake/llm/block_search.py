"""Exact top-k search by inner product, block at a time.

Vectors of whole numbers are laid out in document ranges: signs of a few random
projections place like vectors side by side, a range of them is a segment, and within
a segment recursive halving along the widest component gives blocks. A block keeps a
forward index, its vectors, and per component (a term) the greatest and the least
value. The term maxima a query meets, greatest values for its positive components and
least ones for its negative components, sum up to a bound of all scores in the block.

A query takes the blocks in the order of their bounds and scores them through the
forward index until the next bound is below its k-th score. It does so in its own
segment first. The k-th score found there is carried along: only groups with a
segment whose own bound reaches it are visited later, by the queries that may find
something there.

The queries are a stated set against all rows. They meet the segments in cells of
bounded size, a part of the queries and a group of segments each; a query goes through
all blocks of a group in one order and leaves it with no more than k rows. Nothing is
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import stored

# Components are held within these bounds, so that no score leaves 64 bits.
LIMIT = 1 << 26
SIGNS = 16
BLOCK = 64
SEGMENT = 32_768
# Vectors of a segment that share a row of the stored index.
ROW = 1_024
# Queries of a cell, and segments whose bounds are looked at together.
QUERIES = 8_192
BOUNDS = 1_024
# Blocks scored in the first step; each further step takes twice as many.
FIRST_BLOCKS = 4
NO_SCORE = np.iinfo(np.int64).min

INDEX = "kind string, segment long, ids binary, codes binary, id long, floor long, found array<long>, scores array<long>"


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id, codes, place``: floor(scale * x) of usable vectors as 32-bit numbers.

    Vectors that are null or hold null or non-finite components, and rows without a key,
    are left out. Of rows that share a key the one whose bytes come first stays.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes, place = [], []
            for value in batch["vector"]:
                # a null component becomes NaN
                x = np.asarray(value, dtype=np.float64)
                if not np.isfinite(x).all():
                    codes.append(None)
                    place.append(0)
                    continue
                whole = np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype("<i4")
                if x.size not in planes:
                    planes[x.size] = np.random.default_rng([SIGNS, x.size]).normal(size=(x.size, SIGNS))
                signs = whole @ planes[x.size] > 0
                codes.append(whole.tobytes())
                place.append(int(signs @ (1 << np.arange(SIGNS))))
            yield pd.DataFrame({"id": batch["id"], "codes": codes, "place": pd.Series(place, dtype="int32")}).dropna(subset="codes")

    slim = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    made = slim.filter("id is not null and vector is not null").mapInPandas(work, "id long, codes binary, place int")
    return made.groupBy("id").agg(F.min(F.struct("codes", "place")).alias("row")).select("id", "row.codes", "row.place")


def _matrix(raw: list[bytes], width: int | None = None) -> np.ndarray:
    """Codes as rows of one width; components a vector lacks are zero."""
    sizes = {len(r) for r in raw}
    most = max(sizes, default=0) // 4
    if len(sizes) == 1:
        out = np.frombuffer(b"".join(raw), dtype="<i4").reshape(len(raw), most).astype(np.int64)
    else:
        out = np.zeros((len(raw), most), dtype=np.int64)
        for i, r in enumerate(raw):
            out[i, : len(r) // 4] = np.frombuffer(r, dtype="<i4")
    return out if width is None else _widened(out, width)


def _widened(codes: np.ndarray, width: int) -> np.ndarray:
    """Zeros added, or components without a partner cut, up to ``width``."""
    have = codes.shape[1]
    return codes[:, :width] if have >= width else np.pad(codes, ((0, 0), (0, width - have)))


def halved(codes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of the rows in which blocks are narrow: halves along the widest component."""
    done, todo = [], [np.arange(len(codes))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block or not codes.shape[1]:
            done.append(rows)
            continue
        some = codes[rows]
        widest = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
        rows = rows[np.argsort(some[:, widest], kind="stable")]
        cut = -(-(len(rows) // 2) // block) * block
        todo += [rows[cut:], rows[:cut]]
    return np.concatenate(done) if done else np.arange(0)


class Segment:
    """Forward index of one segment, or of several in a row, with the term maxima of its blocks.

    ``names`` and ``sizes`` tell the segments and their rows; no block spans two of them.
    """

    def __init__(self, ids: np.ndarray, codes: np.ndarray, block: int = BLOCK, names: np.ndarray | None = None, sizes: np.ndarray | None = None) -> None:
        self.ids, self.width = ids, codes.shape[1]
        self.most = int(np.abs(codes).max(initial=0))
        names = np.zeros(1, dtype=np.int64) if names is None else names
        sizes = np.array([len(ids)]) if sizes is None else sizes
        begins = np.cumsum(sizes) - sizes
        self.starts = np.concatenate([np.arange(b, b + n, block) for b, n in zip(begins, sizes, strict=True)])
        self.ends = np.append(self.starts[1:], len(ids))
        self.names = np.repeat(names, -(-sizes // block))
        self.steps = np.arange(block)
        self.high = np.maximum.reduceat(codes, self.starts, axis=0)
        self.low = np.minimum.reduceat(codes, self.starts, axis=0)
        self.least = np.minimum.reduceat(ids, self.starts)
        self.codes = codes
        self.scored = 0
        self._double: tuple | None = None

    def _arrays(self, queries: np.ndarray) -> tuple:
        """Products stay exact in doubles while they are below 2^53; beyond, whole numbers serve."""
        if self.width * max(self.most, 1) * int(np.abs(queries).max(initial=0)) >= 1 << 53:
            return queries, self.codes, self.high, self.low
        if self._double is None:
            self._double = tuple(a.astype(np.float64) for a in (self.codes, self.high, self.low))
        return queries.astype(np.float64), *self._double

    def search(
        self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, done: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and scores of at most ``k`` best rows that reach its floor.

        Equal scores go to the smaller id. A row of the query's own id does not count,
        nor do those of the segment it is ``done`` with.
        """
        q, codes, high, low = self._arrays(_widened(queries, self.width))
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        for i in range(len(q)):
            order = np.lexsort((self.least, -bounds[i]))
            if done is not None:
                order = order[self.names[order] != done[i]]
            bound, least = bounds[i][order], self.least[order]
            ids, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            at, step = 0, FIRST_BLOCKS
            while at < len(order):
                if len(ids) >= k:
                    kth, last = scores[-1], ids[-1]
                    if bound[at] < kth or (bound[at] == kth and least[at] > last):
                        break
                elif bound[at] < floors[i]:
                    break
                some = order[at : at + step]
                rows = self.starts[some][:, None] + self.steps
                rows = rows[rows < self.ends[some][:, None]]
                found = (codes[rows] @ q[i]).astype(np.int64)
                self.scored += len(some)
                good = (self.ids[rows] != own[i]) & (found >= floors[i])
                ids = np.concatenate([ids, self.ids[rows[good]]])
                scores = np.concatenate([scores, found[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                at += step
                step *= 2
            yield ids, scores


def _index(asked: Callable[[np.ndarray], np.ndarray], k: int, size: int, block: int):
    """Segments of a sorted partition, and what its queries find in their own segment."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        serial = 0

        def finish(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nonlocal serial
            rows = pd.concat(frames, ignore_index=True)
            codes = _matrix(rows["codes"].tolist())
            order = halved(codes, block)
            ids, codes = rows["id"].to_numpy()[order], codes[order]
            name = (part << 32) + serial
            serial += 1
            segment = Segment(ids, codes, block)
            out = []
            for at in range(0, len(ids), ROW):
                some = slice(at, at + ROW)
                out.append(("index", name, ids[some].astype("<i8").tobytes(), codes[some].astype("<i4").tobytes(), at, None, None, None))
            low, high = segment.low.min(axis=0).astype("<i4"), segment.high.max(axis=0).astype("<i4")
            out.append(("bounds", name, low.tobytes(), high.tobytes(), len(ids), None, None, None))
            yield pd.DataFrame(out, columns=columns, dtype=object)
            mine = np.flatnonzero(asked(ids))
            for at in range(0, len(mine), ROW):
                some = mine[at : at + ROW]
                out = []
                for i, (found, scores) in zip(
                    some, segment.search(ids[some], codes[some], np.full(len(some), NO_SCORE), k), strict=True
                ):
                    floor = int(scores[-1]) if len(scores) >= k else None
                    out.append(("query", name, None, codes[i].astype("<i4").tobytes(), int(ids[i]), floor, found, scores))
                yield pd.DataFrame(out, columns=columns, dtype=object)

        columns = [column.split()[0] for column in INDEX.split(", ")]
        waiting: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            while len(batch):
                taken = batch.iloc[: size - count]
                waiting.append(taken)
                count += len(taken)
                batch = batch.iloc[len(taken) :]
                if count == size:
                    yield from finish(waiting)
                    waiting, count = [], 0
        if waiting:
            yield from finish(waiting)

    return work


def _by_cell(cell: list[str], build: Callable, answer: Callable):
    """Rows sorted by cell, what is searched before the queries: loads the one, answers the others."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, loading, ready = None, [], None
        for batch in batches:
            keys = list(zip(*[batch[c] for c in cell], batch["kind"], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                some, name = batch.iloc[a:b], keys[a][:-1]
                if name != now:
                    now, loading, ready = name, [], None
                if keys[a][-1] != "query":
                    loading.append(some)
                    continue
                if ready is None:
                    if not loading:
                        continue
                    ready = build(pd.concat(loading, ignore_index=True))
                    loading = []
                yield from answer(ready, some)

    return work


def _load_bounds(rows: pd.DataFrame) -> tuple:
    rows = rows.sort_values("group", kind="stable")
    return rows["group"].to_numpy(), rows["segment"].to_numpy(), _matrix(rows["ids"].tolist()), _matrix(rows["codes"].tolist())


def _visits(ready: tuple, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Groups with a segment, other than the query's own, whose bound reaches its floor."""
    groups, segments, low, high = ready
    width = max(low.shape[1], high.shape[1])
    low, high = _widened(low, width), _widened(high, width)
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    floors = queries["floor"].fillna(NO_SCORE).astype("int64").to_numpy()
    for at in range(0, len(queries), ROW):
        some = queries.iloc[at : at + ROW]
        q = _matrix(some["codes"].tolist(), width)
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        reached = (bounds >= floors[at : at + ROW, None]) & (segments != some["segment"].to_numpy()[:, None])
        which, where = np.nonzero(np.logical_or.reduceat(reached, starts, axis=1))
        out = some.iloc[which][["kind", "segment", "id", "codes", "floor", "queries"]].reset_index(drop=True)
        yield out.assign(group=groups[starts][where])


def _load_segments(block: int):
    def load(rows: pd.DataFrame) -> Segment:
        rows = rows.sort_values(["segment", "id"])
        ids = np.frombuffer(b"".join(rows["ids"]), dtype="<i8")
        sizes = rows["ids"].str.len().groupby(rows["segment"]).sum() // 8
        return Segment(ids, _spread_rows(rows), block, sizes.index.to_numpy(), sizes.to_numpy())

    return load


def _spread_rows(rows: pd.DataFrame) -> np.ndarray:
    """Codes of all rows of the index, as wide as the widest."""
    parts = []
    for ids, codes in zip(rows["ids"], rows["codes"], strict=True):
        count = len(ids) // 8
        parts.append(np.frombuffer(codes, dtype="<i4").reshape(count, len(codes) // 4 // count).astype(np.int64))
    width = max(part.shape[1] for part in parts)
    return np.concatenate([_widened(part, width) for part in parts])


def _found(k: int):
    def answer(index: Segment, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for at in range(0, len(queries), ROW):
            some = queries.iloc[at : at + ROW]
            own, floors = some["id"].to_numpy(dtype="int64"), some["floor"].fillna(NO_SCORE).astype("int64").to_numpy()
            query, ids, scores = [], [], []
            searched = index.search(own, _matrix(some["codes"].tolist()), floors, k, some["segment"].to_numpy())
            for one, (found, score) in zip(own, searched, strict=True):
                query.append(np.full(len(found), one))
                ids.append(found)
                scores.append(score)
            yield pd.DataFrame({"query_id": np.concatenate(query), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return answer


def top_k(
    vectors: DataFrame,
    asked: Callable[[np.ndarray], np.ndarray],
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    segment_rows: int = SEGMENT,
    block_rows: int = BLOCK,
    query_rows: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each query row.

    ``asked`` tells from an array of ids which rows are queries. Scores are exact inner
    products of floor(scale * x), held within 2^26; components a vector lacks count as
    zero. Equal scores go to the smaller id. Unusable vectors take no part, rows that
    share a key are one vector; a query without any other row returns nothing.
    """
    rows = stored(whole_numbers(vectors, key, vector, scale), "vectors")
    laid = rows.repartitionByRange("place", "id").sortWithinPartitions("place", "id").select("id", "codes")
    index = stored(laid.mapInPandas(_index(asked, k, segment_rows, block_rows), INDEX), "index")

    queries = index.filter("kind = 'query'")
    bounds = index.filter("kind = 'bounds'").select("kind", "segment", "ids", "codes", "id")
    asked_rows, segments, all_rows = index.agg(
        F.count_if(F.col("kind") == "query"), F.count_if(F.col("kind") == "bounds"), F.sum(F.when(F.col("kind") == "bounds", F.col("id")))
    ).first()
    parts = max(1, math.ceil(asked_rows / query_rows))
    groups = max(1, math.ceil((all_rows or 0) / segment_rows))
    chunks = max(1, math.ceil(segments / BOUNDS))

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    group = F.pmod(F.xxhash64("segment"), F.lit(groups)).cast("int")
    asking = queries.select("kind", "segment", "id", "codes", "floor", part.alias("queries"), spread(chunks).alias("bounds"))
    facing = bounds.withColumn("group", group).withColumn("bounds", F.col("group") % chunks).withColumn("queries", spread(parts))
    met = facing.unionByName(asking, allowMissingColumns=True).repartition("bounds", "queries").sortWithinPartitions("bounds", "queries", "kind")
    visits = stored(
        met.mapInPandas(
            _by_cell(["bounds", "queries"], _load_bounds, _visits),
            "kind string, segment long, id long, codes binary, floor long, queries int, group int",
        ),
        "visits",
    )
    cells = visits.select("group", "queries").distinct()
    searched = index.filter("kind = 'index'").select("kind", "segment", "ids", "codes", "id", group.alias("group")).join(cells, "group")
    both = searched.unionByName(visits, allowMissingColumns=True).repartition("group", "queries")
    both = both.sortWithinPartitions("group", "queries", "kind")
    others = both.mapInPandas(_by_cell(["group", "queries"], _load_segments(block_rows), _found(k)), "query_id long, vec_id long, score long")
    own = queries.select(F.col("id").alias("query_id"), F.inline(F.arrays_zip(F.col("found").alias("vec_id"), F.col("scores").alias("score"))))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        own.toDF("query_id", "vec_id", "score")
        .unionByName(others)
        .withColumn("rank", first)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
