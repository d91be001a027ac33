"""Near-duplicate embeddings by lattice hashing.

A table projects vectors at random into eight dimensions and decodes them to the
nearest point of the E8 lattice, the densest packing there: the point is the
vector's home cell. A vector also probes the neighbouring cells it is closest to. In
several tables, vectors that meet in a cell, at least one of them at home, are
compared by cosine. Groups of vectors so linked are then compared pair by pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import stored
from cohortlake.llm.components import components
from cohortlake.llm.textarrays import mix
from cohortlake.llm.tiles import local_roots, tile_pairs, tiled, whole_tiles

THRESHOLD = 0.93
# One table finds a pair at the threshold with probability 0.6, eight all but 1 in 1,000.
TABLES = 8
PROBES = 3
# Unit vectors are stretched by this before decoding: the smaller, the larger the cells.
SCALE = 2.0
CELL_ROWS = 1024
GROUP_ROWS = 512
PAIRS = 200_000
DIMENSIONS = 8


def shortest_vectors() -> np.ndarray:
    """The 240 differences between a lattice point and its neighbours."""
    out = []
    for i, j in itertools.combinations(range(DIMENSIONS), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            vector = np.zeros(DIMENSIONS)
            vector[[i, j]] = a, b
            out.append(vector)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=DIMENSIONS)))
    return np.vstack([out, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def _even(points: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    whole = np.rint(points)
    error = points - whole
    odd = np.flatnonzero(whole.sum(axis=1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=1)
    whole[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return whole


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest point of E8: whole numbers with an even sum, or those moved by one half."""
    whole, half = _even(points), _even(points - 0.5) + 0.5
    nearer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def cells(unit: np.ndarray, table: int, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Hashes of the home cell of each unit vector, then of the cells it probes."""
    random = np.random.default_rng([table, unit.shape[1]])
    places = unit @ (random.normal(size=(unit.shape[1], DIMENSIONS)) * scale / np.sqrt(DIMENSIONS))
    home = decode(places)
    steps = shortest_vectors()
    near = np.argsort((home - places) @ steps.T, axis=1, kind="stable")[:, :probes]
    points = np.concatenate([home[:, None, :], home[:, None, :] + steps[near]], axis=1)
    keys = np.full(points.shape[:2], np.uint64(table + 1), dtype=np.uint64)
    for k in range(DIMENSIONS):
        keys = mix(keys + (2 * points[:, :, k]).astype(np.int64).view(np.uint64), 50 + k)
    return keys.view(np.int64)


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    # squares of very large or small numbers would leave the range of doubles
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _packed(column: Column, kind: str) -> Column:
    """The numbers of a usable vector as bytes, else null."""

    @F.pandas_udf("binary")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for value in batch:
                vector = None if value is None else np.asarray(value, dtype=np.float64)
                good = vector is not None and vector.size and np.isfinite(vector).all() and vector.any()
                out.append(vector.astype(kind).tobytes() if good else None)
            yield pd.Series(out, dtype=object)

    return work(column)


def _keyed(kind: str, tables: int, probes: int, scale: float):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in batch.groupby(batch["vector"].str.len()):
                unit = _units(some["vector"].tolist(), kind)
                ids, labels = some["id"].to_numpy(), some["label"].to_numpy(dtype=np.int64)
                for table in range(tables):
                    keys = cells(unit, table, probes, scale).view(np.uint64)
                    # labels and lengths never meet
                    keys = mix(keys ^ mix(labels.view(np.uint64), 60)[:, None], 61 + unit.shape[1]).view(np.int64)
                    home = np.zeros(keys.shape, dtype=bool)
                    home[:, 0] = True
                    yield pd.DataFrame({"id": np.repeat(ids, keys.shape[1]), "cell": keys.ravel(), "home": home.ravel()})

    return work


def _tile_cosines(frame: pd.DataFrame, sizes: np.ndarray, kind: str, home: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of each tile."""
    unit = _units(frame["vector"].tolist(), kind)
    left, right = tile_pairs(sizes)
    block = frame["block"].to_numpy()
    count = (block[left] != block[right]) | (frame["low"].to_numpy() == frame["high"].to_numpy())[left]
    if home is not None:
        count &= home[left] | home[right]
    left, right = left[count], right[count]
    for at in range(0, len(left), PAIRS):
        a, b = left[at : at + PAIRS], right[at : at + PAIRS]
        good = np.einsum("ij,ij->i", unit[a], unit[b]) >= THRESHOLD
        yield a[good], b[good]


def _cell_edges(kind: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, sizes in whole_tiles(batches, ["cell", "low", "high"], PAIRS):
            found = list(_tile_cosines(frame, sizes, kind, frame["home"].to_numpy(dtype=bool)))
            if not found:
                continue
            root = local_roots(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), len(frame))
            moved = np.flatnonzero(root != np.arange(len(frame)))
            ids = frame["id"].to_numpy()
            yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]}).query("a != b").drop_duplicates()

    return work


def _group_links(kind: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, sizes in whole_tiles(batches, ["component", "low", "high"], PAIRS):
            links = np.zeros(len(frame), dtype=np.int64)
            copies = frame["copies"].to_numpy()
            for a, b in _tile_cosines(frame, sizes, kind, None):
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
            yield pd.DataFrame({"id": frame["id"], "links": links})

    return work


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label are linked if their cosine, in doubles, is at least 0.93.
    ``n_links`` counts the others linked directly, ``component_id`` is the smallest id
    reachable, ``kept`` marks its vector. No pair becomes a row: tasks give the edges
    that connect what they found, then count links inside the groups.

    A vector that is null, empty, zero or holds a null or non-finite number, and any
    without a label, links with nothing; so do vectors of different length. Rows without a key
    have no component and are kept. Rows that share a key are one vector.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    slim = stored(
        vectors.select(
            F.col(key).cast("long").alias("vec_id"),
            F.col(label).cast("long").alias("label"),
            _packed(F.col(vector), kind).alias("vector"),
        ),
        "vectors",
    )
    usable = slim.filter("vec_id is not null and label is not null and vector is not null")
    # equal vectors are one from here on
    distinct = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"))
    heads = stored(distinct, "heads")
    members = usable.join(heads, ["label", "vector"]).select("vec_id", "id", "copies").distinct()

    keyed = stored(heads.select("id", "label", "vector").mapInPandas(_keyed(kind, tables, probes, scale), "id long, cell long, home boolean"), "cells")
    shared = (
        keyed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("any_home"))
        .filter("rows > 1 and any_home")
        .select("cell", "rows")
    )
    meeting = keyed.join(shared, "cell").join(heads.select("id", "vector"), "id")
    tiles = tiled(meeting, "cell", "rows", "id", CELL_ROWS).select("cell", "low", "high", "block", "id", "home", "vector")
    groups = stored(components(tiles.mapInPandas(_cell_edges(kind), "a long, b long")), "groups")

    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    grouped = groups.join(sizes, "component").join(heads.select("id", "copies", "vector"), "id")
    linked = tiled(grouped, "component", "rows", "id", GROUP_ROWS).select(
        "component", "low", "high", "block", "id", "copies", "vector"
    )
    counted = linked.mapInPandas(_group_links(kind), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    found = (
        members.join(counted, "id", "left")
        .join(groups, "id", "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    rest = slim.filter("vec_id is null or label is null or vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
