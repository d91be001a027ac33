"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of shingles of five words, summed up by MinHash values. Texts that
agree in a band of values are candidates. Their values are compared a few at a time:
from the number that agree follows, with an even prior, the probability that the
similarity reaches the threshold, and a pair is dropped as soon as that probability is
below a tolerance. What is left is verified on the shingles themselves.

No pair ever becomes a row. Tasks work on whole buckets, cut into tiles where they are
large, and give only the edges that connect what they found; the groups so formed are
then verified pair by pair inside the tasks, which give one row per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import spare_name, stored
from cohortlake.llm.components import components
from cohortlake.llm.textarrays import Hasher, code_points, mix, owners, runs, windows, word_bounds
from cohortlake.llm.tiles import local_roots, tile_pairs, tiled, whole_tiles

SHINGLE_WORDS = 5
THRESHOLD = 0.8
# 20 bands of 4 values miss a pair at the threshold once in 38,000; 48 further values
# serve the comparison alone.
VALUES = 128
BANDS = 20
BAND_VALUES = 4
STEP = 16
TOLERANCE = 1e-6
# Rows of a tile, before and after pruning; pairs looked at in one go.
BUCKET_ROWS = 512
GROUP_ROWS = 256
PAIRS = 400_000
# Bytes of shingle hashes in a block of a tile, and in the tiles verified in one go.
BLOCK_BYTES = 4 << 20
BYTES = 8 << 20


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Agreeing values needed after each step for the pair to stay.

    With m of n values equal and an even prior, the similarity has a beta
    distribution; its upper tail at the threshold is a binomial sum.
    """
    needed = []
    for n in range(STEP, VALUES + 1, STEP):
        tail = 0.0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                needed.append(m)
                break
    return needed


def shingles(texts: Sequence[str], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and their texts. A short text is one shingle."""
    codes, starts = code_points(texts)
    first, end = word_bounds(codes)
    return windows(hasher.words(codes, first, end), owners(starts, first), SHINGLE_WORDS, len(texts))


def signatures(texts: Sequence[str], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of each text, and whether it has any word."""
    values, owner = shingles(texts, hasher)
    filled, edges = np.unique(owner, return_index=True)
    out = np.zeros((len(texts), VALUES), dtype=np.uint32)
    factors = mix(np.arange(VALUES, dtype=np.uint64), 31) | np.uint64(1)
    if len(filled):
        for i, factor in enumerate(factors):
            out[filled, i] = np.minimum.reduceat(values * factor, edges) >> np.uint64(32)
    has = np.zeros(len(texts), dtype=bool)
    has[filled] = True
    return out, has


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per text and band."""
    keys = np.zeros((len(values), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        for k in range(BAND_VALUES):
            column = values[:, band * BAND_VALUES + k].astype(np.uint64)
            keys[:, band] = mix(keys[:, band] + column, 40 + band)
    return keys.view(np.int64)


def sketch(text: Column) -> Column:
    """Whether a text has words, its band keys and 16 bits of each MinHash value."""

    @F.pandas_udf("has boolean, bands array<long>, sketch binary")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            has_all, bands, short = [], [], []
            for _, some in runs([t if isinstance(t, str) else "" for t in batch]):
                values, has = signatures(some, hasher)
                has_all.extend(has.tolist())
                bands.extend(list(band_keys(values)))
                short.extend([row.tobytes() for row in (values & 0xFFFF).astype("<u2")])
            yield pd.DataFrame({"has": pd.Series(has_all, dtype=bool), "bands": bands, "sketch": short})

    return work(text)


def likely(sketches: np.ndarray, left: np.ndarray, right: np.ndarray, needed: Sequence[int]) -> np.ndarray:
    """Places of the pairs that stay after comparing their values step by step."""
    stay = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    for step, least in enumerate(needed):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (sketches[left[stay], part] == sketches[right[stay], part]).sum(axis=1)
        good = matches >= least
        stay, matches = stay[good], matches[good]
    return stay


def _candidates(frame: pd.DataFrame, sizes: np.ndarray, needed: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Likely pairs of each tile, in chunks."""
    sketches = np.frombuffer(b"".join(frame["sketch"]), dtype="<u2").reshape(len(frame), VALUES)
    left, right = tile_pairs(sizes)
    block = frame["block"].to_numpy()
    # in a tile of two blocks, pairs inside a block belong to another tile
    count = (block[left] != block[right]) | (frame["low"].to_numpy() == frame["high"].to_numpy())[left]
    left, right = left[count], right[count]
    for at in range(0, len(left), PAIRS):
        a, b = left[at : at + PAIRS], right[at : at + PAIRS]
        stay = likely(sketches, a, b, needed)
        yield a[stay], b[stay], sketches


def _bucket_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    needed = least_matches()
    for frame, sizes in whole_tiles(batches, ["bucket", "low", "high"], PAIRS):
        found = [(a, b) for a, b, _ in _candidates(frame, sizes, needed)]
        root = local_roots(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), len(frame)) if found else np.arange(len(frame))
        moved = np.flatnonzero(root != np.arange(len(frame)))
        ids = frame["id"].to_numpy()
        yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]}).query("a != b").drop_duplicates()


def _overlaps(ids: np.ndarray, edges: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of each pair; ``left`` must be sorted."""
    out = np.zeros(len(left), dtype=np.int64)
    flag = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.int32)
    firsts = np.flatnonzero(np.diff(left, prepend=-1))
    for begin, end in zip(firsts, [*firsts[1:], len(left)], strict=True):
        one = left[begin]
        own = ids[edges[one] : edges[one + 1]]
        flag[own] = 1
        partners = right[begin:end]
        flat = np.concatenate([ids[edges[p] : edges[p + 1]] for p in partners])
        lengths = edges[partners + 1] - edges[partners]
        out[begin:end] = np.add.reduceat(flag[flat], np.cumsum(lengths) - lengths)
        flag[own] = 0
    return out


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted distinct shingle hashes in place of the texts."""
    hasher = Hasher()
    for batch in batches:
        hashes = []
        for _, some in runs(batch["text"].tolist()):
            values, owner = shingles(some, hasher)
            edges = np.searchsorted(owner, np.arange(len(some) + 1))
            hashes += [np.unique(values[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        yield batch.drop(columns="text").assign(hashes=hashes)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    needed = least_matches()
    for frame, sizes in whole_tiles(batches, ["component", "low", "high"], PAIRS, "hashes", BYTES):
        count = frame["hashes"].str.len().to_numpy(dtype=np.int64) // 8
        edges = np.concatenate([[0], np.cumsum(count)])
        ids = np.unique(np.frombuffer(b"".join(frame["hashes"]), dtype=np.uint64), return_inverse=True)[1].astype(np.int32)
        copies = frame["copies"].to_numpy()
        links = np.zeros(len(frame), dtype=np.int64)
        lefts, rights = [], []
        for a, b, _ in _candidates(frame, sizes, needed):
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            common = _overlaps(ids, edges, a, b)
            good = common / np.maximum(count[a] + count[b] - common, 1) >= THRESHOLD
            a, b = a[good], b[good]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            lefts.append(a)
            rights.append(b)
        root = local_roots(np.concatenate(lefts), np.concatenate(rights), len(frame)) if lefts else np.arange(len(frame))
        key = frame["id"].to_numpy()
        yield pd.DataFrame({"id": key, "links": links, "root": key[root]})


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, kept``.

    Documents are linked if at least 0.8 of their shingles, five words each, are
    common. ``class_id`` is the smallest id reachable by links, ``n_links`` counts the
    other documents linked directly, copies included, and ``kept`` marks the document
    whose id the class has. Words are runs without white space and count as written.

    Documents without a word, null texts among them, link with nothing. Rows without
    a key get no class and are kept. Rows that share a key are one document.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = slim.filter("doc_id is not null")
    sketched = stored(
        known.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("hash"), sketch(F.col("text")).alias("s")).select(
            "doc_id", "hash", "s.*"
        ),
        "sketches",
    )
    # exact copies are one text from here on
    texts = sketched.filter("has").groupBy("hash").agg(F.min("doc_id").alias("id"), F.count_distinct("doc_id").alias("copies"))
    members = stored(
        sketched.select("doc_id", "hash").join(texts, "hash", "left").select("doc_id", "id", "copies").distinct(), "members"
    )
    heads = members.filter("doc_id = id").select("id", "copies").distinct()
    first = sketched.join(heads, sketched["doc_id"] == heads["id"])

    keyed = first.select("id", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    in_buckets = keyed.join(shared, "bucket").join(first.select("id", "sketch"), "id")
    edges = tiled(in_buckets, "bucket", "rows", "id", BUCKET_ROWS).select("bucket", "low", "high", "block", "id", "sketch")
    groups = stored(components(edges.mapInPandas(_bucket_edges, "a long, b long")), "groups")

    grouped = groups.join(first.select("id", "copies", "sketch"), "id")
    with_text = grouped.join(known.filter("text is not null"), grouped["id"] == known["doc_id"])
    hashed = stored(
        with_text.select("component", "id", "copies", "sketch", "text").mapInPandas(
            _hashed, "component long, id long, copies long, sketch binary, hashes binary"
        ),
        "hashes",
    )
    sizes = hashed.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("hashes")).alias("bytes"))
    checked = tiled(hashed.join(sizes, "component"), "component", "rows", "id", GROUP_ROWS, "bytes", BLOCK_BYTES).select(
        "component", "low", "high", "block", "id", "copies", "sketch", "hashes"
    )
    links = stored(checked.mapInPandas(_verified, "id long, links long, root long"), "links")
    joined = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))

    by_text = members.join(counted, "id", "left").join(joined, "id", "left")
    out = by_text.select(
        "doc_id",
        F.coalesce("component", "id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )
    nameless = slim.filter("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the documents that stand for their class, with their own columns.

    Of rows that share a key one stays, chosen by a hash of the text. Rows without a key stay.
    """
    kept_id, turn = spare_name(docs, "kept_id"), spare_name(docs, "turn")
    found = near_classes(docs, key, text).filter("kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)).distinct()
    same = Window.partitionBy(kept_id).orderBy(F.xxhash64(text))
    chosen = (
        docs.join(found, docs[key].cast("long") == found[kept_id])
        .withColumn(turn, F.row_number().over(same))
        .filter(F.col(turn) == 1)
        .select(docs.columns)
    )
    return chosen.unionByName(docs.filter(docs[key].isNull()))
