"""Prefix trie, block search and vector codes against brute force, and their odd inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import block_search, prefix_trie, vector_codes
from cohortlake.llm.common import stored

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df, *names):
    return df.select("*", *[F.lit(name).alias(name) for name in names])


def trie_by_hand(rows):
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [turn[2:] for turn in sorted(turns)] for conv, turns in said.items()}
    nodes, built = {}, {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        # as in SQL, the first of a negative hundred lies towards zero
        built[conv] = own.get(conv - int(math.fmod(conv, 100)), [])[:h] + turns[h:]
        for depth in range(len(built[conv]) + 1):
            nodes.setdefault(tuple(built[conv][:depth]), []).append(conv)
    kids, below, out = {}, {}, []
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    for path in sorted(nodes, key=len, reverse=True):
        children, members = kids.get(path, []), nodes[path]
        saved = (len(members) - 1) * len(path[-1][1]) if path else 0
        leaves = sum(below[c][0] for c in children) if children else 1
        below[path] = leaves, saved + sum(below[c][1] for c in children)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        parent = min(nodes[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(path), parent, len(members), len(children), *below[path], digest))
    return sorted(out, key=str)


def trie_rows(df, **sizes):
    own = stored(prefix_trie.paths(df), "turns")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in prefix_trie.trie_nodes(prefix_trie.rebuilt(own), **sizes).select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed, shard, chunk", [(1, 1, 4), (2, 7, 16), (3, 40, 1000), (4, 100_000, 65_536)])
def test_trie(spark, seed, shard, chunk):
    rnd = random.Random(seed)
    rows = {}
    for _ in range(900):
        conv, turn = rnd.randrange(250), rnd.choice([None, 0, 1, 2, 3, 4, 5])
        rows[conv, turn] = (conv, turn, rnd.choice(["u", "a", None]), rnd.choice(["x", "y", "zz", "é😀", None]))
    rows = list(rows.values())
    assert trie_rows(spark.createDataFrame(rows, TURNS), shard_turns=shard, chunk=chunk) == trie_by_hand(rows)


def test_trie_of_odd_turns(spark):
    long = "wörd " * 200_000
    rows = [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]
    rows += [(5, t, "user", f"turn {t}") for t in range(400)] + [(7, t, "user", f"turn {t}") for t in range(390)]
    rows += [(8, None, None, None), (8, 1, "user", long), (9, 1, "", ""), (9, 1, "", ""), (None, 0, "user", "lost"), (-250, 0, "a", "b")]
    df = clashing(spark.createDataFrame(rows, TURNS), "tokens", "base", "head", "h", "path", "node", "n", "conv", "at", "token")
    assert trie_rows(df, shard_turns=50, chunk=8) == trie_by_hand(rows)
    assert trie_rows(spark.createDataFrame([], TURNS)) == []


def test_trie_lookup():
    def path(*turns):
        return b"".join(hashlib.md5(t.encode()).digest() + len(t).to_bytes(4, "big") for t in turns)

    sequences = sorted(path(*s.split()) for s in ("a b c", "a b", "a d", "e", "b a b", "c c c c"))
    trie = prefix_trie.DoubleArray(sequences)
    states = {trie.find(path(*s.split())) for s in ("a", "a b", "a b c", "a d", "e", "b", "b a", "b a b", "c", "c c", "c c c", "c c c c")}
    assert len(states) == 12 and -1 not in states and trie.find(b"") == 0
    assert {trie.find(path(*s.split())) for s in ("d", "a c", "a b c d", "z")} == {-1}
    assert (trie.check >= 0).sum() == 13


def search_by_hand(rows, k):
    kept = {}
    for one, vector in rows:
        if one is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        codes = np.clip(np.floor(64 * np.array(vector, dtype=np.float32).astype(float)), -(1 << 26), 1 << 26).astype("<i4")
        if one not in kept or codes.tobytes() < kept[one].tobytes():
            kept[one] = codes
    ids = np.array(sorted(kept))
    matrix = np.zeros((len(ids), max(map(len, kept.values()), default=0)), dtype=np.int64)
    for row, one in zip(matrix, ids, strict=True):
        row[: len(kept[one])] = kept[one]
    out = []
    for row, one in zip(matrix, ids, strict=True):
        if one % 20 == 0:
            scores = matrix @ row
            best = [i for i in np.lexsort((ids, -scores)) if ids[i] != one][:k]
            out += [(int(one), rank, int(ids[i]), int(scores[i])) for rank, i in enumerate(best, 1)]
    return sorted(out)


def found(df, k=20, **sizes):
    rows = block_search.top_k(df, lambda ids: ids % 20 == 0, k, **sizes)
    return sorted(tuple(r) for r in rows.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("sizes", [{}, {"segment_rows": 90, "block_rows": 8, "query_rows": 11}, {"segment_rows": 7, "block_rows": 2}])
def test_block_search(spark, sizes):
    random_of = np.random.default_rng(3)
    centres = random_of.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.2 * random_of.normal(size=12)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[40][1]) for i in range(100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    assert found(df, **sizes) == search_by_hand(rows, 20)


def test_block_search_prunes():
    random_of = np.random.default_rng(5)
    codes = np.repeat(random_of.integers(-60, 60, size=(64, 16)), 64, axis=0) + random_of.integers(-2, 3, size=(4096, 16))
    order = block_search.halved(codes)
    segment = block_search.Segment(order, codes[order])
    list(segment.search(np.arange(50), codes[:50], np.full(50, block_search.NO_SCORE), 20))
    assert segment.scored < 50 * 64 / 4


def test_block_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [0.0, 0.0])]
    rows += [(140, []), (160, [1.0, 2.0, 3.0]), (180, [3e38, -3e38]), (None, [1.0, 1.0]), (3, [-0.001, 5.0]), (3, [-0.001, 5.0]), (3, [0.5, 0.5])]
    df = clashing(spark.createDataFrame([(*r, 1) for r in rows], VECTORS), "id", "codes", "place", "segment", "floor", "kind", "vector")
    assert found(df, 3) == search_by_hand(rows, 3)
    assert found(df, 20, segment_rows=2, block_rows=1) == search_by_hand(rows, 20)
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame([(20, [1.0], 1)], VECTORS)) == []


def codes_by_hand(rows, entries, parts=4, rounds=4):
    kept = []
    for one, vector, _ in rows:
        if vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        x = np.array(vector, dtype=np.float32).astype(float)
        whole = np.zeros(-(-len(x) // parts) * parts, dtype=np.int64)
        whole[: len(x)] = np.clip(np.floor(1024 * x), -(1 << 26), 1 << 26)
        kept.append((one, whole))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].astype("<i4").tobytes()))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    points = np.stack([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = points[:entries].transpose(1, 0, 2).copy()
    for done in range(rounds + 1):
        squares = ((points[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        best = squares.argmin(axis=2)
        if done < rounds:
            for p in range(parts):
                for e in np.unique(best[:, p]):
                    books[p, e] = points[best[:, p] == e, p].sum(axis=0) // (best[:, p] == e).sum()
    error = squares.min(axis=2).sum(axis=1)
    out = [(one, "".join(f"{b:02x}" for b in row), int(e)) for (one, _), row, e in zip(kept, best, error, strict=True)]
    return sorted(out, key=str), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(df, **sizes):
    rows, books = vector_codes.compress(df, **sizes)
    return sorted((tuple(r) for r in rows.select("vec_id", "code", "error").collect()), key=str), books and books.digest()


@pytest.mark.parametrize("entries, spread", [(256, 0.5), (16, 0.05), (3, 0.0), (1, 0.3)])
def test_vector_codes(spark, entries, spread):
    random_of = np.random.default_rng(entries)
    centres = random_of.normal(size=(9, 20))
    rows = [(i, (centres[i % 9] + spread * random_of.normal(size=20)).tolist(), i % 3) for i in range(900)]
    assert coded(spark.createDataFrame(rows, VECTORS), entries=entries) == codes_by_hand(rows, entries)


def test_vector_codes_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, [0.1, 0.2, 0.3, 0.4, 0.5], 1), (7, [0.1, 0.2, 0.3, 0.4, 0.5], 1), (9, [-0.1, 0.0, -3e38, 3e38, 1.0], None)]
    rows += [(10, None, 1), (11, [nan] * 5, 1), (12, [inf] * 5, 1), (13, [None] * 5, 1), (14, [1.0, 2.0], 1), (15, [], 2), (None, [0.0] * 5, None)]
    df = clashing(spark.createDataFrame(rows, VECTORS), "codes", "entry", "near", "bounds", "error", "code", "kind", "place")
    assert coded(df) == codes_by_hand(rows, 256)
    assert coded(df, entries=2) == codes_by_hand(rows, 2)
    assert coded(spark.createDataFrame([], VECTORS)) == ([], None)


def test_bounds_save_work():
    """Settled entries need no further distances, and the kept number follows what was needed."""
    random_of = np.random.default_rng(8)
    points = random_of.integers(-500, 500, size=(2000, 8))
    books = points[:50].copy()
    entry, near, bounds, _ = vector_codes.nearest(points, books, 6)
    moved = books + random_of.integers(0, 2, size=books.shape)
    moves = np.sqrt(((moved - books) ** 2).sum(axis=1)) * (1 + vector_codes.SLACK)
    after, _, _, squares, needed = vector_codes.reassigned(points, moved, moves, entry, near, bounds, 4)
    exact = vector_codes.squared(points, moved)
    assert (after == exact.argmin(axis=1)).all() and (squares == exact.min(axis=1)).all()
    assert (needed == 0).mean() > 0.9
    tally = np.bincount(np.where(needed < 0, vector_codes.MOST_KEPT + 1, needed), minlength=vector_codes.MOST_KEPT + 2)
    assert vector_codes._adapted(tally[None], [6], 49) == [vector_codes.LEAST_KEPT]
