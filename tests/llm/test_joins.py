"""Near-duplicate texts and vectors against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from cohortlake.llm import jaccard_join, lattice, queries, tiles
from cohortlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def closed(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def all_pairs(rows):
    sets = {doc: shingle_set(text) for doc, text in rows}
    links = []
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
            links.append((a, b))
    return closed(links, sets), links


def check(found, rows):
    classes, links = all_pairs(rows)
    count = dict.fromkeys(classes, 0)
    for pair in links:
        for one in pair:
            count[one] += 1
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in found}
    assert got == {i: (classes[i], count[i], classes[i] == i) for i in classes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5, 5), (7, None)]
    ids = {i for edge in edges if None not in edge and edge[0] != edge[1] for i in edge}
    expected = closed([e for e in edges if None not in e], {i for e in edges for i in e if i is not None})
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(ids)
    assert {r["id"]: r["component"] for r in got} == {i: expected[i] for i in ids}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tile_pairs():
    left, right = tiles.tile_pairs(np.array([3, 1, 2]))
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert tiles.local_roots(np.array([3, 1]), np.array([1, 2]), 5).tolist() == [0, 1, 1, 1, 4]


def test_least_matches_follow_the_posterior():
    needed = jaccard_join.least_matches(0.8, 1e-6)
    assert len(needed) == jaccard_join.VALUES // jaccard_join.STEP
    assert needed == sorted(needed) and 0 < needed[0] and needed[-1] < 0.8 * jaccard_join.VALUES
    assert jaccard_join.least_matches(0.8, 0.01)[-1] > needed[-1]


def test_documents(spark, documents):
    check(jaccard_join.near_classes(documents[0]).collect(), [(r[0], r[1]) for r in documents[1]])


@pytest.mark.parametrize("limit", [8, 1024])
def test_group_in_tiles(spark, limit, monkeypatch):
    """One large group of near copies and one of exact copies, cut into many tiles."""
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", limit)
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", limit)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, "same words " * 30) for i in range(20)]
    rows += [(200 + i, f"alone {i} " + " ".join(f"y{rng.randrange(10_000)}" for _ in range(50))) for i in range(10)]
    check(jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)


def test_odd(spark, odd_docs, odd_rows, no_docs):
    got = {r["doc_id"]: r for r in jaccard_join.near_classes(odd_docs).collect() if r["doc_id"] is not None}
    assert got[2]["class_id"] == 1 and got[3]["class_id"] == 1 and got[1]["n_links"] == 2
    assert all(got[i]["class_id"] == i and got[i]["n_links"] == 0 for i in (4, 5, 6, 8, 9, 12))
    kept = jaccard_join.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 8, 9, 10, 11, 12, None, None], key=str)
    assert jaccard_join.near_classes(no_docs).collect() == [] and jaccard_join.deduplicate(no_docs).collect() == []


def test_decode_is_nearest():
    points = np.random.default_rng(6).normal(size=(200, 8)) * 2
    found = lattice.decode(points)
    whole = np.all(found == np.rint(found), axis=1)
    assert np.all(whole | np.all(found - 0.5 == np.rint(found - 0.5), axis=1))
    assert np.all(found.sum(axis=1) % 2 == 0)
    steps = lattice.shortest_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    own = ((points - found) ** 2).sum(axis=1)
    others = ((points[:, None, :] - found[:, None, :] - steps[None]) ** 2).sum(axis=2).min(axis=1)
    assert np.all(own <= others + 1e-12)


def brute_vectors(rows):
    links = []
    for (a, x, la), (b, y, lb) in combinations(rows, 2):
        if la is None or la != lb or x is None or y is None or len(x) != len(y):
            continue
        x, y = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            continue
        if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
            links.append((a, b))
    return links


def check_vectors(found, rows):
    links = brute_vectors(rows)
    classes = closed(links, [r[0] for r in rows])
    count = dict.fromkeys(classes, 0)
    for pair in links:
        for one in pair:
            count[one] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert got == {i: (count[i], classes[i], classes[i] == i) for i in classes}
    return links


@pytest.mark.parametrize("limit", [8, 512])
def test_vectors(spark, limit, monkeypatch):
    monkeypatch.setattr(lattice, "CELL_ROWS", limit)
    monkeypatch.setattr(lattice, "GROUP_ROWS", limit)
    rng = np.random.default_rng(8)
    rows = []
    for centre in range(25):
        middle = rng.normal(size=64)
        for _ in range(8):
            noise = rng.normal(size=64) * 0.2
            rows.append((len(rows), (middle + noise).astype(np.float32).tolist(), centre % 3))
    rows += [(500 + i, rows[0][1], 0) for i in range(30)] + [(600, [2 * x for x in rows[0][1]], 0), (601, rows[0][1], 1)]
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(check_vectors(found, rows)) > 400


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold meet in at least one table."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= a * (a * b).sum(axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(len(a), dtype=bool)
    for table in range(lattice.TABLES):
        x, y = lattice.cells(a, table), lattice.cells(b, table)
        met |= (x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)
    assert met.mean() > 0.99


def test_odd_vectors(spark):
    one = [1.0] + [0.0] * 7
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, one, 0), (2, one, 0), (3, one, None), (4, None, 0), (5, [0.0] * 8, 0), (6, [nan] * 8, 0), (7, [inf] + one[1:], 0),
        (8, [None, *one[1:]], 0), (9, one[:7], 0), (10, [1e300] + one[1:], 0), (11, [], 0), (12, [-0.0, *one[:-1]], 0),
    ]
    schema = "vec_id long, embedding array<double>, label int"
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: (2, 1) if i in (1, 2, 10) else (0, i) for i in range(1, 13)}
    repeated = spark.createDataFrame([(1, one, 0), (1, one, 0), (None, one, 0)], schema)
    assert sorted(map(str, (tuple(r) for r in lattice.near_vectors(repeated).collect()))) == ["(1, 0, 1, True)", "(None, 0, None, True)"]
    assert lattice.near_vectors(spark.createDataFrame([], schema)).collect() == []


def test_query(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    check_vectors(queries.op10_lattice(spark, small_dir).collect(), rows)


def test_tiles_are_bounded_by_bytes(spark):
    """A group of long texts is cut by its bytes, each pair of its rows still in exactly one tile."""
    rows = [(1, i, 12, 12 * 1000) for i in range(12)] + [(2, i, 3, 30) for i in range(3)]
    df = spark.createDataFrame(rows, "component long, id long, rows long, bytes long")
    found = {}
    for row in tiles.tiled(df, "component", "rows", "id", 256, "bytes", 2500).collect():
        found.setdefault((row.component, row.low, row.high), []).append((row.block, row.id))
    seen = {}
    for (component, low, high), members in found.items():
        for (block, one), (other_block, other) in combinations(members, 2):
            if low == high or block != other_block:
                seen[component, min(one, other), max(one, other)] = seen.get((component, min(one, other), max(one, other)), 0) + 1
    wanted = {(1, a, b) for a, b in combinations(range(12), 2)} | {(2, a, b) for a, b in combinations(range(3), 2)}
    assert set(seen) == wanted and set(seen.values()) == {1}
    assert len([t for t in found if t[0] == 1]) > 3 and len([t for t in found if t[0] == 2]) == 1


def test_frames_are_bounded_by_bytes():
    frame = pd.DataFrame({"component": [1, 1, 2, 2, 3, 3, 4, 4], "low": 0, "high": 0, "hashes": [b"x" * 100] * 8})
    cut = [len(f) for f, _ in tiles.whole_tiles(iter([frame.iloc[:3], frame.iloc[3:]]), ["component", "low", "high"], 10**6, "hashes", 450)]
    assert cut == [2, 4, 2]


def test_long_near_copies(spark):
    """Long texts of one class: hashes, not texts, meet in the tiles."""
    words = [f"w{i % 5003}" for i in range(40_000)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(40)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (0, 39) for i in range(40)}
