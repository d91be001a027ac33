"""Matching against turn-by-turn play, in one block and in many."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

from cohortlake.operators import matching
from cohortlake.operators.matching import match_nearest
from cohortlake.plans.queries import study

SCHEMA = "person_id string, data_partner_id int, has_lsd int, score double"


def play(rows):
    pairs = set()
    for partner in {row[1] for row in rows}:
        free = [r for r in rows if r[1] == partner and r[2] == 0]
        exposed = sorted((r for r in rows if r[1] == partner and r[2] == 1), key=lambda r: (-r[3], r[0]))
        for one in exposed:
            if not free:
                break
            best = min(free, key=lambda c: (abs(c[3] - one[3]), c[3], c[0]))
            free.remove(best)
            pairs.add((one[0], best[0]))
    return pairs


def matched_pairs(df):
    by_pair = {}
    for row in df.collect():
        by_pair.setdefault((row.subclass, row.data_partner_id), {})[row.has_lsd] = row.person_id
    assert all(set(pair) == {0, 1} for pair in by_pair.values())
    return {(pair[1], pair[0]) for pair in by_pair.values()}


def population(seed, share, values, size=250):
    rnd = random.Random(seed)
    partners = [1, 1, 1, 1, 2, 3]
    return [
        (f"p{i:04d}", rnd.choice(partners), int(rnd.random() < share), float(rnd.randint(0, values)))
        for i in range(size)
    ]


@pytest.mark.parametrize(
    "seed, share, values, block_rows, group_limit",
    [
        (1, 0.3, 40, 200_000, 2_000_000),
        (2, 0.3, 10**6, 200_000, 2_000_000),
        (3, 0.3, 10**6, 25, 10),
        (4, 0.6, 60, 9, 10),
    ],
)
def test_same_as_turn_by_turn(spark, seed, share, values, block_rows, group_limit):
    rows = population(seed, share, values)
    df = spark.createDataFrame(rows, SCHEMA)
    got = matched_pairs(match_nearest(df, block_rows=block_rows, group_limit=group_limit))
    assert got == play(rows)


def test_one_score_for_all(spark):
    rows = [(f"p{i:03d}", 1, int(i % 3 == 0), 0.5) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert matched_pairs(match_nearest(df, group_limit=7)) == play(rows)


def test_controls_all_on_one_side(spark):
    """Far blocks must still find the only free controls."""
    rows = [(f"t{i:02d}", 1, 1, float(i)) for i in range(20)] + [(f"c{i:02d}", 1, 0, 100.0 + i) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert matched_pairs(match_nearest(df, block_rows=4)) == play(rows)


def test_gaps_and_strata_without_partners(spark):
    rows = [("a", 1, 1, 0.5), ("b", 2, 0, 0.5), ("c", None, 1, 0.5), ("d", 2, 1, None), ("e", 2, 0, float("nan"))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert match_nearest(df).count() == 0


def test_cohort_properties(spark, small_dir):
    s = study(spark, small_dir, matched=True)
    matched = s.matched_persons.collect()
    ids = [row.person_id for row in matched]
    assert len(ids) == len(set(ids))
    per_partner = {}
    for row in s.covariates.collect():
        per_partner.setdefault(row.data_partner_id, [0, 0])[row.has_lsd] += 1
    expected = sum(min(counts) for counts in per_partner.values())
    assert len(ids) == 2 * expected
    assert s.cohort.count() == len(ids)


def test_changed_blocks(spark):
    from cohortlake.operators.matching import _changed
    from cohortlake.session import cut_lineage

    schema = "stratum int, block int, n long"
    first = cut_lineage(spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 1, 6), (2, 3, 7)], schema))
    same = cut_lineage(first.filter("block < 2").union(first.filter("block > 2")))
    assert _changed(first, same).collect() == []
    fewer = cut_lineage(first.filter("block <> 1").union(spark.createDataFrame([(1, 1, 6)], schema)))
    assert {tuple(row) for row in _changed(first, fewer).collect()} == {(1, 1)}


def test_workers_need_no_installed_package(small_dir, tmp_path):
    """Started elsewhere, Python workers cannot import the package by its folder."""
    repo = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as driver
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert driver.queries()["match_nearest"](spark, {small_dir!r}).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)


@pytest.mark.parametrize("seed, ratio", [(1, 20), (2, 20), (3, 3), (4, 1)])
def test_more_exposed_than_controls(spark, monkeypatch, seed, ratio):
    """Many blocks of unmet wants: few plays, and what is sent grows with the blocks alone."""
    rnd = random.Random(seed)
    rows = [(f"p{i:04d}", 1, int(rnd.random() < ratio / (ratio + 1)), float(rnd.randint(0, 10**6))) for i in range(960)]
    plays = []
    around = matching._neighbours

    def counted(blocks, takes, since):
        links = around(blocks, takes, since)
        plays.append(len(links))
        return links

    monkeypatch.setattr(matching, "_neighbours", counted)
    got = matched_pairs(match_nearest(spark.createDataFrame(rows, SCHEMA), block_rows=40))
    assert got == play(rows)
    assert plays[0] <= 6 * 24
    if ratio == 20:
        assert len(plays) <= 4 and max(plays) <= 4 * 24


def test_wants_pass_to_later_blocks():
    shelf = matching._Shelf([0, 3, 1, 0, 4])
    shelf.meet(0, 5)
    assert shelf.left == [0, 0, 0, 0, 3] and shelf.from_(0) == 4 and shelf.upto(3) == -1
    assert matching._around(shelf, 2, 1) == [(4, 1)]
    shelf.meet(4, 2)
    shelf.meet(4, 2)
    assert shelf.left == [0] * 5 and shelf.from_(0) == 5 and shelf.upto(4) == -1
    assert matching._around(shelf, 2, 9) == []
    before = matching._Shelf([2, 2, 0])
    before.meet(2, 3)
    assert before.left == [1, 0, 0]
