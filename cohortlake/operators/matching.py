"""Exact-stratum nearest matching without replacement, for strata of any size.

The rule: within a stratum the exposed take turns from the highest score down,
ties by id; each takes the free control nearest in score. Of two controls
equally near the lower-scored one wins, of equal scores the smaller id.

How it runs: persons with one (stratum, score) are interchangeable up to their
rank, so the turns are played on counts per distinct score. The distinct scores
of a stratum are cut into blocks along the order of turns. A block only depends
on what blocks before it took; all blocks are played at once against the last
known state and replayed until nothing changes, which gives the same result as
playing them one after the other. A task sees one block and the nearest free
controls around it, never a whole stratum.

What blocks before it took is foreseen for the first play from one line per block,
how many are wanted and how many are there. As turns go from high to low, the controls
taken below a block are always a run without gaps from the block's upper end on: a
control can only be taken from above once all those over it are gone. So a count tells
which they are, and where exposed outnumber controls, wants that a block cannot meet
pass like open brackets to the blocks after it. Long stretches of such blocks are right
at the first play, and a block that finds nothing free around it gets nothing sent.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cohortlake.operators.ranks import GROUP_LIMIT, running_total
from cohortlake.session import cut_lineage

# Executors need not have this package installed: its function travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 200_000
UNIT_CHUNK = 100_000


def _play_turns(rows: pd.DataFrame) -> pd.DataFrame:
    """Turns of one block: rows of (score, wanted, free, used, home) to takes."""
    rows = rows.sort_values("score", ascending=False, ignore_index=True)
    scores, wanted = rows["score"].tolist(), rows["wanted"].tolist()
    free, used, home = rows["free"].tolist(), rows["used"].tolist(), rows["home"].tolist()
    size = len(scores)
    # next possibly free place upwards / downwards, shifted by one for the ends
    above, below = list(range(size + 2)), list(range(size + 2))

    def seek(links: list[int], place: int, step: int) -> int:
        path = []
        while 0 < place <= size and free[place - 1] == 0:
            path.append(place)
            place = links[place] if links[place] != place else place + step
        for passed in path:
            links[passed] = place
        return place

    takes = []
    for turn in range(size):
        need, start = wanted[turn], 0
        while need > 0:
            up, down = seek(above, turn + 1, -1) - 1, seek(below, turn + 1, 1) - 1
            if up < 0 and down >= size:
                break
            if up < 0:
                chosen = down
            elif down >= size:
                chosen = up
            else:
                chosen = down if scores[turn] - scores[down] <= scores[up] - scores[turn] else up
            count = min(need, free[chosen])
            takes.append((scores[turn], start, scores[chosen], used[chosen], count, home[chosen]))
            free[chosen] -= count
            used[chosen] += count
            start += count
            need -= count
    return pd.DataFrame(takes, columns=["score_t", "start_t", "score_c", "start_c", "n", "home"])


class _Shelf:
    """Free controls by block, with the next block that has any in both directions."""

    def __init__(self, present: list[int]) -> None:
        self.present, self.left = present, list(present)
        # places are shifted by one, so that both ends are places as well
        self.after, self.before = list(range(len(present) + 2)), list(range(len(present) + 2))
        for block, count in enumerate(present):
            if not count:
                self._close(block)

    def _close(self, block: int) -> None:
        self.after[block + 1], self.before[block + 1] = block + 2, block

    def _seek(self, links: list[int], place: int) -> int:
        path = []
        while links[place] != place:
            path.append(place)
            place = links[place]
        for passed in path:
            links[passed] = place
        return place - 1

    def from_(self, block: int) -> int:
        """The first block from this one on with a free control; the number of blocks if there is none."""
        return self._seek(self.after, block + 1)

    def upto(self, block: int) -> int:
        """The last block up to this one with a free control; -1 if there is none."""
        return self._seek(self.before, block + 1)

    def take(self, block: int, count: int) -> None:
        self.left[block] -= count
        if not self.left[block]:
            self._close(block)

    def meet(self, block: int, wanted: int) -> None:
        """Take what a block wants from itself and those after it, then from those before."""
        for seek in (lambda: self.from_(block), lambda: self.upto(block - 1)):
            at = seek()
            while wanted and 0 <= at < len(self.present):
                count = min(wanted, self.left[at])
                self.take(at, count)
                wanted -= count
                at = seek()


def _around(shelf: _Shelf, block: int, wanted: int) -> list[tuple[int, int]]:
    """Blocks that can hold the nearest free controls of a block, and how many of theirs are gone."""
    found = []
    for at, step in ((shelf.from_(block + 1), 1), (shelf.upto(block - 1), -1)):
        missing = wanted
        while missing > 0 and 0 <= at < len(shelf.present):
            found.append((at, shelf.present[at] - shelf.left[at]))
            missing -= shelf.left[at]
            at = shelf.from_(at + 1) if step > 0 else shelf.upto(at - 1)
    return found


def _neighbours(blocks: DataFrame, takes: DataFrame | None, since: dict) -> list[tuple]:
    """For each block to play: the other blocks that can hold its nearest free controls.

    Works on one line per block, the totals of wanted, present and taken, and
    only for strata that have more than one block. Each link also says how many
    controls of the other block, and of the block itself, are gone before its play.
    Without ``takes`` these are foreseen.
    """
    wide = blocks.filter("block > 0").select("stratum").distinct()
    totals = blocks.join(wide, "stratum", "left_semi").groupBy("stratum", "block").agg(F.sum("n_c"), F.sum("n_t"))
    present, wants = defaultdict(dict), defaultdict(dict)
    for stratum, block, controls, exposed in totals.toLocalIterator():
        present[stratum][block], wants[stratum][block] = controls, exposed
    taken = defaultdict(list)
    if takes is not None:
        sums = takes.join(wide, "stratum", "left_semi").groupBy("stratum", "block", "home").agg(F.sum("n"))
        for stratum, block, home, n in sums.toLocalIterator():
            taken[stratum, block].append((home, n))
    links = []
    for stratum, exposed_by_block in wants.items():
        last = max(exposed_by_block)
        shelf = _Shelf([present[stratum][block] for block in range(last + 1)])
        for block in range(last + 1):
            exposed = exposed_by_block[block]
            if exposed and block > since.get(stratum, last):
                links.append((stratum, block, block, shelf.present[block] - shelf.left[block]))
                links += [(stratum, home, block, gone) for home, gone in _around(shelf, block, exposed)]
            if takes is None:
                shelf.meet(block, exposed)
            for home, n in taken[stratum, block]:
                shelf.take(home, n)
    return links


def _play_round(blocks: DataFrame, takes: DataFrame | None, since: dict) -> DataFrame:
    """Play the blocks after ``since`` of each stratum against the state left by those before them.

    Without ``takes`` it is the first round, in which all blocks play.
    """
    spark = blocks.sparkSession
    stratum, whole = blocks.schema["stratum"], IntegerType()
    linked = StructType([stratum, StructField("home", whole), StructField("block", whole), StructField("gone", LongType())])
    links = spark.createDataFrame(_neighbours(blocks, takes, since), linked)
    homes = blocks.withColumnRenamed("block", "home")
    if takes is None:
        # strata of one block have no links; elsewhere the first controls of a block are those foreseen to be gone
        single = homes.join(links.select("stratum").distinct(), "stratum", "left_anti").withColumn("block", F.col("home"))
        above = Window.partitionBy("stratum", "home").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        over = F.coalesce(F.sum("n_c").over(above), F.lit(0))
        near = homes.withColumn("over", over).join(links, ["stratum", "home"])
        used = F.least("n_c", F.greatest(F.col("gone") - F.col("over"), F.lit(0)))
        rows = single.withColumn("used", F.lit(0).cast("long")).unionByName(near.withColumn("used", used.cast("long")).drop("over", "gone"))
    else:
        links = links.filter("home <> block").drop("gone")
        marks = spark.createDataFrame(list(since.items()), StructType([stratum, StructField("since", whole)]))
        playing = homes.join(marks, "stratum")
        own = playing.filter("home > since").withColumn("block", F.col("home")).drop("since")
        rows = own.unionByName(homes.join(links, ["stratum", "home"]))
        own_links = own.select(*links.columns).distinct()
        gone = (
            takes.withColumnRenamed("block", "by")
            .join(links.unionByName(own_links), ["stratum", "home"])
            .filter(F.col("by") < F.col("block"))
            .groupBy("stratum", "block", F.col("score_c").alias("score"))
            .agg(F.sum("n").alias("used"))
        )
        rows = rows.join(gone, ["stratum", "block", "score"], "left").withColumn(
            "used", F.coalesce("used", F.lit(0).cast("long"))
        )
    rows = rows.select(
        "stratum",
        "block",
        "home",
        "score",
        F.when(F.col("home") == F.col("block"), F.col("n_t")).otherwise(0).alias("wanted"),
        (F.col("n_c") - F.col("used")).alias("free"),
        "used",
    ).filter("wanted > 0 or free > 0")
    schema = StructType([stratum, StructField("block", whole)])
    for column in ("score_t double", "start_t long", "score_c double", "start_c long", "n long", "home integer"):
        schema = schema.add(*column.split())

    def play(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        takes = _play_turns(pdf)
        takes.insert(0, "stratum", [key[0]] * len(takes))
        takes.insert(1, "block", key[1])
        return takes

    return rows.groupBy("stratum", "block").applyInPandas(play, schema)


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Stratum and block of the takes that only one of the two states has.

    Each take is counted +1 in one state and -1 in the other. Fresh column names
    keep the two apart, since a checkpoint keeps the column ids of its source.
    """
    names = before.columns
    signed = [
        state.select(*[F.col(name).alias(f"_{name}") for name in names], F.lit(sign).alias("_sign"))
        for state, sign in ((before, -1), (after, 1))
    ]
    uneven = signed[0].union(signed[1]).groupBy(*[f"_{name}" for name in names]).agg(F.sum("_sign").alias("_sum"))
    return uneven.filter("_sum <> 0").select(F.col("_stratum").alias("stratum"), F.col("_block").alias("block"))


def _settle(blocks: DataFrame) -> DataFrame:
    """Takes of all blocks, replayed until no block has anything to change.

    A block is replayed only after one before it has changed. Every round
    settles at least one more block of each stratum.
    """
    first = blocks.filter("block > 0").select("stratum").distinct().collect()
    since = {row["stratum"]: -1 for row in first}
    takes = cut_lineage(_play_round(blocks, None, since))
    since = dict.fromkeys(since, 0)
    while since:
        marks = blocks.sparkSession.createDataFrame(
            list(since.items()), StructType([blocks.schema["stratum"], StructField("since", IntegerType())])
        )
        settled = takes.join(marks, "stratum", "left").filter("since is null or block <= since").select(takes.columns)
        again = cut_lineage(settled.unionByName(_play_round(blocks, takes, since)))
        moved = _changed(takes, again).join(marks, "stratum").filter("block > since")
        moved = moved.groupBy("stratum").agg(F.min("block"))
        since = {stratum: block for stratum, block in moved.collect()}
        takes = again
    return takes


def match_nearest(
    df: DataFrame,
    treat: str = "has_lsd",
    score: str = "score",
    exact: str = "data_partner_id",
    id: str = "person_id",
    block_rows: int = BLOCK_ROWS,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Matched persons, one exposed and one control per ``subclass`` (the exposed id)."""
    people = cut_lineage(
        df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(exact).isNotNull()).select(
            F.col(id).alias("id"),
            F.col(exact).alias("stratum"),
            F.col(treat).cast("int").alias("exposed"),
            F.col(score).cast("double").alias("score"),
        )
    )
    counts = people.groupBy("stratum", "score").agg(
        F.count_if(F.col("exposed") == 1).alias("n_t"), F.count_if(F.col("exposed") == 0).alias("n_c")
    )
    placed = running_total(counts, ["stratum"], [F.desc("score")], F.lit(1), "place", group_limit)
    blocks = cut_lineage(
        placed.select("stratum", "score", "n_t", "n_c", F.floor((F.col("place") - 1) / block_rows).cast("int").alias("block"))
    )
    takes = _settle(blocks)

    # takes hold runs of turns; unfold them to single pairs in two steps, so that
    # one long run is spread before it becomes rows
    runs = takes.select(
        "stratum",
        "score_t",
        "start_t",
        "score_c",
        "start_c",
        "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(UNIT_CHUNK).cast("long"))).alias("at"),
    )
    runs = runs.repartition("stratum", "score_t", "start_t", "at")
    steps = F.sequence(F.col("at"), F.least(F.col("at") + UNIT_CHUNK, F.col("n")) - 1)
    units = runs.select("*", F.explode(steps).alias("step")).select(
        "stratum",
        "score_t",
        (F.col("start_t") + F.col("step") + 1).alias("rank_t"),
        "score_c",
        (F.col("start_c") + F.col("step") + 1).alias("rank_c"),
    )
    # only persons whose score was taken from or played need a rank
    played = takes.select("stratum", F.col("score_t").alias("score"), F.lit(1).alias("exposed")).union(
        takes.select("stratum", F.col("score_c").alias("score"), F.lit(0).alias("exposed"))
    )
    candidates = people.join(played.distinct(), ["stratum", "score", "exposed"], "left_semi")
    ranked = running_total(candidates, ["stratum", "score", "exposed"], ["id"], F.lit(1), "rank", group_limit)
    exposed = ranked.filter("exposed = 1").select(
        "stratum", F.col("score").alias("score_t"), F.col("rank").alias("rank_t"), F.col("id").alias("id_t")
    )
    controls = ranked.filter("exposed = 0").select(
        "stratum", F.col("score").alias("score_c"), F.col("rank").alias("rank_c"), F.col("id").alias("id_c")
    )
    pairs = units.join(exposed, ["stratum", "score_t", "rank_t"]).join(controls, ["stratum", "score_c", "rank_c"])
    both = F.array(
        F.struct(F.col("id_t").alias("id"), F.lit(1).alias("exposed"), F.col("score_t").alias("score")),
        F.struct(F.col("id_c").alias("id"), F.lit(0).alias("exposed"), F.col("score_c").alias("score")),
    )
    return pairs.select("stratum", F.col("id_t").alias("subclass"), F.inline(both)).select(
        F.col("id").alias(id),
        F.col("stratum").alias(exact),
        F.col("exposed").alias(treat),
        "score",
        "subclass",
    )
