"""Conversation prefix trie as double arrays, one per prefix shard.

A conversation is a path of turns, a turn being a token of 20 bytes: 16 of its role's
and text's digest, 4 for the code points of the text. Equal paths become one sequence
with the number of its conversations. The sequences are range partitioned in the order
of their bytes, so that those with a common prefix stand side by side, and each
partition is cut into prefix shards of a bounded number of turns.

In a shard the turns get dense ids in the order in which the trie meets them. Each node
is a state s; its child by turn id c is the state ``BASE[s] + c``, and ``CHECK`` of that
state is s. Every sequence is then traversed through the two arrays, and what it brings
is added up at the states it passes.

Only the nodes along the first and the last path of a shard can also lie in other
shards. Everything a node adds up is counted by the shard that has the node first: a
shard knows the last path of the shard before it in its partition, and for the first
shard of a partition the count is put right later from the ends of the partitions. So
the parts of shared upper nodes just add up, in one aggregation over them alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import stored

TOKEN = 20
# Turns of a prefix shard; a longer sequence is a shard of its own.
SHARD_TURNS = 100_000
# Places tried for the children of one node before they go behind the last state.
TRIES = 64
# Conversations listed in one row while the ends of a node are hashed.
CHUNK_IDS = 65_536
# In the contract of the query: followers of a conversation take over turns of it.
FOLLOWERS = 100
HEADS = 6

EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
PARTS = "convs long, conv long, children long, leaves long, weighted long, once long"
NODES = (
    "kind string, node binary, parent binary, parent_conv long, depth long, ends binary, "
    f"{PARTS}, part int, first binary, last binary"
)


def paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, tokens``, its turns in order as hex.

    Turns are ordered by number, null first, those of one number by digest. A null role
    or text counts as empty, repeated rows are repeated turns, rows without a
    conversation are left out. A conversation is one row, 40 bytes a turn.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    size = F.lpad(F.hex(F.char_length(said).cast("long")), 8, "0")
    token = F.concat(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)), size)
    turns = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("at"), token.alias("token"))
    turns = turns.filter("conv_id is not null")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "token")))["token"].alias("tokens"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations whose first turns are taken from the first of their hundred.

    Conversation c takes the first h turns of conversation c - c % 100, h being the
    crc32 of its decimal number modulo 6, then its own turns after the first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % FOLLOWERS
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = own.filter(F.col("conv_id") % FOLLOWERS == 0).select(
        F.col("conv_id").alias("base"), F.slice("tokens", 1, HEADS - 1).alias("head")
    )
    taken = own.withColumn("base", base).withColumn("h", h.cast("int")).join(heads, "base", "left")
    rest = F.slice("tokens", F.col("h") + 1, F.greatest(F.size("tokens") - F.col("h"), F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    return taken.select("conv_id", F.concat(head, rest).alias("tokens"))


def _digest_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of lists that span several rows, read in order."""
    now, state = None, None
    for batch in batches:
        done = []
        for sequence, listed in zip(batch["sequence"], batch["listed"], strict=True):
            if sequence != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = sequence, hashlib.sha256(listed.encode())
            else:
                state.update(b"," + listed.encode())
        yield pd.DataFrame(done, columns=["sequence", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["sequence", "ends_sha256"])


def end_digests(members: DataFrame, chunk: int = CHUNK_IDS) -> DataFrame:
    """``sequence, ends_sha256``: digest of the ascending conversations of each sequence.

    The ids are listed in rows of a bounded range of ids. One row is hashed where it
    is; several are read in order by one task, a row at a time.
    """
    cell = F.floor(F.col("conv_id") / chunk)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    rows = members.groupBy("sequence", cell.alias("cell")).agg(listed.alias("listed"))
    counted = stored(rows, "ends")
    many = counted.groupBy("sequence").agg(F.count(F.lit(1)).alias("rows"), F.min("listed").alias("listed"))
    one = many.filter("rows = 1").select("sequence", F.sha2(F.col("listed").cast("binary"), 256).alias("ends_sha256"))
    several = counted.join(many.filter("rows > 1").select("sequence"), "sequence", "left_semi")
    ordered = several.repartition("sequence").sortWithinPartitions("sequence", "cell").select("sequence", "listed")
    return one.union(ordered.mapInPandas(_digest_long, "sequence binary, ends_sha256 string"))


def _common(a: bytes, b: bytes) -> int:
    """Turns two paths have in common from the start."""
    size = min(len(a), len(b)) // TOKEN
    if a[: size * TOKEN] == b[: size * TOKEN]:
        return size
    x = np.frombuffer(a, dtype=np.uint8, count=size * TOKEN)
    y = np.frombuffer(b, dtype=np.uint8, count=size * TOKEN)
    return int(np.argmax(x != y)) // TOKEN


class DoubleArray:
    """A trie over sorted, distinct sequences of tokens in two integer arrays.

    ``turns`` holds the tokens by dense id. State 0 is the root, an unused state has
    ``check`` -1.
    """

    def __init__(self, sequences: list[bytes]) -> None:
        sizes = np.array([len(s) // TOKEN for s in sequences], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"".join(sequences), dtype=np.uint8).reshape(-1, TOKEN)
        flat = np.ascontiguousarray(raw).view(f"V{TOKEN}").ravel()
        self.sizes = sizes
        common = np.zeros(len(sequences), dtype=np.int64)
        for i in range(1, len(sequences)):
            common[i] = _common(sequences[i - 1], sequences[i])
        # dense ids in the order of depth, so that the children of a node lie close
        depth = np.arange(len(flat)) - np.repeat(self.starts[:-1], sizes)
        _, first, known = np.unique(flat, return_index=True, return_inverse=True)
        known = known.ravel()
        order = np.argsort(depth, kind="stable")
        met = np.full(len(first), len(flat), dtype=np.int64)
        np.minimum.at(met, known[order], np.arange(len(flat)))
        rank = np.empty(len(first), dtype=np.int64)
        rank[np.argsort(met, kind="stable")] = np.arange(len(first))
        self.ids = rank[known]
        self.turns = np.empty_like(flat[first])
        self.turns[rank] = flat[first]
        self.chars = np.ascontiguousarray(self.turns).view(np.uint8).reshape(-1, TOKEN)[:, 16:].copy().view(">u4").ravel().astype(np.int64)
        self._pack(common)

    def _pack(self, common: np.ndarray) -> None:
        """Give each node a base, depth by depth, at the first place where its children fit."""
        room = 2 * max(len(self.turns), 16)
        self.base = np.zeros(room, dtype=np.int64)
        self.check = np.full(room, -1, dtype=np.int64)
        self.check[0] = 0
        free, end = 1, 1
        state = np.zeros(len(self.sizes), dtype=np.int64)
        live = np.flatnonzero(self.sizes > 0)
        depth = 0
        while len(live):
            token = self.ids[self.starts[live] + depth]
            new = common[live] <= depth
            new[0] = True
            at = np.cumsum(new) - 1
            parents, children = state[live[new]], token[new]
            places = np.empty(len(parents), dtype=np.int64)
            begins = np.flatnonzero(np.diff(parents, prepend=-1))
            for begin, stop in zip(begins, [*begins[1:], len(parents)], strict=True):
                some = children[begin:stop]
                low, spread = some.min(), int(some.max() - some.min())
                while end + spread + 2 >= len(self.check):
                    self.base = np.concatenate([self.base, np.zeros(len(self.base), dtype=np.int64)])
                    self.check = np.concatenate([self.check, np.full(len(self.check), -1, dtype=np.int64)])
                while self.check[free] >= 0:
                    free += 1
                place = free
                for _ in range(TRIES):
                    if self.check[place] < 0 and (self.check[some - low + place] < 0).all():
                        break
                    place += 1
                    if place >= end:
                        break
                else:
                    place = end
                spots = some - low + place
                self.base[parents[begin]] = place - low
                self.check[spots] = parents[begin]
                places[begin:stop] = spots
                end = max(end, int(spots.max()) + 1)
            state[live] = places[at]
            depth += 1
            live = live[self.sizes[live] > depth]
        self.base, self.check = self.base[:end], self.check[:end]

    def step(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The children of the states by the given turn ids, -1 where there is none."""
        to = self.base[states] + tokens
        inside = (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (to > 0) & (self.check[to] == states), to, -1)

    def find(self, prefix: bytes) -> int:
        """The state a prefix of tokens leads to, -1 if no sequence starts with it."""
        by_token = {bytes(token): i for i, token in enumerate(self.turns)}
        state = 0
        for at in range(0, len(prefix), TOKEN):
            token = by_token.get(prefix[at : at + TOKEN])
            if token is None:
                return -1
            state = int(self.step(np.array([state]), np.array([token]))[0])
            if state < 0:
                return -1
        return state


def _node_keys(path: bytes, upto: int) -> list[bytes]:
    """Names of the nodes along a path, the root first: a chain of digests."""
    keys = [b""]
    for at in range(upto):
        keys.append(hashlib.sha256(keys[-1] + path[at * TOKEN : (at + 1) * TOKEN]).digest()[:16])
    return keys


def shard_nodes(rows: pd.DataFrame, before: bytes | None, serial: bytes) -> pd.DataFrame:
    """Nodes of one prefix shard, by traversing its sequences through a double array.

    ``before`` is the path in front of the shard in its partition. Nodes that this path
    has too were counted there.
    """
    sequences = rows["path"].tolist()
    trie = DoubleArray(sequences)
    states = len(trie.check)
    convs = np.zeros(states, dtype=np.int64)
    conv = np.full(states, np.iinfo(np.int64).max, dtype=np.int64)
    depths = np.zeros(states, dtype=np.int64)
    char = np.zeros(states, dtype=np.int64)
    n, least = rows["n"].to_numpy(), rows["conv"].to_numpy()
    state = np.zeros(len(sequences), dtype=np.int64)
    convs[0], conv[0] = n.sum(), least.min()
    live, depth = np.flatnonzero(trie.sizes > 0), 0
    first_path, last_path = [0], [0]
    while len(live):
        token = trie.ids[trie.starts[live] + depth]
        to = trie.step(state[live], token)
        if (to < 0).any():
            raise RuntimeError("a sequence has left its trie")
        np.add.at(convs, to, n[live])
        np.minimum.at(conv, to, least[live])
        depths[to] = depth + 1
        char[to] = trie.chars[token]
        state[live] = to
        if live[0] == 0:
            first_path.append(int(to[0]))
        if live[-1] == len(sequences) - 1:
            last_path.append(int(to[-1]))
        depth += 1
        live = live[trie.sizes[live] > depth]

    old = 0 if before is None else _common(before, sequences[0])
    counted = np.ones(states, dtype=np.int64)
    if before is not None:
        counted[np.array(first_path[: old + 1])] = 0
    used = np.flatnonzero(trie.check >= 0)
    used = used[np.argsort(depths[used], kind="stable")]
    parent = trie.check[used]
    below = used[1:]
    children = np.zeros(states, dtype=np.int64)
    np.add.at(children, parent[1:], counted[below])
    has_child = np.zeros(states, dtype=bool)
    has_child[parent[1:]] = True
    leaves = np.where(has_child, 0, 1)
    if before is not None and old == len(before) // TOKEN:
        # the path in front was counted as a leaf, but goes on here
        leaves[first_path[old]] -= 1
    weighted = convs * char
    once = counted * char
    edges = np.searchsorted(depths[used], np.arange(depth + 2))
    for level in range(depth, 0, -1):
        some = used[edges[level] : edges[level + 1]]
        up = trie.check[some]
        for value in (leaves, weighted, once):
            np.add.at(value, up, value[some])

    ends = np.full(states, -1, dtype=np.int64)
    ends[state] = np.arange(len(sequences))
    shared = np.zeros(states, dtype=bool)
    shared[first_path] = shared[last_path] = True
    names: dict[int, bytes] = {}
    for path, raw in ((first_path, sequences[0]), (last_path, sequences[-1])):
        names.update(zip(path, _node_keys(raw, len(path) - 1), strict=True))
    digests = rows["ends"].to_numpy()

    def name(some: np.ndarray) -> list[bytes]:
        return [names[s] if s in names else serial + s.to_bytes(8, "big") for s in some.tolist()]

    return pd.DataFrame(
        {
            "kind": np.where(shared[used], "shared", "own"),
            "node": name(used),
            "parent": [None, *name(parent[1:])],
            # the parent's other conversations are known where it lies in this shard alone
            "parent_conv": pd.Series(conv[parent]).astype("Int64").mask(shared[parent]),
            "depth": depths[used],
            "ends": [digests[e] if e >= 0 else None for e in ends[used].tolist()],
            "convs": convs[used],
            "conv": conv[used],
            "children": children[used],
            "leaves": leaves[used],
            "weighted": weighted[used],
            "once": once[used],
        }
    )


def _shards(turns: int):
    """Cuts a sorted partition into prefix shards; the last row tells where it begins and ends."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        columns = [column.split()[0] for column in NODES.split(", ")]
        waiting: list[pd.DataFrame] = []
        size, shard, before, first = 0, 0, None, None

        def finish() -> pd.DataFrame:
            nonlocal waiting, size, shard, before, first
            rows = pd.concat(waiting, ignore_index=True)
            out = shard_nodes(rows, before, part.to_bytes(6, "big") + shard.to_bytes(6, "big"))
            first = rows["path"].iloc[0] if first is None else first
            before, waiting, size, shard = rows["path"].iloc[-1], [], 0, shard + 1
            out["part"] = pd.Series([part] * len(out), dtype="int32")
            out["first"], out["last"] = None, None
            return out[columns]

        for batch in batches:
            upto = np.cumsum(batch["path"].str.len().to_numpy() // TOKEN + 1)
            at = 0
            while at < len(batch):
                done = upto[at - 1] if at else 0
                end = max(int(np.searchsorted(upto, done + turns - size, side="right")), at + (0 if waiting else 1))
                if end > at:
                    waiting.append(batch.iloc[at:end])
                    size += int(upto[end - 1] - done)
                if end < len(batch):
                    yield finish()
                at = end
        if waiting:
            yield finish()
        if first is not None:
            row = dict.fromkeys(columns) | {"kind": "ends", "part": part, "first": first, "last": before}
            yield pd.DataFrame([row], columns=columns, dtype=object)

    return work


def _corrections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What two neighbouring partitions have both counted along their common path, with a minus."""
    for batch in batches:
        for path, before in zip(batch["first"], batch["before"], strict=True):
            if before is None:
                continue
            old = _common(before, path)
            keys = _node_keys(path, old)
            chars = np.array([int.from_bytes(path[i * TOKEN + 16 : (i + 1) * TOKEN], "big") for i in range(old)] or [0], dtype=np.int64)
            # a node's subtree along the path: its own text and those after it
            tail = np.append(np.cumsum(chars[::-1])[::-1], 0)[: old + 1] if old else np.zeros(1, dtype=np.int64)
            once = np.concatenate([tail[:1], tail[:old]]) if old else tail
            ended = int(old == len(before) // TOKEN)
            yield pd.DataFrame(
                {
                    "node": keys,
                    "children": [-1] * old + [0],
                    "leaves": [-ended] * (old + 1),
                    "once": -once,
                }
            )


def trie_nodes(conversation_paths: DataFrame, shard_turns: int = SHARD_TURNS, chunk: int = CHUNK_IDS) -> DataFrame:
    """One row per node of the prefix trie of ``conv_id, tokens``.

    ``conv_id`` is the smallest conversation that starts with the node's turns,
    ``depth`` their number, ``parent_conv_id`` the parent's ``conv_id``, ``n_convs`` the
    conversations, ``n_children`` and ``n_leaves`` the children and the childless nodes
    below, ``saved_tokens`` the code points that sharing saves below, ``ends_sha256`` the
    digest of the conversations that end here. The root has no turns and no parent. A
    conversation without turns ends at the root; without conversations there is no node.
    Each ``conv_id`` must occur once.
    """
    path = F.unhex(F.array_join("tokens", ""))
    pathed = stored(conversation_paths.select("conv_id", path.alias("path")), "paths")
    name = F.unhex(F.sha2("path", 256))
    sequences = pathed.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    digests = end_digests(pathed.select(name.alias("sequence"), "conv_id"), chunk)
    whole = sequences.withColumn("sequence", name).join(digests, "sequence").select("path", "n", "conv", F.unhex("ends_sha256").alias("ends"))
    ordered = stored(whole, "sequences").repartitionByRange("path").sortWithinPartitions("path")
    found = stored(ordered.mapInPandas(_shards(shard_turns), NODES), "nodes")

    bounds = found.filter("kind = 'ends'").select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("before"))
    minus = bounds.select("first", "before").mapInPandas(_corrections, "node binary, children long, leaves long, once long")
    sums = ("convs", "children", "leaves", "weighted", "once")
    kept = ("node", "parent", "depth", "ends", "conv", *sums)
    shared = found.filter("kind = 'shared'").select(*kept)
    merged = stored(
        shared.unionByName(minus, allowMissingColumns=True)
        .groupBy("node")
        .agg(
            *[F.max(c).alias(c) for c in ("parent", "depth", "ends")],
            F.min("conv").alias("conv"),
            *[F.sum(c).alias(c) for c in sums],
        ),
        "shared",
    )
    own = found.filter("kind = 'own'")
    above = merged.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    below_shared = own.filter("parent_conv is null").select(*kept).unionByName(merged.select(*kept)).join(above, "parent", "left")
    nodes = own.filter("parent_conv is not null").select(*kept, "parent_conv").unionByName(below_shared.select(*kept, "parent_conv"))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - F.col("once")).alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("ends")), F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    )
