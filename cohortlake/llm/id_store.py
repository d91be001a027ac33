"""Token ids in raw binary shards, with a minimal perfect hash for keyed access.

A store is a folder. ``shard-N.ids`` holds the ids of consecutive documents in key
order, 16 bits each where the vocabulary allows it and 32 otherwise, then a table of
where each document starts, then the documents' keys and what the shard holds; ids are
written as they are made. ``index-N.mph`` covers the keys whose hash falls to it: a
minimal perfect hash, and for each slot a fingerprint of the key, the shard, the first
document with that key and their number. A lookup takes one slot, two entries of a start
table and the payload. Lookups of many keys are brought together by index file, which
one task reads once, whole.

Files are written under a passing name and renamed, so a task that runs twice, at
once or later, leaves one whole file.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.perfect_hash import PerfectHash, fingerprints
from cohortlake.llm.textarrays import mix
from cohortlake.llm.token_ids import text_encoder

# Keys that one index file covers; bounds the memory of the task that builds it.
INDEX_KEYS = 250_000

# the end of a shard: id width in bytes, documents, ids, documents without a key
_SHARD_TAIL = "<4sIQQQ"
_SHARD_TAIL_BYTES = struct.calcsize(_SHARD_TAIL)
_SHARD_MAGIC = b"IDS2"
_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("row", "<u8"), ("count", "<u8")])


@dataclass(frozen=True)
class Store:
    """What a reader must know of a store; ``starts`` has the ids before each shard."""

    folder: str
    width: int
    index_files: int
    null_rows: int
    starts: tuple[int, ...]


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, parts: Iterable[bytes]) -> None:
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    passing = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(passing) as out:
        for part in parts:
            out.write(part)
    files.move(passing, f"{root}/{name}")


def _home(keys: np.ndarray, index_files: int) -> np.ndarray:
    """The index file of each key."""
    return (mix(keys, 3) % np.uint64(index_files)).astype(np.int64)


def _shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.ids"


class Shard:
    """One open shard."""

    def __init__(self, folder: str, shard: int) -> None:
        files, root = _files(folder)
        self.file = files.open_input_file(f"{root}/{_shard_name(shard)}")
        magic, self.width, self.docs, self.ids, self.nulls = struct.unpack(
            _SHARD_TAIL, self.file.read_at(_SHARD_TAIL_BYTES, self.file.size() - _SHARD_TAIL_BYTES)
        )
        if magic != _SHARD_MAGIC:
            raise ValueError(f"{folder} has no shard {shard}")
        self.table = self.ids * self.width

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def starts(self, row: int, count: int) -> np.ndarray:
        """Where ``count`` documents from ``row`` start in the shard, and where the last ends."""
        return np.frombuffer(self.file.read_at(8 * (count + 1), self.table + 8 * row), dtype="<u8").astype(np.int64)

    def payload(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` of the shard as little-endian unsigned 32-bit integers."""
        raw = self.file.read_at((last - first) * self.width, first * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")

    def keys(self) -> np.ndarray:
        """Keys of the documents that have one, in order; the others come first."""
        raw = self.file.read_at(8 * (self.docs - self.nulls), self.table + 8 * (self.docs + 1))
        return np.frombuffer(raw, dtype="<i8")


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
) -> Store:
    """Encode all texts and write them to a new store in ascending order of the key.

    A null text is empty: its end id alone. Rows of one key follow each other, in the
    order of their texts' hashes; rows without a key come first. The driver
    gets one row per shard. An empty table makes a store without documents.
    """
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = slim.repartitionByRange(shards, "key").sortWithinPartitions("key", F.xxhash64("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = text_encoder(tokenizer_path, spaces_count=True)
        width = 2 if max(len(encoder.edge), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        lengths, keys, nulls = [], [], 0

        def parts() -> Iterator[bytes]:
            nonlocal nulls
            for batch in batches:
                texts = [value if isinstance(value, str) else "" for value in batch["text"]]
                for at in range(0, len(texts), 1000):
                    for ids in encoder.encode(texts[at : at + 1000]):
                        part = np.frombuffer(ids, dtype="<u4").astype(f"<u{width}").tobytes() + end
                        lengths.append(len(part) // width)
                        yield part
                known = batch["key"].notna()
                nulls += int((~known).sum())
                keys.append(batch["key"][known].to_numpy(dtype="<i8"))
            yield np.cumsum([0, *lengths], dtype="<u8").tobytes()
            yield np.concatenate(keys).tobytes() if keys else b""
            yield struct.pack(_SHARD_TAIL, _SHARD_MAGIC, width, len(lengths), sum(lengths), nulls)

        _put(folder, _shard_name(shard), parts())
        row = {"shard": shard, "docs": len(lengths), "ids": sum(lengths), "nulls": nulls, "width": width}
        yield pd.DataFrame([row])

    made = ordered.mapInPandas(encode, "shard int, docs long, ids long, nulls long, width int").collect()
    by_shard = sorted(made, key=lambda row: row["shard"])
    starts = [0] * (1 + max((row["shard"] for row in by_shard), default=-1) + 1)
    for row in by_shard:
        starts[row["shard"] + 1] = row["ids"]
    starts = np.cumsum(starts).tolist()
    rows = sum(row["docs"] for row in by_shard)
    index_files = max(1, -(-rows // INDEX_KEYS))
    store = Store(
        folder,
        max((row["width"] for row in by_shard), default=2),
        index_files,
        sum(row["nulls"] for row in by_shard),
        tuple(starts),
    )
    _write_index(spark, store, [row["shard"] for row in by_shard if row["docs"]])
    _put(folder, "store.json", [json.dumps(asdict(store)).encode()])
    return store


def read_store(folder: str) -> Store:
    """The store in a folder."""
    files, root = _files(folder)
    with files.open_input_stream(f"{root}/store.json") as source:
        found = json.loads(source.read())
    return Store(**found | {"folder": folder, "starts": tuple(found["starts"])})


def _write_index(spark: SparkSession, store: Store, shards: list[int]) -> None:
    """One index file for each share of the keys."""
    folder, index_files = store.folder, store.index_files

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["shard"]:
                with Shard(folder, int(number)) as shard:
                    keys, nulls = shard.keys(), shard.nulls
                first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1) != 0) if len(keys) else np.zeros(0, np.int64)
                counts = np.diff(first, append=len(keys))
                found = pd.DataFrame({"home": _home(keys[first].view("<u8"), index_files), "key": keys[first]})
                yield found.assign(shard=int(number), row=first + nulls, count=counts)

    def build(found: pd.DataFrame) -> pd.DataFrame:
        keys = found["key"].to_numpy(dtype="<i8").view("<u8")
        hashed = PerfectHash.build(keys)
        slots = np.zeros(len(keys), dtype=_SLOT)
        places = hashed.slots(keys)
        slots["fingerprint"][places] = fingerprints(keys)
        for name in ("shard", "row", "count"):
            slots[name][places] = found[name].to_numpy()
        home = int(found["home"].iloc[0])
        _put(folder, f"index-{home:06d}.mph", [hashed.to_bytes(), slots.tobytes()])
        return pd.DataFrame({"home": [home], "keys": [len(keys)]})

    if shards:
        listed = spark.createDataFrame([(shard,) for shard in shards], "shard int").repartition(len(shards))
        rows = listed.mapInPandas(entries, "home int, key long, shard int, row long, count long")
        rows.groupBy("home").applyInPandas(build, "home int, keys long").collect()


class Index:
    """Index files of a store, read when first asked for; one is kept open."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.home = -1

    def _open(self, home: int) -> None:
        if home != self.home:
            files, root = _files(self.store.folder)
            path = f"{root}/index-{home:06d}.mph"
            if files.get_file_info(path).is_file:
                with files.open_input_file(path) as source:
                    raw = source.read()
                self.hashed, at = PerfectHash.from_bytes(raw)
                self.slots = np.frombuffer(raw, dtype=_SLOT, offset=at)
            else:
                self.hashed, self.slots = PerfectHash([]), np.zeros(0, dtype=_SLOT)
            self.home = home

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of signed 64-bit keys, with count 0 for a key the store lacks."""
        keys = keys.astype("<i8").view("<u8")
        out = np.zeros(len(keys), dtype=_SLOT)
        homes = _home(keys, self.store.index_files)
        for home in np.unique(homes):
            self._open(int(home))
            here = np.flatnonzero(homes == home)
            places = self.hashed.slots(keys[here])
            here, places = here[places >= 0], places[places >= 0]
            same = self.slots["fingerprint"][places] == fingerprints(keys[here])
            out[here[same]] = self.slots[places[same]]
        return out


def _by_home(keys: DataFrame, index_files: int) -> DataFrame:
    """``home, key``: the keys of one index file in one task, one after the other."""

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unsigned = batch["key"].to_numpy(dtype="<i8").view("<u8")
            yield pd.DataFrame({"home": _home(unsigned, index_files), "key": batch["key"]})

    return keys.mapInPandas(homes, "home long, key long").repartition("home").sortWithinPartitions("home")


def read_ids(keys: DataFrame, store: Store, key: str = "doc_id") -> DataFrame:
    """The documents of the given keys: one row each, as the store has them.

    ``doc_id``, ``start`` (ids of all documents before it in the store), ``n_tokens``
    and ``ids`` (little-endian unsigned 32 bits). Keys are looked up in the index,
    then read shard by shard in the order of their place. A key the store lacks
    gives no row, a repeated one its rows once, a null key the documents without key.
    """
    folder, starts = store.folder, store.starts

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(store)
        for batch in batches:
            found = index.find(batch["key"].to_numpy())
            has = found["count"] > 0
            out = pd.DataFrame({name: found[name][has].astype(np.int64) for name in ("shard", "row", "count")})
            yield out.assign(key=batch["key"].to_numpy()[has])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number = None, -1
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key_, place, row, count in zip(batch["key"], batch["shard"], batch["row"], batch["count"], strict=True):
                if place != number:
                    if shard is not None:
                        shard.file.close()
                    shard, number = Shard(folder, int(place)), place
                edges = shard.starts(int(row), int(count)).tolist()
                for first, last in zip(edges[:-1], edges[1:], strict=True):
                    ids = shard.payload(first, last)
                    rows.append((None if pd.isna(key_) else int(key_), starts[int(place)] + first, len(ids), ids.tobytes()))
                    held += len(ids)
                if held > 2_000_000:
                    yield _frame(rows)
                    rows, held = [], 0
            yield _frame(rows)
        if shard is not None:
            shard.file.close()

    asked = keys.select(F.col(key).cast("long").alias("key")).distinct()
    homed = _by_home(asked.filter("key is not null"), store.index_files)
    found = homed.mapInPandas(look_up, "shard long, row long, count long, key long")
    if store.null_rows:
        # rows without a key are the first of the first shard
        nameless = asked.filter("key is null").selectExpr(
            "0L as shard", "0L as row", f"{store.null_rows}L as count", "key"
        )
        found = found.unionByName(nameless)
    placed = found.repartitionByRange("shard", "row").sortWithinPartitions("shard", "row")
    return placed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})
