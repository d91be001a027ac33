"""Token ids, packing and the id store against the plain tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlake.llm import id_store, packing, queries
from cohortlake.llm.common import shared_folder
from cohortlake.llm.perfect_hash import PerfectHash, fingerprints
from cohortlake.llm.token_ids import TextEncoder

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "", " ", "a  b", "\n\na b\n", "x <|endoftext|> y", "it's  <|endoftext|>", "tab\tone \x0b two\x1c three", "é́  x  y",
    "don't I'LL 12 345", "　wide　space x", "a\nb\n\nc \n d", "ΣΑΣ ς naïve", "a\x00b c", "x" * 300 + " y",
    "ÀÉ, straße. İx Ǆ. ﬁx", "a. b, c.. d,. e.,", "a.", ",", " ,", "x  ,", "ß. ÿ,", "٣ ½ a² x_y", "helló, é. Å, K.",
    "end.\nNext, one. (two), three...", "a , b . c", "_. _, x_.",
]


def plain(path, texts, end):
    tokenizer = Tokenizer.from_file(path)
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4") for t in texts]


@pytest.mark.parametrize(("path", "spaces"), [(WORDS, False), (BYTES, True)])
def test_encoder(documents, path, spaces, monkeypatch):
    from cohortlake.llm import token_ids

    texts = ODD + [text for _, text, *_ in documents[1]]
    expected = [ids[:-1].tobytes() for ids in plain(path, texts, 0)]
    encoder = TextEncoder(path, spaces)
    assert encoder.encode(texts) == expected
    assert encoder.encode(texts) == expected
    monkeypatch.setattr(token_ids, "MEMORY_PARTS", 10)
    assert encoder.encode(texts) == expected


def test_differencing_evens_out():
    lengths = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.differencing(lengths, 2), weights=lengths)) == [14, 16]
    random = np.random.default_rng(3).integers(1, 257, 3000)
    window = packing.pack_lengths(random, 2048)
    sums = np.bincount(window, weights=random)
    assert sums.max() <= 2048 and sums.max() - sums.min() < 40
    assert len(sums) <= -(-random.sum() // 2048) + 2


def test_window_count_rises():
    # three of 1100 never share a window of 2048, though two windows could hold the sum
    window = packing.pack_lengths(np.array([1100, 1100, 1100]), 2048)
    assert sorted(np.bincount(window)) == [1, 1, 1]
    assert list(packing.pack_lengths(np.array([2048]))) == [0]
    assert len(packing.pack_lengths(np.zeros(0, dtype=int))) == 0


def check_pieces(rows, keys, texts):
    ids = plain(WORDS, texts, 1)
    expected = defaultdict(list)
    for key, one in zip(keys, ids, strict=True):
        expected[key].append(one)
    got = defaultdict(list)
    windows = defaultdict(list)
    for row in rows:
        got[row["doc_id"]].append(row)
        windows[row["sequence_id"]].append((row["offset"], row["length"], row["padded"]))
    assert set(got) == set(expected)
    for key, some in expected.items():
        if len(some) == 1:
            at = 0
            for row in sorted(got[key], key=lambda r: r["start"]):
                assert row["start"] == at and row["doc_tokens"] == len(some[0])
                assert bytes(row["ids"]) == some[0][at : at + row["length"]].tobytes()
                at += row["length"]
            assert at == len(some[0])
        else:
            assert sum(r["length"] for r in got[key]) == sum(map(len, some))
    for parts in windows.values():
        total = 0
        for offset, length, _ in sorted(parts):
            assert offset == total
            total += length
        assert total <= 2048
        assert parts[0][2] == (total if total & (total - 1) == 0 else 2048)


def test_packing(spark, documents, odd_docs, odd_rows, no_docs):
    df, rows = documents
    check_pieces(packing.pack(df, WORDS, group_windows=16).collect(), [r[0] for r in rows], [r[1] for r in rows])
    check_pieces(packing.pack(odd_docs, WORDS).collect(), [r[0] for r in odd_rows], [r[1] for r in odd_rows])
    assert packing.pack(no_docs, WORDS).collect() == []


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    built, end = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes() + b"rest")
    assert sorted(built.slots(keys)) == list(range(len(keys)))
    assert len(fingerprints(keys)) == len(keys)
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_id_store_round_trip(spark, documents, monkeypatch):
    monkeypatch.setattr(id_store, "INDEX_KEYS", 40)
    df, rows = documents
    folder = shared_folder(spark, "test-store")
    store = id_store.write_ids(df, folder, BYTES, shards=5)
    assert store.index_files == -(-len(rows) // 40)
    again = id_store.read_store(folder)
    assert again == store
    got = {r["doc_id"]: r for r in id_store.read_ids(df.select("doc_id"), again).collect()}
    at = 0
    for doc, text, *_ in sorted(rows):
        ids = plain(BYTES, [text], 0)[0]
        assert (got[doc]["start"], got[doc]["n_tokens"], bytes(got[doc]["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)
    some = spark.createDataFrame([(rows[3][0],), (-5,), (10**15,), (rows[3][0],)], "doc_id long")
    assert [r["doc_id"] for r in id_store.read_ids(some, store).collect()] == [rows[3][0]]


def test_keys_meet_by_index_file(spark):
    """All keys of an index file come to one task in a row, so that it opens each file once."""
    keys = spark.range(-5000, 5000, numPartitions=7).select(F.col("id").alias("key"))
    rows = id_store._by_home(keys, 40).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["key"] for r in rows) == list(range(-5000, 5000))
    runs = [(a["task"], a["home"]) for a, b in zip(rows, [None, *rows]) if b is None or (a["task"], a["home"]) != (b["task"], b["home"])]
    assert sorted(home for _, home in runs) == list(range(40))


def test_id_store_odd(spark, odd_docs, odd_rows, no_docs):
    store = id_store.write_ids(odd_docs, shared_folder(spark, "odd-store"), BYTES, shards=4)
    assert store.null_rows == 2
    got = id_store.read_ids(odd_docs, store).collect()
    expected = sorted((str(r[0]), plain(BYTES, [r[1]], 0)[0].tobytes()) for r in odd_rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == expected
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    empty = id_store.write_ids(no_docs, shared_folder(spark, "no-store"), BYTES, shards=2)
    assert id_store.read_ids(odd_docs, empty).collect() == []


def test_queries(spark, small_dir, documents):
    pieces = queries.op3_packing(spark, small_dir).collect()
    by_doc = defaultdict(int)
    for row in pieces:
        by_doc[row["doc_id"]] += row["length"]
    assert by_doc == {r[0]: len(plain(WORDS, [r[1]], 1)[0]) for r in documents[1]}
    found = {r["doc_id"]: r["ids_crc32"] for r in queries.op4_id_store(spark, small_dir).collect()}
    assert found == {r[0]: zlib.crc32(plain(BYTES, [r[1]], 0)[0].tobytes()) for r in documents[1]}
