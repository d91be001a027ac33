"""The pipeline, stage by stage and as a whole."""

import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlake.llm import personal_data
from cohortlake.llm.queries import llm_queries

from .test_joins import all_pairs


def test_stages_and_run(spark, small_dir, documents, tmp_path):
    df, rows = documents
    docs, sizes = df, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, small_dir)
        if number < 4:
            assert made.columns == df.columns
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    texts = {r[0]: r[1] for r in rows}
    named = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/language_id").collect()}
    lettered = {doc for doc, text in texts.items() if any(map(str.isalpha, text or ""))}
    assert len(lettered - named) <= 0.01 * len(lettered) and named <= lettered
    classes, _ = all_pairs([(doc, texts[doc]) for doc in named])
    kept = spark.read.parquet(f"{tmp_path}/jaccard_join").collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(set(classes.values()))
    finder = personal_data.Finder()
    clean = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    assert clean == {r["doc_id"]: personal_data.redact_text(r["text"], finder(r["text"])) for r in kept}
    assert {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/mixing").collect()} == clean
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    packed = defaultdict(int)
    for r in docs.collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {doc: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for doc, text in clean.items()}
    assert llm_queries()["pipeline"](spark, small_dir).count() == sizes[-1]


def test_odd_documents(spark, odd_docs, no_docs, small_dir, tmp_path):
    for label, start in (("odd", odd_docs), ("none", no_docs)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small_dir).write.parquet(f"{tmp_path}/{label}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{label}/{name}")
        kept = {r["doc_id"] for r in docs.collect()}
        # documents without letters and near copies go; so small a model knows few words of 10
        assert kept - {10} == ({1, 8, 9, 11, 12, None} if label == "odd" else set())


def test_windows_follow_the_mix(spark, tmp_path):
    """Sources lie in files of their own; growing numbers of windows keep the sources' shares."""
    # weights are 2 to 1: until b runs out after 640 documents of a, every stretch holds a third of it
    docs = [(i, ("apple tree " if i % 5 else "brown fox ") * (1300 if i % 3 else 40)) for i in range(1600)]
    rows = [(i, text, "en", "a" if i % 5 else "b", len(text)) for i, text in docs]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(6, "source").write.parquet(f"{tmp_path}/docs")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
        mixed.write.parquet(f"{tmp_path}/mixing")
        made = corpus_pipeline.pack_windows(spark, spark.read.parquet(f"{tmp_path}/mixing"), "")
        pieces = made.select("doc_id", "length", "sequence_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r["sequence_id"] >> 36 for r in pieces}) > 1
    pieces.sort(key=lambda r: r["sequence_id"])
    total = sum(r["length"] for r in pieces)
    tokens, at = defaultdict(Counter), 0
    for r in pieces:
        tokens[10 * at // total][r["doc_id"] % 5 == 0] += r["length"]
        at += r["length"]
    share = [tokens[i][True] / tokens[i].total() for i in range(10)]
    assert all(abs(one - 1 / 3) < 0.06 for one in share[:5]) and max(share[7:]) < 0.06


def test_workers_need_no_installed_package(small_dir, tmp_path):
    """Started elsewhere, Python workers cannot import the package by its folder."""
    repo = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as driver
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("op3_packing", "op8_personal_data", "op10_lattice"):
    assert driver.queries()[name](spark, {small_dir!r}).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)
