"""From raw documents to packed training windows, in five stages.

Each stage takes the documents its predecessor kept and works on all of them. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import jaccard_join, language_id, mixing, packing, personal_data
from cohortlake.llm.common import bounded_batches, stored

# A text goes if fewer of its letter n-grams than this belong to its language.
LEAST_LANGUAGE_SCORE = 0.1
TOKENIZER = "word_bpe_49k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language the corpus teaches; those without letters go.

    Where no document has a language nothing can be learned, and all stay.
    """
    model = language_id.learn(docs)
    return language_id.keep_known(docs, model, LEAST_LANGUAGE_SCORE) if model.languages else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return jaccard_join.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that any stretch follows the sources' weights."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows of 2048, numbered in the order of the mix.

    Files are not read in the order they were written in, so the order, which follows
    from the keys and sources, is made again.
    """
    ordered = mixing.mixed(docs.select("doc_id", "source", "text"))
    return packing.pack(ordered, str(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# The language model, MinHash and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
