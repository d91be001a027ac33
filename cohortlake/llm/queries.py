"""One query per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import block_search, hidden_markov, id_store, jaccard_join, language_id, lattice, mixing, packing
from cohortlake.llm import personal_data, prefix_trie, quality, sharding, vector_codes
from cohortlake.llm.common import bounded_batches, shared_folder, stored
from cohortlake.llm.oracles import llm_oracles

__all__ = ["llm_oracles", "llm_queries"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _remainder(divisor: int) -> Column:
    """crc32 of the document's number as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = language_id.learn(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(F.col("text"), model, docs).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    placed = sharding.assign(docs, sharding.tree_of(8), sharding.tree_of(9))
    return placed.withColumn("law", F.lit("key"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, _tokenizer("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = id_store.write_ids(docs, shared_folder(spark, "id-store"), _tokenizer("byte_bpe_50k.json"))
    found = id_store.read_ids(docs.select("doc_id"), store)
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs.select("doc_id", "source"))


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(_table(spark, sf_dir, "documents"), _remainder(5) == 1)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", personal_data.digest(F.col("text")).alias("found")).select("doc_id", "found.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality.assess(F.col("text"), model, docs).alias("found")).select("doc_id", "found.*")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(prefix_trie.paths(_table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(own))


def op12_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.top_k(_table(spark, sf_dir, "embeddings"), lambda ids: ids % 20 == 0, 20)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = F.lit(books.digest() if books else None).cast("string")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {
        "op1_language_id": op1_language_id,
        "op2_sharding": op2_sharding,
        "op3_packing": op3_packing,
        "op4_id_store": op4_id_store,
        "op5_mixing": op5_mixing,
        "op6_hidden_markov": op6_hidden_markov,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_personal_data": op8_personal_data,
        "op9_quality_rules": op9_quality_rules,
        "op10_lattice": op10_lattice,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_block_search": op12_block_search,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": pipeline,
    }
