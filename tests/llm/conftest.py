"""Odd documents: nulls, empty and long texts, repeated rows, columns with names used inside."""

import pytest

BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (
    "key", "id", "bucket", "found", "shard", "slot", "mix_source", "mix_number", "_bucket", "_before", "row",
    "rows", "component", "low", "high", "block", "word", "n", "label", "language", "redacted", "turn", "hash", "has",
)


def _rows():
    words = "the quick brown fox jumps over a lazy dog while seven small birds sing in the old garden tree".split()
    long = " ".join(words[i % len(words)] + str(i % 97) for i in range(30_000))
    prose = " ".join(words * 4)
    rows = [
        (1, prose, "en", "a", len(prose)),
        (2, prose, "en", "a", len(prose)),
        (3, prose + " today", "en", "b", None),
        (4, None, "en", "a", None),
        (5, "", None, "a", 0),
        (6, " \n\t ", "en", None, 4),
        (7, "12 34 !!", "en", "a", 8),
        (8, long, "en", "c", len(long)),
        (9, "die straße führt über den alten fluß und weiter nach süden", "de", "a", 57),
        (9, "die straße führt über den alten fluß und weiter nach süden", "de", "a", 57),
        (10, "mail bob@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1", None, "a", 80),
        (11, "😀 İx é ,, .. a,b   tab\tone", None, "b", 30),
        (12, "tie tie tie tie tie tie", "en", "b", 23),
        (None, "no name here but words enough for a shingle or two", "en", "a", 50),
        (None, None, None, None, None),
    ]
    return [tuple(x.encode("utf-16", "surrogatepass").decode("utf-16") if isinstance(x, str) else x for x in r) for r in rows]


@pytest.fixture(scope="session")
def odd_rows():
    return _rows()


def _with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(name).alias(name) for name in CLASHING])


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    _with_clashes(spark.createDataFrame(_rows(), BASE)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return _with_clashes(spark.createDataFrame([], BASE))


@pytest.fixture(scope="session")
def documents(spark, small_dir):
    """Small documents with their texts on the driver."""
    df = spark.read.parquet(f"{small_dir}/documents.parquet")
    return df, [tuple(row) for row in df.select("doc_id", "text", "lang", "source").collect()]
