"""Joins that stay balanced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than this part of all rows is dealt to several tasks; smaller ones AQE can split.
MOST_PARTS = 1000


def frequent_keys(df: DataFrame, *keys: Sequence[str], parts: int | None = None) -> list[dict[int, int]]:
    """For each key, given by its columns: hashes of its frequent values, with the salts each is to get.

    A value is frequent if it holds more than one in ``parts`` of the rows, by default
    the number of shuffle partitions, so fewer than ``parts`` values can be. Each task
    keeps a sketch of bounded size; only the sketches travel, and one scan serves all
    keys. A value missed or found by the sketch's error costs balance, not rows.
    """
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, min(parts, MOST_PARTS))
    sketches = [
        F.call_function("approx_top_k", F.xxhash64(*key), F.lit(parts), F.lit(20 * parts)).alias(f"top{place}")
        for place, key in enumerate(keys)
    ]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *sketches).first()
    # as many salts for all values together as spread them over every reducer
    return [
        {top["item"]: -(-4 * parts * top["count"] // found["rows"]) for top in tops if top["count"] * parts > found["rows"]}
        for tops in found[1:]
    ]


def _salts(key: Sequence[str], hot: Mapping[int, int]) -> Column:
    """How many salts the key's value has; NULL for one that is not frequent."""
    known = F.create_map(*[F.lit(part).cast("long") for pair in sorted(hot.items()) for part in pair])
    return F.try_element_at(known, F.xxhash64(*key))


def salted(df: DataFrame, key: Sequence[str], hot: Mapping[int, int], spread_by: Sequence[str], out: str) -> DataFrame:
    """Add a second key to the large side: rows of frequent values are dealt by ``spread_by``.

    A retried task sends each row where it went before.
    """
    if not hot:
        return df.withColumn(out, F.lit(0))
    salt = F.pmod(F.hash(*spread_by), _salts(key, hot).cast("int"))
    return df.withColumn(out, F.coalesce(salt, F.lit(0)))


def replicated(lookup: DataFrame, key: Sequence[str], hot: Mapping[int, int], out: str) -> DataFrame:
    """The small side of a salted join: rows of frequent values once for each salt."""
    if not hot:
        # pmod(.., 1) is always 0 but not a literal, so the second key stays a join key
        return lookup.withColumn(out, F.pmod(F.hash(*key), F.lit(1)))
    copies = F.coalesce(_salts(key, hot).cast("int"), F.lit(1))
    return lookup.withColumn(out, F.explode(F.sequence(F.lit(0), copies - 1)))


def left_lookup(
    df: DataFrame, lookup: DataFrame, key: str, spread_by: Sequence[str], hot: Mapping[int, int] | None = None
) -> DataFrame:
    """LEFT JOIN on a key that may be NULL on most rows of ``df``, and frequent where it is not.

    NULL keys match nothing, yet a plain join sends them all to one task. A
    second key, constant where there is a value, spreads them by the values of
    ``spread_by``, so that a retried task sends each row where it went before. Values
    in ``hot`` (see ``frequent_keys``) are spread likewise, and their rows of the
    lookup repeated.
    """
    right = replicated(lookup, [key], hot or {}, "_spare")
    left = salted(df, [key], hot or {}, spread_by, "_spare")
    left = left.withColumn("_spare", F.when(F.col(key).isNull(), F.hash(*spread_by)).otherwise(F.col("_spare")))
    return left.join(right, [key, "_spare"], "left").drop("_spare")


def lookup_of_values(
    df: DataFrame,
    lookup: DataFrame,
    key: Sequence[str],
    spread_by: Sequence[str],
    hot: Mapping[int, int],
    how: str = "left",
) -> DataFrame:
    """Join a lookup that was built from the values of ``key`` in ``df``; NULL finds NULL."""
    right = replicated(lookup, key, hot, "_salt").withColumnsRenamed({name: f"_of_{name}" for name in [*key, "_salt"]})
    left = salted(df, key, hot, spread_by, "_salt")
    same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in key] + [F.col("_salt") == F.col("_of__salt")]
    return left.join(right, same, how).drop("_salt", "_of__salt", *[f"_of_{name}" for name in key])


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "person_id", keep_repeats: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is among the ids.

    With ``keep_repeats`` an id listed twice returns its rows twice.
    """
    return df.join(ids.select(key), key, "inner" if keep_repeats else "left_semi").select(df.columns)


def events_of_persons(events: DataFrame, persons: DataFrame, key: str = "person_id") -> DataFrame:
    """All distinct events of the given persons."""
    return events.join(persons.select(key), key, "left_semi").distinct()
