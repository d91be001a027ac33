"""Source codes to standard codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.codes import ICD9_RULES, ICD10_RULES, extract_code
from cohortlake.operators.joins import frequent_keys, left_lookup, lookup_of_values


CONDITION_COLUMNS = (
    "person_id",
    "condition_concept_id",
    "condition_concept_name",
    "condition_start_date",
    "condition_end_date",
    "condition_source_value",
    "condition_source_concept_id",
)
# Together they tell apart the rows of one person, however many there are.
SPREAD_COLUMNS = ("person_id", "condition_start_date", "condition_concept_id", "condition_source_value")


def code_to_standard_map(
    concept: DataFrame,
    relationship: DataFrame,
    source_vocabularies: Sequence[str] = ("ICD10CM",),
    target_vocabulary: str = "SNOMED",
) -> DataFrame:
    """Source concepts with their "Maps to" targets; unmapped ones are kept.

    The id column comes from the mapping and is NULL for unmapped concepts. A
    target outside the target vocabulary keeps its id but gets no name.
    """
    source = concept.filter(F.col("vocabulary_id").isin(*source_vocabularies)).select(
        F.col("concept_id").alias("_id"),
        F.col("concept_name").alias("icd_concept_name"),
        "domain_id",
        "vocabulary_id",
        "concept_code",
    )
    maps_to = relationship.filter((F.col("relationship_id") == "Maps to") | F.col("relationship_id").isNull()).select(
        F.col("concept_id_1").alias("icd_concept_id"),
        "relationship_id",
        F.col("concept_id_2").alias("snomed_concept_id"),
    )
    targets = concept.filter((F.col("vocabulary_id") == target_vocabulary) | F.col("vocabulary_id").isNull()).select(
        F.col("concept_id").alias("snomed_concept_id"),
        F.col("concept_name").alias("mapped_concept_name"),
        F.col("domain_id").alias("mapped_domain_id"),
        F.col("vocabulary_id").alias("mapped_vocabulary_id"),
    )
    mapped = source.join(maps_to, F.col("_id") == F.col("icd_concept_id"), "left")
    return left_lookup(mapped, targets, "snomed_concept_id", ("_id",)).select(
        "icd_concept_id",
        "icd_concept_name",
        "domain_id",
        "vocabulary_id",
        "concept_code",
        "relationship_id",
        "snomed_concept_id",
        "mapped_concept_name",
        "mapped_domain_id",
        "mapped_vocabulary_id",
    )


def code_if_known(df: DataFrame, text: str, codes: DataFrame, out: str, spread_by: Sequence[str]) -> DataFrame:
    """Add ``out``: the text itself where it is one of the codes, else NULL."""
    known = codes.select(F.col("concept_code").alias("_text")).distinct().withColumn(out, F.col("_text"))
    return left_lookup(df.withColumn("_text", F.col(text)), known, "_text", spread_by).drop("_text")


@dataclass(frozen=True)
class SourceCodes:
    """What is known of each distinct pair of source id and source text.

    ``pairs`` has one row for a pair, or more where the map has several rows for its
    id; ``hot`` are the frequent pairs of the rows it was built from.
    """

    pairs: DataFrame
    hot: Mapping[int, int]


# Source id and text decide all codes of a row.
PAIR = ("condition_source_concept_id", "condition_source_value")


def source_codes(
    conditions: DataFrame,
    code_map: DataFrame,
    icd10: Sequence[str] = ("ICD10CM",),
    icd9: Sequence[str] = ("ICD9CM",),
) -> SourceCodes:
    """Codes by source id and by text, looked up once for each distinct pair.

    The pairs are counted together on the map side, so the lookups see distinct pairs
    instead of rows, and rows meet the result in one join. Frequent ids and texts
    (such as id 0, which stands for "no concept") are spread over all reducers.
    """
    source_id, text = PAIR
    hot_ids, hot_texts, hot_pairs = frequent_keys(conditions, [source_id], [text], PAIR)
    pairs = conditions.select(*PAIR).distinct()
    by_id = code_map.select(
        F.col("icd_concept_id").alias(source_id), "icd_concept_id", "vocabulary_id", "icd_concept_name", "concept_code"
    )
    joined = left_lookup(pairs, by_id, source_id, [text], hot_ids)

    known = (
        code_map.filter(F.col("vocabulary_id").isin(*icd10, *icd9))
        .groupBy(F.col("concept_code").alias("_text"))
        .agg(
            F.max(F.col("vocabulary_id").isin(*icd10)).alias("_is_icd10"),
            F.max(F.col("vocabulary_id").isin(*icd9)).alias("_is_icd9"),
        )
    )
    parts = {"_icd10": extract_code(F.col(text), ICD10_RULES), "_icd9": extract_code(F.col(text), ICD9_RULES)}
    # a text that both rule sets parsed cannot need the lookup
    unparsed = F.when(F.col("_icd10").isNull() | F.col("_icd9").isNull(), F.col(text))
    looked_up = left_lookup(joined.withColumns(parts).withColumn("_text", unparsed), known, "_text", PAIR, hot_texts)
    found = looked_up.withColumns(
        {
            "icd_9_concept_code": F.coalesce("_icd9", F.when(F.col("_is_icd9"), F.col(text))),
            "icd_10_concept_code": F.coalesce("_icd10", F.when(F.col("_is_icd10"), F.col(text))),
        }
    )
    return SourceCodes(found.drop("_icd9", "_icd10", "_is_icd9", "_is_icd10", "_text"), hot_pairs)


def resolve_condition_codes(
    conditions: DataFrame, code_map: DataFrame, keep_unmapped: bool = False, codes: SourceCodes | None = None
) -> DataFrame:
    """Condition rows with one code each: by source id, else ICD-10, else ICD-9 text.

    By default rows without a vocabulary are dropped, which leaves the rows
    matched by id. ``keep_unmapped`` also returns rows whose code was only parsed;
    those have no vocabulary. ``codes`` may come from a table that holds these rows and
    others.
    """
    codes = codes or source_codes(conditions, code_map)
    combined = F.coalesce("concept_code", "icd_10_concept_code", "icd_9_concept_code")
    useful = codes.pairs.withColumn("combined_concept_code", combined).filter("combined_concept_code is not null")
    rows = conditions.select(*CONDITION_COLUMNS, "data_partner_id")
    if not keep_unmapped:
        useful = useful.filter("vocabulary_id is not null")
        rows = rows.filter("condition_source_concept_id is not null")
    return lookup_of_values(rows, useful, PAIR, SPREAD_COLUMNS, codes.hot, "inner").select(
        *CONDITION_COLUMNS,
        "icd_concept_id",
        "vocabulary_id",
        "icd_concept_name",
        "icd_9_concept_code",
        "icd_10_concept_code",
        "concept_code",
        "combined_concept_code",
        "data_partner_id",
    )


def latest_per_code(
    df: DataFrame,
    keys: Sequence[str] = ("person_id", "vocabulary_id", "combined_concept_code"),
    date: str = "condition_start_date",
) -> DataFrame:
    """One row per key with the latest date: an aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max(date).alias(date))


def resolve_condition_codes_wide(
    cohort: DataFrame,
    conditions: DataFrame,
    code_map: DataFrame,
    icd10: Sequence[str] = ("ICD10CM", "ICD10"),
    icd9: Sequence[str] = ("ICD9CM", "ICD9"),
) -> DataFrame:
    """Cohort conditions with ICD-10 codes and the vocabulary recovered by code.

    Every map row with the code counts, so a code with several targets repeats
    its row. All four lookups are made for distinct pairs of source id and text; the
    rows themselves are joined once.
    """
    codes = source_codes(conditions, code_map, icd10, icd9)
    pairs = codes.pairs.withColumn("combined_concept_code", F.coalesce("concept_code", "icd_10_concept_code"))
    for name, vocabularies in (("icd10_vocab_id", icd10), ("icd9_vocab_id", icd9)):
        by_code = code_map.filter(F.col("vocabulary_id").isin(*vocabularies)).select(
            F.col("concept_code").alias("combined_concept_code"), F.col("vocabulary_id").alias(name)
        )
        pairs = left_lookup(pairs, by_code, "combined_concept_code", PAIR)
    flags = cohort.select("person_id", "has_lsd")
    rows = conditions.join(flags, "person_id").distinct()
    return lookup_of_values(rows, pairs, PAIR, SPREAD_COLUMNS, codes.hot).select(
        *CONDITION_COLUMNS,
        "has_lsd",
        "icd_concept_id",
        "vocabulary_id",
        "icd_concept_name",
        "icd_10_concept_code",
        "concept_code",
        "combined_concept_code",
        "data_partner_id",
        "icd10_vocab_id",
        "icd9_vocab_id",
        F.coalesce("vocabulary_id", "icd10_vocab_id", "icd9_vocab_id").alias("combined_vocab_id"),
    )


def match_codes_any_route(cohort: DataFrame, conditions: DataFrame, code_map: DataFrame) -> DataFrame:
    """Distinct cohort conditions found by source id, by exact or by parsed text.

    Each condition offers up to three keys and the map is keyed the same way, so
    one scan and one join serve the three routes.
    """
    flags = cohort.select("person_id", "has_lsd")
    text = F.col("condition_source_value")
    id_key = F.concat(F.lit("id "), F.col("condition_source_concept_id").cast("string"))
    text_key = F.concat(F.lit("code "), text)
    parsed_key = F.concat(F.lit("code "), extract_code(text, ICD10_RULES))
    offered = (
        conditions.join(flags, "person_id")
        .select(
            "person_id",
            "has_lsd",
            "condition_start_date",
            "condition_source_value",
            "condition_source_concept_id",
            "data_partner_id",
            F.explode(F.array_compact(F.array(id_key, text_key, parsed_key))).alias("_key"),
        )
    )
    entry = code_map.select("icd_concept_id", "icd_concept_name", "vocabulary_id", "concept_code").distinct()
    keyed = entry.select(
        "icd_concept_name",
        "vocabulary_id",
        "concept_code",
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("id "), F.col("icd_concept_id").cast("string")),
                    F.concat(F.lit("code "), F.col("concept_code")),
                )
            )
        ).alias("_key"),
    ).distinct()
    return (
        offered.join(keyed, "_key")
        .select(
            "person_id",
            "has_lsd",
            "condition_start_date",
            "condition_source_value",
            "condition_source_concept_id",
            "icd_concept_name",
            "vocabulary_id",
            "concept_code",
            "data_partner_id",
        )
        .distinct()
    )


def map_phecodes(
    codes: DataFrame, phecode_map: DataFrame, code: str = "combined_concept_code", carry: Sequence[str] = ("person_id",)
) -> DataFrame:
    """Phecode rows of each code; by code only, many to many."""
    left = codes.select(*[F.col(column).alias(column) for column in carry], F.col(code).alias("_code"))
    return left.join(phecode_map, F.col("_code") == F.col("code")).select(*carry, *phecode_map.columns)
