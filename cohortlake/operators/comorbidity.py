"""Comorbidity categories from diagnosis code prefixes, and weighted scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Charlson categories in ICD-10 by Quan et al. 2005. A range covers
# every prefix between its ends; a "|" entry crosses stems with last digits.
CHARLSON_PREFIXES: Mapping[str, str] = {
    "mi": "I21 I22 I252",
    "chf": "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290",
    "pvd": "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959",
    "cevd": "G45 G46 H340 I60-I69",
    "dementia": "F00-F03 F051 G30 G311",
    "cpd": "I278 I279 J40-J47 J60-J67 J684 J701 J703",
    "rheumd": "M05 M06 M315 M32-M34 M351 M353 M360",
    "pud": "K25-K28",
    "mld": "B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944",
    "diab": "E10-E14|01689",
    "diabwc": "E10-E14|23457",
    "hp": "G041 G114 G801 G802 G81 G82 G830-G834 G839",
    "rend": "I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992",
    "canc": "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97",
    "msld": "I850 I859 I864 I982 K704 K711 K721 K729 K765-K767",
    "metacanc": "C77-C80",
    "aids": "B20-B22 B24",
}
# Elixhauser categories in ICD-10 by Quan et al. 2005.
ELIXHAUSER_PREFIXES: Mapping[str, str] = {
    "chf": "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290",
    "carit": "I441-I443 I456 I459 I47-I49 R000 R001 R008 T821 Z450 Z950",
    "valv": "A520 I05-I08 I091 I098 I34-I39 Q230-Q233 Z952-Z954",
    "pcd": "I26 I27 I280 I288 I289",
    "pvd": "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959",
    "hypunc": "I10",
    "hypc": "I11-I13 I15",
    "para": "G041 G114 G801 G802 G81 G82 G830-G834 G839",
    "ond": "G10-G13 G20-G22 G254 G255 G312 G318 G319 G32 G35-G37 G40 G41 G931 G934 R470 R56",
    "cpd": "I278 I279 J40-J47 J60-J67 J684 J701 J703",
    "diabunc": "E10-E14|019",
    "diabc": "E10-E14|2345678",
    "hypothy": "E00-E03 E890",
    "rf": "I120 I131 N18 N19 N250 Z490-Z492 Z940 Z992",
    "ld": "B18 I85 I864 I982 K70 K711 K713-K715 K717 K72-K74 K760 K762-K769 Z944",
    "pud": "K257 K259 K267 K269 K277 K279 K287 K289",
    "aids": "B20-B22 B24",
    "lymph": "C81-C85 C88 C96 C900 C902",
    "metacanc": "C77-C80",
    "solidtum": "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C97",
    "rheumd": "L940 L941 L943 M05 M06 M08 M120 M123 M30 M310-M313 M32-M35 M45 M461 M468 M469",
    "coag": "D65-D68 D691 D693-D696",
    "obes": "E66",
    "wloss": "E40-E46 R634 R64",
    "fed": "E222 E86 E87",
    "blane": "D500",
    "dane": "D508 D509 D51-D53",
    "alcohol": "F10 E52 G621 I426 K292 K700 K703 K709 T51 Z502 Z714 Z721",
    "drug": "F11-F16 F18 F19 Z715 Z722",
    "psycho": "F20 F22-F25 F28 F29 F302 F312 F315",
    "depre": "F204 F313-F315 F32 F33 F341 F412 F432",
}
# Weights by Quan et al. 2011.
CHARLSON_WEIGHTS: Mapping[str, int] = {
    "mi": 0, "chf": 2, "pvd": 0, "cevd": 0, "dementia": 2, "cpd": 1, "rheumd": 1, "pud": 0, "mld": 2,
    "diab": 0, "diabwc": 1, "hp": 2, "rend": 1, "canc": 2, "msld": 4, "metacanc": 6, "aids": 4,
}
# Milder form, then the severe form that replaces it when forms must not add up.
CHARLSON_HIERARCHY = (("mld", "msld"), ("diab", "diabwc"), ("canc", "metacanc"))
ELIXHAUSER_HIERARCHY = (("hypunc", "hypc"), ("diabunc", "diabc"), ("solidtum", "metacanc"))


def expand_prefixes(text: str) -> list[str]:
    """Prefixes named by a text of codes and ranges."""
    prefixes = []
    for entry in text.split():
        span, _, digits = entry.partition("|")
        first, _, last = span.partition("-")
        stem, width = first[0], len(first) - 1
        numbers = range(int(first[1:]), int((last or first)[1:]) + 1)
        for number in numbers:
            code = f"{stem}{number:0{width}d}"
            prefixes.extend([code + digit for digit in digits] if digits else [code])
    return prefixes


def _has_prefix(code: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for length in sorted({len(prefix) for prefix in prefixes}):
        hit = hit | F.substring(code, 1, length).isin(*[p for p in prefixes if len(p) == length])
    return hit


def comorbidity_flags(
    codes: DataFrame,
    person: str = "person_id",
    code: str = "combined_concept_code",
    mapping: Mapping[str, str] = CHARLSON_PREFIXES,
    assign0: bool = False,
    hierarchy: Sequence[tuple[str, str]] | None = None,
    vocabulary: str = "ICD10CM",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per person a 0/1 column for each category; persons without codes are absent.

    With ``assign0`` a mild category is 0 where its severe form is 1, by the pairs of
    ``hierarchy``; left out, by those of the known maps whose categories ``mapping`` has.
    ``carry`` names attributes of the person to keep.

    One conditional maximum per category over prefix lookups: no join, and the
    shuffle carries one row of flags per person and map task.
    """
    bare = F.upper(F.regexp_replace(code, "[^A-Za-z0-9]", ""))
    rows = codes.filter(F.col("vocabulary_id") == vocabulary).select(person, *carry, bare.alias("_code"))
    flags = rows.groupBy(person, *carry).agg(
        *[
            F.max(F.when(_has_prefix(F.col("_code"), expand_prefixes(prefixes)), 1).otherwise(0)).alias(category)
            for category, prefixes in mapping.items()
        ]
    )
    if assign0:
        if hierarchy is None:
            known = (*CHARLSON_HIERARCHY, *ELIXHAUSER_HIERARCHY)
            hierarchy = [pair for pair in known if set(pair) <= set(mapping)]
        flags = flags.withColumns(
            {mild: F.when(F.col(severe) == 1, 0).otherwise(F.col(mild)) for mild, severe in hierarchy}
        )
    return flags


def comorbidity_score(flags: DataFrame, weights: Mapping[str, int] = CHARLSON_WEIGHTS) -> DataFrame:
    """Flags with their weighted sum as ``score``."""
    total = sum((F.col(name) * weight for name, weight in weights.items()), F.lit(0))
    return flags.withColumn("score", total)


def score_by_exposure(scores: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """Distinct (person, score, has_lsd).

    Scores that carry ``has_lsd`` need no conditions and no join; else exposure flags
    are taken from the conditions and made distinct first.
    """
    if conditions is None:
        return scores.select("person_id", "score", "has_lsd").distinct()
    flags = conditions.select("person_id", "has_lsd").distinct()
    return scores.select("person_id", "score").distinct().join(flags, "person_id", "left")


def score_histogram(df: DataFrame, score: str = "score", by: str | None = None) -> DataFrame:
    """Persons per score, or per score and group."""
    return df.groupBy(score, *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"))
