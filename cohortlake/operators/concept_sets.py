"""Concept sets, their events and the concept hierarchy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The concept sets and hierarchy roots of the study.
EXPOSURE_SET = 79972333
COVID_DRUG_SET = 373794531
CORTICOSTEROID_SET = 84943298
OUTCOME_DRUG_SET = 439617420
HIERARCHY_ROOTS = (4053270, 37155637)


@dataclass(frozen=True)
class ConceptSet:
    """A concept set by id, in its newest version only or in any version."""

    codeset_id: int
    most_recent_only: bool = True

    def matches(self) -> Column:
        wanted = F.col("codeset_id") == self.codeset_id
        return wanted & F.col("is_most_recent_version") if self.most_recent_only else wanted


def codeset_members(members: DataFrame, sets: Sequence[ConceptSet]) -> DataFrame:
    """Members of any of the sets, each under its own version rule."""
    return members.filter(reduce(Column.__or__, (one.matches() for one in sets)))


def events_in_concept_set(
    events: DataFrame, concept_set: DataFrame, key: str = "condition_concept_id", dedupe: bool = False
) -> DataFrame:
    """Events whose concept is in the set.

    A concept listed several times repeats its events unless ``dedupe`` is set.
    """
    ids = concept_set.select(F.col("concept_id").alias(key))
    return events.join(ids, key, "left_semi" if dedupe else "inner").select(events.columns)


def concept_hierarchy(ancestor: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct ancestor-descendant pairs with names, ancestors limited to ``roots``.

    Pairs are cut down to the roots first and names are deduplicated before they
    are joined, so versions and sets that repeat a name do not multiply rows.
    """
    names = members.select("concept_id", "concept_name").distinct()
    above = names.select(
        F.col("concept_id").alias("ancestor_concept_id"), F.col("concept_name").alias("ancestor_name")
    )
    below = names.select(
        F.col("concept_id").alias("descendant_concept_id"), F.col("concept_name").alias("descendant_name")
    )
    wanted = roots.select(F.col("concept_id").alias("ancestor_concept_id"))
    return (
        ancestor.join(wanted, "ancestor_concept_id", "left_semi")
        .join(above, "ancestor_concept_id")
        .join(below, "descendant_concept_id")
        .select(
            "ancestor_concept_id",
            "ancestor_name",
            "descendant_concept_id",
            "descendant_name",
            "min_levels_of_separation",
            "max_levels_of_separation",
        )
        .distinct()
    )


def most_specific_condition(
    events: DataFrame,
    hierarchy: DataFrame,
    roots: Sequence[int] = HIERARCHY_ROOTS,
    tie_breakers: Sequence[str] = ("condition_concept_id", "condition_source_value"),
) -> DataFrame:
    """Per person the event deepest below the roots, then the latest one.

    NULL levels and dates lose. Ties left after that go to the largest
    tie-breakers, then to the largest remaining values. A maximum over a struct
    combines on the map side, so a person with very many events is no hot spot.
    """
    levels = hierarchy.filter(F.col("ancestor_concept_id").isin(*roots)).select(
        F.col("descendant_concept_id").alias("condition_concept_id"),
        F.col("descendant_name").alias("specific_condition_name"),
        "max_levels_of_separation",
    )
    kept = (
        "condition_concept_id",
        "condition_source_concept_id",
        "condition_source_value",
        "specific_condition_name",
        "condition_start_date",
        "condition_end_date",
        "data_partner_id",
    )
    first = ("max_levels_of_separation", "condition_start_date", *tie_breakers)
    ranking = first + tuple(column for column in kept if column not in first)
    best = (
        events.join(levels, "condition_concept_id")
        .groupBy("person_id")
        .agg(F.max(F.struct(*ranking)).alias("best"))
    )
    return best.select("person_id", *[F.col("best")[column].alias(column) for column in kept])
