"""Diagnosis codes hidden in free source text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeRule:
    """A marker in the text and the side of it on which the code stands."""

    marker: str
    code_is_after: bool


# The spellings that source systems use.
ICD10_RULES = (
    CodeRule("ICD10CM:", True),
    CodeRule(":ICD-10-CM", False),
    CodeRule("|ICD-10-CM", False),
)
ICD9_RULES = (
    CodeRule("ICD9CM:", True),
    CodeRule(":ICD-9-CM", False),
)


def extract_code(text: Column, rules: Sequence[CodeRule] = ICD10_RULES) -> Column:
    """Code by the first rule whose marker occurs in the text, else NULL.

    "After" reads from the last marker on, "before" up to the first one.
    """
    found = [
        F.when(
            text.contains(rule.marker),
            F.substring_index(text, rule.marker, -1 if rule.code_is_after else 1),
        )
        for rule in rules
    ]
    return F.coalesce(*found)
