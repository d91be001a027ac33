"""Casts, ages and column names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(value: Column) -> Column:
    """Integer part of a number or numeric text; NULL where there is none."""
    return value.try_cast("double").try_cast("int")


def to_float(value: Column) -> Column:
    """Number or numeric text as float; NULL where there is none."""
    return value.try_cast("float")


def completed_age(as_of: Column, birth_year: Column, birth_month: Column) -> Column:
    """Years completed at a date; births count as the first of their month."""
    months = F.month(as_of) - F.coalesce(birth_month, F.lit(1))
    return F.year(as_of) - birth_year - (months < 0).cast("int")


def r_name(name: str) -> str:
    """Column name made valid: odd characters become dots, odd starts get an X."""
    dotted = re.sub(r"[^A-Za-z0-9._]", ".", name)
    return dotted if re.match(r"[A-Za-z]|\.(?![0-9])", dotted) else "X" + dotted


def r_names(names: Sequence[str]) -> list[str]:
    """Valid column names, those that would be equal numbered: ``Hb``, ``Hb.1``."""
    taken: set[str] = set()
    out = []
    for name in map(r_name, names):
        unique, number = name, 0
        while unique.lower() in taken:
            number += 1
            unique = f"{name}.{number}"
        taken.add(unique.lower())
        out.append(unique)
    return out
