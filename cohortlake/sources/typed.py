"""Columns brought to the types the operators expect, and the cells that do not fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.values import to_float, to_int

CASTS = {
    "int": to_int,
    "float": to_float,
    "double": lambda value: value.try_cast("double"),
    "date": lambda value: value.try_cast("date"),
}


def _wanted(df: DataFrame, types: Mapping[str, str]) -> dict[str, str]:
    """The columns of ``df`` whose type differs from the one asked for; names in any case."""
    asked = {name.lower(): kind for name, kind in types.items()}
    unknown = set(asked.values()) - set(CASTS)
    if unknown:
        raise ValueError(f"no cast to {', '.join(sorted(unknown))}")
    return {name: asked[name.lower()] for name, kind in df.dtypes if asked.get(name.lower(), kind) != kind}


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``df`` with the named columns cast; a cell that does not fit becomes NULL.

    Columns that are missing are left out, those that have the type already are untouched.
    """
    return df.withColumns({name: CASTS[kind](F.col(name)) for name, kind in _wanted(df, types).items()})


def rejected_cells(df: DataFrame, types: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """One row for each cell that ``typed`` would lose: the keys, ``column_name``, ``cell``, ``wanted_type``.

    Empty text counts as lost, NULL does not. Cells are unfolded row by row within one
    scan of the keys and the columns to be cast, so only lost ones ever become rows.
    """
    cells: list[Column] = []
    for name, kind in sorted(_wanted(df, types).items()):
        lost = F.col(name).isNotNull() & CASTS[kind](F.col(name)).isNull()
        cell = F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("cell"), F.lit(kind).alias("wanted_type"))
        cells.append(F.when(lost, cell))
    if not cells:
        none = [F.lit(None).cast("string").alias(name) for name in ("column_name", "cell", "wanted_type")]
        return df.select(*keys, *none).filter(F.lit(False))
    return df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("_cell")).select(*keys, "_cell.*")
