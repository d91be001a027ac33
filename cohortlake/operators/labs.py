"""Laboratory measurements: scales, panels, windows and the person-by-lab matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortlake.functions.labels import LAB_SCALE_LABELS, LabelRules, keyword_class
from cohortlake.functions.values import r_names
from cohortlake.operators.ranks import exact_medians
from cohortlake.session import cut_lineage

# Language of the lab synonyms, preferred scales, codes of the panel.
LAB_LANGUAGE = 4180186
SCALE_PRIORITY = ("Qn", "OrdQn", "Nom", "Nar", "Doc", "Set", "Multi", "Pnl")
LAB_CODES = (
    # metabolic panel
    "2345-7", "3094-0", "2160-0", "2951-2", "2823-3", "2075-0", "2028-9",
    "17861-6", "2885-2", "1751-7", "1975-2", "6768-6", "1920-8", "1742-6",
    # vital signs
    "8462-4", "8867-4", "9279-1", "2708-6", "8480-6", "8310-5",
    # pH and haemoglobin
    "11558-4", "718-7",
    # blood counts
    "6690-2", "789-8", "4544-3", "787-2", "785-6", "786-4", "788-0", "777-3",
    "770-8", "736-9", "5905-5", "713-8", "706-2", "751-8", "731-0", "742-7",
    "711-2", "704-7", "71695-1", "53115-2", "58413-6", "92806-9",
    # enzymes
    "55908-8", "62310-8", "55917-9", "55909-6", "62316-5", "55827-0", "79462-8",
    # inflammation and tissue damage
    "1988-5", "2276-4", "42929-0", "26881-3", "75241-0", "10839-9", "42727-8",
    "30934-4", "33211-4", "26848-2",
)


def scale_of_code(
    concept: DataFrame,
    synonym: DataFrame,
    vocabulary: str = "LOINC",
    language: int = LAB_LANGUAGE,
    rules: LabelRules = LAB_SCALE_LABELS,
    priority: Sequence[str] = SCALE_PRIORITY,
) -> DataFrame:
    """Concepts of a vocabulary with the best-ranked scale among their synonyms.

    Synonyms without a letter or in another language do not count; a concept
    with none left is dropped.
    """
    label = keyword_class(F.col("concept_synonym_name"), rules)
    rank = F.coalesce(
        *[F.when(F.col("scale") == name, place) for place, name in enumerate(priority, 1)],
        F.lit(len(priority) + 1),
    )
    best = (
        synonym.filter(
            (F.col("language_concept_id") == language) & F.col("concept_synonym_name").rlike("[A-Za-z]")
        )
        .select("concept_id", label.alias("scale"))
        .groupBy("concept_id")
        .agg(F.min_by("scale", rank).alias("scale"))
    )
    wanted = concept.filter(F.col("vocabulary_id") == vocabulary).select(
        "concept_id",
        "concept_name",
        "domain_id",
        "vocabulary_id",
        "concept_class_id",
        "standard_concept",
        "concept_code",
    )
    return wanted.join(best, "concept_id")


def lab_panel(loinc: DataFrame, codes: Sequence[str] = LAB_CODES) -> DataFrame:
    """The named lab codes with their scale."""
    return loinc.filter(F.col("concept_code").isin(*codes)).select("concept_id", "concept_name", "concept_code", "scale")


def measurements_with_units(
    measurement: DataFrame,
    cohort: DataFrame,
    concept: DataFrame,
    index_date: str = "COVID_first_poslab_or_diagnosis_date",
    severity: str = "severity_type",
) -> DataFrame:
    """Cohort labs that have a value and a unit, with unit code and day offset."""
    complete = measurement.dropna(subset=["harmonized_value_as_number", "harmonized_unit_concept_id"])
    units = concept.select(F.col("concept_id").alias("harmonized_unit_concept_id"), F.col("concept_code").alias("units"))
    persons = cohort.select("person_id", severity, index_date)
    return (
        complete.join(persons, "person_id")
        .join(units, "harmonized_unit_concept_id")
        .select(
            *measurement.columns,
            severity,
            index_date,
            "units",
            F.datediff("measurement_date", index_date).alias("days_diff"),
        )
    )


def measurement_window(labs: DataFrame, concepts: DataFrame, lo: int = 0, hi: int = 3) -> DataFrame:
    """Labs of interest ``lo`` to ``hi`` days from the index date."""
    wanted = concepts.select(F.col("concept_id").alias("measurement_concept_id"))
    return labs.filter(F.col("days_diff").between(lo, hi)).join(wanted, "measurement_concept_id").select(labs.columns)


def worst_values(labs: DataFrame) -> DataFrame:
    """Largest value per person and concept that has rows; the grid without its gaps."""
    value = F.col("harmonized_value_as_number")
    return labs.groupBy("person_id", "measurement_concept_id").agg(
        F.max(F.when(~F.isnan(value), value)).alias("worst_value_as_number")
    )


def worst_value_grid(cohort: DataFrame, labs: DataFrame) -> DataFrame:
    """Every person with every measured concept: the largest value or NULL.

    Each person carries a map of their own values and is unfolded along the list
    of concepts, which is as long as the lab panel. No person-by-concept join.
    """
    # read twice below, for the maps and for the list of concepts
    worst = cut_lineage(worst_values(labs))
    concepts = worst.agg(F.array_sort(F.collect_set("measurement_concept_id"))).scalar()
    own = worst.groupBy("person_id").agg(
        F.map_from_entries(F.collect_list(F.struct("measurement_concept_id", "worst_value_as_number"))).alias("_own")
    )
    return (
        cohort.select("person_id")
        .distinct()
        .join(own, "person_id", "left")
        .select("person_id", "_own", F.explode(concepts).alias("measurement_concept_id"))
        .select(
            "person_id",
            "measurement_concept_id",
            F.try_element_at("_own", "measurement_concept_id").alias("worst_value_as_number"),
        )
    )


def pivot_wide(long: DataFrame, row: str, name: str, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """One row per ``row`` and one column per name, column names made valid and unique.

    Pass ``names`` to fix the columns and to save the job that looks for them.
    """
    wide = long.groupBy(row).pivot(name, list(names) if names is not None else None).agg(F.max(value))
    return wide.toDF(*r_names(wide.columns))


def _quoted(name: str):
    return F.col(f"`{name}`")


def missing_profile(df: DataFrame) -> DataFrame:
    """Share of NULLs of every column, in one pass."""
    shares = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.avg(_quoted(name).isNull().cast("double")).alias("missing_share"),
                )
                for name in df.columns
            ]
        ).alias("shares")
    )
    return shares.select(F.inline("shares"))


def impute_median(
    df: DataFrame, columns: Sequence[str] | None = None, medians: DataFrame | None = None
) -> DataFrame:
    """Fill NULLs with the median of the column; a column of NULLs stays so.

    The medians come from the long form, where they are exact at any size, and
    return to the wide rows as one scalar. Where the long form exists already,
    pass its ``medians`` as (name, median) rows.
    """
    if columns is None:
        columns = [field.name for field in df.schema.fields if isinstance(field.dataType, NumericType)]
    if not columns:
        return df
    if medians is None:
        cells = F.array(
            *[F.struct(F.lit(name).alias("name"), _quoted(name).cast("double").alias("value")) for name in columns]
        )
        medians = exact_medians(df.select(F.inline(cells)), "name", "value")
    by_name = medians.agg(F.map_from_entries(F.collect_list(F.struct("name", "median")))).scalar()
    filled = {name: F.coalesce(_quoted(name), F.try_element_at(by_name, F.lit(name))) for name in columns}
    return df.select(*[filled.get(name, _quoted(name)).alias(name) for name in df.columns])
