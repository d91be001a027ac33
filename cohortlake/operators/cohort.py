"""Patient facts and covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.values import completed_age, to_float, to_int

# Facts columns stored as text or wide numbers, and their types.
INT_FACTS = (
    "number_of_visits_before_covid",
    "number_of_visits_post_covid",
    "number_of_COVID_vaccine_doses_before_or_day_of_covid",
    "number_of_COVID_vaccine_doses_post_covid",
)
FLOAT_FACTS = (
    "BMI_max_observed_or_calculated_before_or_day_of_covid",
    "BMI_max_observed_or_calculated_post_covid",
)
FACT_TYPES = dict.fromkeys(("age_at_covid", *INT_FACTS), "int") | dict.fromkeys(FLOAT_FACTS, "float")
EXPOSURE_COLUMNS = (
    "condition_concept_id",
    "condition_source_concept_id",
    "condition_source_value",
    "specific_condition_name",
    "condition_start_date",
    "condition_end_date",
)
INDEX_DATE_RANGE = ("2018-01-01", "2026-12-31")


def patient_facts(
    facts: DataFrame,
    exposure: DataFrame,
    date_range: tuple[str, str] = INDEX_DATE_RANGE,
    index_date: str = "COVID_first_poslab_or_diagnosis_date",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Facts with typed columns, the exposure of each person and a 0/1 flag.

    ``columns`` picks facts columns (all by default). Age, race and sex come out
    as Age, Race and Sex; persons without an index date in the range are left out.
    """
    lo, hi = (F.lit(day).cast("date") for day in date_range)
    special = {"age_at_covid", "race", "sex"}
    ints = {name.lower() for name in INT_FACTS}
    floats = {name.lower() for name in FLOAT_FACTS}
    plain = []
    for name in columns or facts.columns:
        if name.lower() in special:
            continue
        value = F.col(name)
        if name.lower() in ints:
            value = to_int(value)
        elif name.lower() in floats:
            value = to_float(value)
        plain.append(value.alias(name))
    typed = facts.filter(F.col(index_date).between(lo, hi)).select(
        *plain,
        to_int(F.col("age_at_covid")).alias("Age"),
        F.col("race").alias("Race"),
        F.when(F.col("sex").isin("MALE", "FEMALE"), F.col("sex")).alias("Sex"),
    )
    exposed = exposure.select(
        "person_id", *EXPOSURE_COLUMNS, F.col("data_partner_id").alias("lsd_data_partner_id")
    )
    return typed.join(exposed, "person_id", "left").withColumn(
        "has_lsd", F.col("condition_concept_id").isNotNull().cast("int")
    )


def demographics(exposure: DataFrame, person: DataFrame, as_of: str) -> DataFrame:
    """Exposed rows with person attributes and the age completed at a date."""
    known = person.select(
        "person_id",
        "race_concept_id",
        "race_concept_name",
        "gender_concept_id",
        "gender_concept_name",
        "month_of_birth",
        "year_of_birth",
    )
    age = completed_age(F.lit(as_of).cast("date"), F.col("year_of_birth"), F.col("month_of_birth"))
    return exposure.join(known, "person_id", "left").withColumn("Age", age)


def impute_covariates(df: DataFrame) -> DataFrame:
    """Covariates without gaps: median age, "Unknown" sex, "Other/Unknown" race.

    The median is exact; ages are whole years, so its buffer is a small count map.
    """
    median_age = df.agg(F.percentile("Age", F.lit(0.5))).scalar()
    return df.select(
        "person_id",
        "has_lsd",
        F.coalesce("Sex", F.lit("Unknown")).alias("Sex"),
        F.coalesce(F.col("Age").cast("double"), median_age).alias("Age"),
        F.when(F.col("Race") != "Other", F.col("Race")).otherwise("Other/Unknown").alias("Race"),
        "severity_type",
        "data_partner_id",
    )
