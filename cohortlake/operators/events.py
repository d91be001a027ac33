"""Events around an index date, deaths and survival times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.labels import binary_severity
from cohortlake.functions.values import to_int

STUDY_END = "2024-12-31"


def index_window_join(
    events: DataFrame,
    cohort: DataFrame,
    event_date: str,
    index_date: str = "COVID_first_poslab_or_diagnosis_date",
    lo: int = 0,
    hi: int = 30,
    carry: Sequence[str] = ("severity_type",),
    index_range: tuple[str, str] | None = None,
) -> DataFrame:
    """Events of the cohort ``lo`` to ``hi`` days from each person's index date.

    Where the range of index dates is known, the events are also bounded by
    literal dates, which reach the scan and prune files and row groups.
    """
    persons = cohort.select("person_id", index_date, *carry)
    if index_range is not None:
        first, last = (F.lit(day).cast("date") for day in index_range)
        events = events.filter(F.col(event_date).between(F.date_add(first, lo), F.date_add(last, hi)))
    offset = F.datediff(event_date, index_date)
    return (
        events.join(persons, "person_id")
        .filter(offset.between(lo, hi))
        .select(*events.columns, *carry, index_date, offset.alias("days_diff"))
    )


def severity_outcome_drugs(
    drugs: DataFrame,
    facts: DataFrame,
    concept_set: DataFrame,
    index_date: str = "COVID_first_poslab_or_diagnosis_date",
    lo: int = 0,
    hi: int = 30,
    dedupe: bool = False,
) -> DataFrame:
    """Drug rows ending in the window, with severity and demographics; complete cases."""
    complete = facts.select(
        "person_id",
        index_date,
        "severity_type",
        to_int(F.col("age_at_covid")).alias("age_at_covid"),
        "race",
        "sex",
        "data_partner_id",
    ).dropna(subset=["age_at_covid", "sex", "race", "severity_type", "data_partner_id"])
    ids = concept_set.select(F.col("concept_id").alias("drug_concept_id"))
    wanted = drugs.select("person_id", "drug_concept_id", "drug_concept_name", "drug_exposure_end_date").join(
        ids, "drug_concept_id", "left_semi" if dedupe else "inner"
    )
    offset = F.datediff("drug_exposure_end_date", index_date)
    return (
        wanted.join(complete, "person_id")
        .filter(offset.between(lo, hi))
        .select(
            "person_id",
            offset.alias("days_diff"),
            index_date,
            "drug_exposure_end_date",
            "severity_type",
            "drug_concept_name",
            binary_severity(F.col("severity_type")).alias("Binary_Severity"),
            "age_at_covid",
            "race",
            "sex",
            "data_partner_id",
        )
    )


def death_summary(
    death: DataFrame,
    cohort: DataFrame,
    index_date: str = "COVID_first_poslab_or_diagnosis_date",
    severity: str = "severity_type",
) -> DataFrame:
    """One row per deceased cohort member, causes and types as lists.

    The three lists come from the same records in one order, by cause id, cause name
    and type, NULLs first and left out. Repeated records are counted before they are
    shuffled, so the lists are built from distinct records and their counts. The earliest
    date and the smallest partner stand for the person.
    """
    listed = ("cause_concept_id", "cause_concept_name", "death_type_concept_id")
    counted = (
        death.filter(F.col("death_date").isNotNull())
        .groupBy("person_id", *listed)
        .agg(
            F.count(F.lit(1)).cast("int").alias("_n"),
            F.min("death_date").alias("death_date"),
            F.min("data_partner_id").alias("data_partner_id"),
        )
    )

    def joined_list(column: str):
        repeated = F.transform("_records", lambda one: F.array_repeat(one[column].cast("string"), one["_n"]))
        return F.concat_ws(";", F.flatten(repeated)).alias(column)

    people = (
        counted.groupBy("person_id")
        .agg(
            F.array_sort(F.collect_list(F.struct(*listed, "_n"))).alias("_records"),
            F.min("death_date").alias("death_date"),
            F.min("data_partner_id").alias("data_partner_id"),
        )
        .select("person_id", *[joined_list(column) for column in listed], "death_date", "data_partner_id")
    )
    offset = F.datediff("death_date", index_date)
    return (
        people.join(cohort.select("person_id", index_date, severity), "person_id")
        .filter(offset >= 0)
        .select(*people.columns, offset.alias("days_diff"), severity)
    )


def survival_table(
    exposures: DataFrame,
    deaths: DataFrame,
    keys: Sequence[str],
    end_date: str,
    study_end: str = STUDY_END,
    out_date: str | None = None,
) -> DataFrame:
    """Per person and exposure: days from the last date to death or study end.

    Exposures shrink to one row per person and exposure before they meet the
    deaths, so the join carries no repeated events.
    """
    out_date = out_date or end_date
    last = exposures.groupBy("person_id", *keys).agg(F.max(end_date).alias(out_date)).filter(F.col(out_date).isNotNull())
    died = deaths.select("person_id", "death_date").distinct()
    days = F.coalesce(F.datediff("death_date", out_date), F.datediff(F.lit(study_end).cast("date"), out_date))
    return (
        last.join(died, "person_id", "left")
        .withColumn("days", days)
        .filter(F.col("days") >= 0)
        .select(
            "person_id",
            *keys,
            "death_date",
            "days",
            out_date,
            F.col("death_date").isNotNull().cast("int").alias("status"),
        )
    )
