"""Parquet tables in and out, with the columns the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlake.session import PARTITION_BYTES

# Columns the operators name. Other columns pass through.
SCHEMAS = {
    "condition_occurrence": "person_id string, condition_concept_id int, condition_concept_name string, "
    "condition_start_date date, condition_end_date date, condition_source_value string, "
    "condition_source_concept_id int, data_partner_id int",
    "concept": "concept_id int, concept_name string, domain_id string, vocabulary_id string, "
    "concept_class_id string, standard_concept string, concept_code string",
    "concept_relationship": "concept_id_1 int, concept_id_2 int, relationship_id string",
    "concept_ancestor": "ancestor_concept_id int, descendant_concept_id int, "
    "min_levels_of_separation int, max_levels_of_separation int",
    "concept_set_members": "codeset_id int, concept_id int, concept_name string, is_most_recent_version boolean",
    "concept_synonym": "concept_id int, concept_synonym_name string, language_concept_id int",
    "phecode_map": "code string",
    "person": "person_id string, race_concept_id int, race_concept_name string, gender_concept_id int, "
    "gender_concept_name string, month_of_birth int, year_of_birth int",
    "patient_facts": "person_id string, age_at_covid string, sex string, race string, severity_type string, "
    "data_partner_id int",
    "drug_exposure": "person_id string, drug_concept_id int, drug_concept_name string, "
    "drug_exposure_start_date date, drug_exposure_end_date date",
    "procedure_occurrence": "person_id string, procedure_concept_id int, procedure_concept_name string, "
    "procedure_date date",
    "measurement": "person_id string, measurement_concept_id int, harmonized_value_as_number double, "
    "harmonized_unit_concept_id int, measurement_date date",
    "death": "person_id string, death_date date, cause_concept_id int, cause_concept_name string, "
    "death_type_concept_id int, data_partner_id int",
}


# Spark's own limit.
MOST_BUCKETS = 100_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; fails early, by name, when a needed column is missing."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    have = {column.lower() for column in df.columns}
    needed = [part.split()[0] for part in SCHEMAS.get(name, "").split(",") if part.strip()]
    missing = [column for column in needed if column.lower() not in have]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def write_table(df: DataFrame, folder: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    """Store a result; partition large event tables by a date or partner column."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{name}.parquet")


def write_bucketed(
    df: DataFrame, folder: str, name: str, key: str = "person_id", buckets: int | None = None
) -> DataFrame:
    """Store a table in buckets of the key and return it.

    Tables with the same key and number of buckets join and aggregate on it
    without a shuffle, which pays for events that many results read. A bucket is
    one task, so a table in which few persons hold most rows is better left plain.
    Left out, the number of buckets follows from Spark's estimate of the table's size;
    give it where tables of different size are to be joined.
    """
    spark = df.sparkSession
    if buckets is None:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        buckets = min(MOST_BUCKETS, max(1, -(-size // PARTITION_BYTES)))
    # one task writes one bucket, so the files do not multiply
    clustered = df.repartition(buckets, key)
    clustered.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option(
        "path", f"{folder}/{name}.parquet"
    ).saveAsTable(name)
    return spark.table(name)
