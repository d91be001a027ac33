from datetime import date

import pytest

from cohortlake.functions import r_name
from cohortlake.operators import labs


@pytest.fixture(scope="module")
def cohort(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "person_id string")


@pytest.fixture(scope="module")
def values(spark):
    rows = [("a", 1, 2.0), ("a", 1, 5.0), ("a", 2, None), ("b", 2, 7.0), ("b", 1, float("nan"))]
    return spark.createDataFrame(rows, "person_id string, measurement_concept_id int, harmonized_value_as_number double")


def test_grid_has_every_cell(cohort, values):
    rows = labs.worst_value_grid(cohort, values).collect()
    got = {(r.person_id, r.measurement_concept_id): r.worst_value_as_number for r in rows}
    assert len(rows) == 6
    assert got == {("a", 1): 5.0, ("a", 2): None, ("b", 1): None, ("b", 2): 7.0, ("c", 1): None, ("c", 2): None}


def test_pivot_names_and_median(spark, cohort):
    long = spark.createDataFrame(
        [("a", "Na+ [mmol/L]", 1.0), ("b", "Na+ [mmol/L]", 4.0), ("a", "2nd lab", None)],
        "person_id string, name string, v double",
    )
    wide = labs.pivot_wide(long, "person_id", "name", "v", ["Na+ [mmol/L]", "2nd lab"])
    assert wide.columns == ["person_id", "Na...mmol.L.", "X2nd.lab"]
    full = cohort.distinct().join(wide, "person_id", "left")
    shares = {r.column_name: r.missing_share for r in labs.missing_profile(full).collect()}
    assert shares["Na...mmol.L."] == pytest.approx(1 / 3) and shares["X2nd.lab"] == 1.0
    filled = {r[0]: r[1:] for r in labs.impute_median(full).collect()}
    assert filled == {"a": (1.0, None), "b": (4.0, None), "c": (2.5, None)}


@pytest.mark.parametrize(
    "name, valid", [("a b", "a.b"), ("1x", "X1x"), (".2", "X.2"), (".a", ".a"), ("_a", "X_a"), ("", "X")]
)
def test_valid_names(name, valid):
    assert r_name(name) == valid


def test_scale_rank_and_language(spark):
    concept = spark.createDataFrame(
        [(i, f"n{i}", "d", "LOINC", "c", "S", f"{i}-0") for i in (1, 2, 3, 4)] + [(5, "n", "d", "SNOMED", "c", "S", "5")],
        "concept_id int, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, "
        "standard_concept string, concept_code string",
    )
    synonym = spark.createDataFrame(
        [
            (1, "Panel of things", labs.LAB_LANGUAGE),
            (1, "QUANTITATIVE", labs.LAB_LANGUAGE),
            (2, "quantitative or ordinal", labs.LAB_LANGUAGE),
            (3, "1234", labs.LAB_LANGUAGE),
            (3, "Nominal", 1),
            (4, "an offset", labs.LAB_LANGUAGE),
            (5, "Nominal", labs.LAB_LANGUAGE),
        ],
        "concept_id int, concept_synonym_name string, language_concept_id int",
    )
    got = {r.concept_id: r.scale for r in labs.scale_of_code(concept, synonym).collect()}
    assert got == {1: "Qn", 2: "OrdQn", 4: "Set"}


def test_panel_codes_are_distinct():
    assert len(labs.LAB_CODES) == len(set(labs.LAB_CODES)) == 61


def test_units_and_window(spark):
    measurement = spark.createDataFrame(
        [("a", 1, 2.0, 9, date(2020, 1, 4)), ("a", 1, None, 9, date(2020, 1, 1)), ("a", 1, 3.0, None, date(2020, 1, 1)),
         ("a", 1, 4.0, 9, date(2020, 1, 5))],
        "person_id string, measurement_concept_id int, harmonized_value_as_number double, "
        "harmonized_unit_concept_id int, measurement_date date",
    )
    cohort = spark.createDataFrame([("a", "m", date(2020, 1, 1))], "person_id string, severity_type string, idx date")
    concept = spark.createDataFrame([(9, "mg"), (1, "lab")], "concept_id int, concept_code string")
    rows = labs.measurements_with_units(measurement, cohort, concept, "idx")
    assert sorted((r.harmonized_value_as_number, r.units, r.days_diff) for r in rows.collect()) == [(2.0, "mg", 3), (4.0, "mg", 4)]
    assert [r.days_diff for r in labs.measurement_window(rows, concept.filter("concept_id = 1")).collect()] == [3]
