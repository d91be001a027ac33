from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import ICD9_RULES, ICD10_RULES, binary_severity, extract_code, hospitalized_label, keyword_class
from cohortlake.functions import to_int
from cohortlake.operators import code_mapping
from cohortlake.operators.comorbidity import CHARLSON_PREFIXES, comorbidity_flags, comorbidity_score, expand_prefixes
from cohortlake.operators.comorbidity import score_by_exposure
from cohortlake.operators.concept_sets import ConceptSet, codeset_members, events_in_concept_set, most_specific_condition
from cohortlake.operators.joins import restrict_to

TEXTS = {
    "ICD10CM:E75.2": ("E75.2", None),
    "x ICD10CM:A ICD10CM:B": ("B", None),
    "E75.2:ICD-10-CM:ICD-10-CM": ("E75.2", None),
    "E75.2|ICD-10-CM": ("E75.2", None),
    "ICD10CM:A:ICD-10-CM": ("A:ICD-10-CM", None),
    "ICD9CM:272.7": (None, "272.7"),
    "272.7:ICD-9-CM": (None, "272.7"),
    "free text": (None, None),
    None: (None, None),
}


def test_extract(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", extract_code(F.col("t"), ICD10_RULES).alias("i10"), extract_code(F.col("t"), ICD9_RULES).alias("i9"))
    assert {r.t: (r.i10, r.i9) for r in rows.collect()} == TEXTS


CONDITIONS = (
    "person_id string, condition_concept_id int, condition_concept_name string, condition_start_date date, "
    "condition_end_date date, condition_source_value string, condition_source_concept_id int, data_partner_id int"
)
MAP = "icd_concept_id int, icd_concept_name string, vocabulary_id string, concept_code string"


def condition(person, text, source=None, day=1, concept=1):
    return (person, concept, "c", date(2020, 1, day), None, text, source, 1)


@pytest.fixture(scope="module")
def code_map(spark):
    rows = [
        (10, "ten", "ICD10CM", "E10"),
        (10, "ten", "ICD10CM", "E10"),
        (None, "loose", "ICD10CM", "E11"),
        (90, "nine", "ICD9CM", "250"),
    ]
    return spark.createDataFrame(rows, MAP)


def test_resolve_with_and_without_unmapped(spark, code_map):
    df = spark.createDataFrame(
        [
            condition("id", "anything", 10),
            condition("known10", "E11"),
            condition("known9", "250"),
            condition("parsed9", "ICD9CM:272.7"),
            condition("nothing", "free text"),
            condition("null", None),
        ],
        CONDITIONS,
    )
    strict = code_mapping.resolve_condition_codes(df, code_map).collect()
    assert [(r.person_id, r.combined_concept_code) for r in strict] == [("id", "E10")] * 2
    loose = code_mapping.resolve_condition_codes(df, code_map, keep_unmapped=True).collect()
    assert {r.person_id: r.combined_concept_code for r in loose} == {
        "id": "E10", "known10": "E11", "known9": "250", "parsed9": "272.7"
    }


def test_any_route_finds_codes_without_id(spark, code_map):
    df = spark.createDataFrame(
        [condition("a", "E11"), condition("b", "E11:ICD-10-CM"), condition("c", "E10", 10), condition("d", "zz")], CONDITIONS
    )
    cohort = spark.createDataFrame([(p, 1) for p in "abcd"] * 2, "person_id string, has_lsd int")
    rows = code_mapping.match_codes_any_route(cohort, df, code_map).collect()
    assert sorted((r.person_id, r.concept_code) for r in rows) == [("a", "E11"), ("b", "E11"), ("c", "E10")]


def test_wide_recovers_the_vocabulary(spark, code_map):
    df = spark.createDataFrame([condition("a", "ICD10CM:E11"), condition("b", "250")], CONDITIONS)
    cohort = spark.createDataFrame([("a", 0), ("b", 1)], "person_id string, has_lsd int")
    rows = {r.person_id: r for r in code_mapping.resolve_condition_codes_wide(cohort, df, code_map).collect()}
    assert rows["a"].combined_vocab_id == "ICD10CM" and rows["b"].combined_concept_code is None


def test_latest(spark):
    df = spark.createDataFrame([("a", "v", "c", date(2020, 1, 1)), ("a", "v", "c", None), ("a", "v", "c", date(2021, 1, 1))],
                               "person_id string, vocabulary_id string, combined_concept_code string, condition_start_date date")
    assert [r.condition_start_date for r in code_mapping.latest_per_code(df).collect()] == [date(2021, 1, 1)]


def test_version_rule_per_set(spark):
    df = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", False), (2, 3, "c", False), (3, 4, "d", True)],
                               "codeset_id int, concept_id int, concept_name string, is_most_recent_version boolean")
    sets = (ConceptSet(1), ConceptSet(2, most_recent_only=False))
    assert sorted(r.concept_id for r in codeset_members(df, sets).collect()) == [1, 3]


def test_repeated_members_repeat_events(spark):
    events = spark.createDataFrame([condition("a", "t")], CONDITIONS)
    members = spark.createDataFrame([(1,), (1,)], "concept_id int")
    assert events_in_concept_set(events, members).count() == 2
    assert events_in_concept_set(events, members, dedupe=True).count() == 1
    assert events_in_concept_set(events, members.limit(0)).count() == 0
    ids = spark.createDataFrame([("a",), ("a",)], "person_id string")
    assert restrict_to(events, ids).count() == 1
    assert restrict_to(events, ids, keep_repeats=True).count() == 2


def test_most_specific_ties(spark):
    hierarchy = spark.createDataFrame(
        [(0, 1, "one", 2), (0, 2, "two", 2), (0, 3, "three", None), (9, 1, "deep", 7)],
        "ancestor_concept_id int, descendant_concept_id int, descendant_name string, max_levels_of_separation int",
    )
    events = spark.createDataFrame(
        [
            condition("date", "t", day=1, concept=2), condition("date", "t", day=2, concept=1),
            condition("tie", "t", concept=1), condition("tie", "t", concept=2),
            condition("level", "t", day=9, concept=3), condition("level", "t", day=1, concept=1),
        ],
        CONDITIONS,
    )
    rows = {r.person_id: r.specific_condition_name for r in most_specific_condition(events, hierarchy, (0,)).collect()}
    assert rows == {"date": "one", "tie": "two", "level": "one"}


def test_labels(spark):
    mild = "Mild_No_ED_or_Hosp_around_COVID_index"
    df = spark.createDataFrame([(mild,), ("Death_within_n_days_after_COVID_index",), ("odd",), (None,)], "s string")
    rows = df.select("s", binary_severity(F.col("s")).alias("b"), hospitalized_label(F.col("s")).alias("h")).collect()
    assert {r.s: r.b for r in rows} == {mild: 0, "Death_within_n_days_after_COVID_index": 1, "odd": None, None: None}
    assert {r.s: r.h == "Hospitalized" for r in rows}[None] is True
    names = spark.createDataFrame([("PAXLOVID 5",), ("x",), (None,)], "n string")
    rules = (("paxlovid", ("ritonavir", "paxlovid")), ("x", ("x",)))
    assert [r[0] for r in names.select(keyword_class(F.col("n"), rules)).collect()] == ["paxlovid", "x", "Other"]


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([("41",), ("12.0",), ("n/a",), (None,), ("99999999999",)], "t string")
    assert [r[0] for r in df.select(to_int(F.col("t"))).collect()] == [41, 12, None, None, None]


def test_prefix_ranges():
    assert expand_prefixes("I425-I427 C00-C02 E10-E11|05") == [
        "I425", "I426", "I427", "C00", "C01", "C02", "E100", "E105", "E110", "E115"
    ]
    for prefixes in CHARLSON_PREFIXES.values():
        assert all(len(p) in (3, 4) for p in expand_prefixes(prefixes))


def test_comorbidity(spark):
    rows = [("a", "ICD10CM", "e11.2"), ("a", "ICD10CM", "E11.9"), ("a", "SNOMED", "I21"), ("b", "ICD10CM", "C77.0"),
            ("b", "ICD10CM", "C50"), ("c", "SNOMED", "I21"), ("d", "ICD10CM", "Z00")]
    codes = spark.createDataFrame(rows, "person_id string, vocabulary_id string, combined_concept_code string")
    flags = comorbidity_flags(codes)
    got = {r.person_id: r for r in comorbidity_score(flags).collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"].diab, got["a"].diabwc, got["a"].mi, got["a"].score) == (1, 1, 0, 1)
    assert got["b"].score == 8 and got["d"].score == 0
    strict = {r.person_id: r for r in comorbidity_score(comorbidity_flags(codes, assign0=True)).collect()}
    assert strict["a"].diab == 0 and strict["b"].score == 6
    conditions = spark.createDataFrame([("a", 1), ("a", 1), ("d", 0)], "person_id string, has_lsd int")
    joined = {(r.person_id, r.score, r.has_lsd) for r in score_by_exposure(comorbidity_score(flags), conditions).collect()}
    assert joined == {("a", 1, 1), ("b", 8, None), ("d", 0, 0)}
