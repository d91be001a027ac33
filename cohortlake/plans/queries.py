"""One query per operator over the study tables of a test folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import (
    DRUG_LABELS,
    PROCEDURE_LABELS,
    binary_severity,
    extract_code,
    hospitalized_label,
    keyword_class,
)
from cohortlake.operators import code_mapping, comorbidity, concept_sets, events, joins, labs, matching
from cohortlake.operators import cohort as cohorts
from cohortlake.operators import regression, survival
from cohortlake.operators.concept_sets import ConceptSet
from cohortlake.plans.study import Study, StudyParameters
from cohortlake.session import tune
from cohortlake.sources.bindings import StudyTables
from cohortlake.sources.typed import rejected_cells, typed

Query = Callable[[SparkSession, str], DataFrame]

TEST_PARAMETERS = StudyParameters(
    exposure_sets=(ConceptSet(1),),
    roots=(0, 1),
    treatment_sets=(ConceptSet(2), ConceptSet(3, most_recent_only=False)),
    outcome_drug_sets=(ConceptSet(4, most_recent_only=False),),
    index_date="covid_index_date",
    index_range=("1995-01-01", "2000-12-31"),
    study_end="2002-12-31",
    ages_at="2002-06-15",
    lab_codes=("C2", "C6", "C10", "C14", "C18", "C22", "C26"),
    lab_name="concept_code",
    group_floor=10,
    matched=False,
    kept=False,
)
INDEX_DATE = TEST_PARAMETERS.index_date
RISK_TIMES = (0, 500, 1000, 2000)


def study(spark: SparkSession, folder: str, matched: bool = False, **changed: object) -> Study:
    """The study on the test tables; unmatched, all persons with facts are the cohort."""
    tune(spark)
    tables = StudyTables(spark, folder)
    return Study(tables, replace(TEST_PARAMETERS, matched=matched, kept=matched, **changed))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({column: F.round(column, digits) for column in columns})


def _codeset_members(s: Study) -> DataFrame:
    return s.exposure_set


def _codeset_members_any(s: Study) -> DataFrame:
    return concept_sets.codeset_members(s.tables["concept_set_members"], s.params.treatment_sets)


def _events_in_concept_set(s: Study) -> DataFrame:
    return s.exposure_events


def _events_in_concept_set_distinct(s: Study) -> DataFrame:
    members = _codeset_members_any(s)
    return concept_sets.events_in_concept_set(s.tables["drug_exposure"], members, "drug_concept_id", dedupe=True)


def _extract_code(s: Study) -> DataFrame:
    text = F.col("condition_source_value")
    return s.tables["condition_occurrence"].select(
        "person_id", "condition_start_date", "condition_source_value", extract_code(text).alias("code")
    )


def _code_if_known(s: Study) -> DataFrame:
    rows = s.tables["condition_occurrence"].select("person_id", "condition_start_date", "condition_source_value")
    return code_mapping.code_if_known(rows, "condition_source_value", s.code_map, "code", ("person_id", "condition_start_date"))


def _resolve(s: Study) -> DataFrame:
    return code_mapping.resolve_condition_codes(s.tables["condition_occurrence"], s.code_map, codes=s.source_codes)


def _resolve_all(s: Study) -> DataFrame:
    conditions = s.tables["condition_occurrence"]
    return code_mapping.resolve_condition_codes(conditions, s.code_map, keep_unmapped=True, codes=s.source_codes)


def _match_nearest(s: Study) -> DataFrame:
    """Nearest age within the partner; the score is plain, so SQL can check it."""
    scored = s.covariates.withColumn("score", F.col("Age"))
    return matching.match_nearest(scored)


def _restrict_to(s: Study) -> DataFrame:
    return joins.restrict_to(s.tables["patient_facts"], s.specific_conditions)


def _typed_table(s: Study) -> DataFrame:
    return typed(s.tables["patient_facts"], cohorts.FACT_TYPES)


def _rejected_cells(s: Study) -> DataFrame:
    return rejected_cells(s.tables["patient_facts"], cohorts.FACT_TYPES, ("person_id",))


def _binary_severity(s: Study) -> DataFrame:
    level = F.col("severity_type")
    return s.tables["patient_facts"].select("person_id", "severity_type", binary_severity(level).alias("Binary_Severity"))


def _measurements(s: Study) -> DataFrame:
    return s.cohort_labs


def _worst_value_grid(s: Study) -> DataFrame:
    return labs.worst_value_grid(s.cohort, s.panel_labs)


def _pivot_wide(s: Study) -> DataFrame:
    return labs.pivot_wide(s.worst_labs, "person_id", "name", "worst_value_as_number", s.params.lab_codes)


def _missing_profile(s: Study) -> DataFrame:
    return rounded(labs.missing_profile(s.lab_matrix_with_gaps), "missing_share", digits=9)


def _impute_median(s: Study) -> DataFrame:
    return rounded(s.lab_matrix, *s.params.lab_codes)


def _impute_median_wide(s: Study) -> DataFrame:
    """Medians taken from the wide table itself."""
    return rounded(labs.impute_median(s.lab_matrix_with_gaps), *s.params.lab_codes)


def _keyword_class_procedures(s: Study) -> DataFrame:
    name = F.col("procedure_concept_name")
    return s.tables["procedure_occurrence"].select(
        "person_id", "procedure_date", "procedure_concept_name", keyword_class(name, PROCEDURE_LABELS).alias("procedure_name")
    )


def _keyword_class(s: Study) -> DataFrame:
    name = F.col("concept_name")
    return s.tables["concept_set_members"].select(
        "codeset_id", "concept_id", "concept_name", keyword_class(name, DRUG_LABELS).alias("drug_name")
    )


KM_VALUES = ("estimate", "std_error", "conf_high", "conf_low")


def _kaplan_meier(s: Study) -> DataFrame:
    return rounded(s.drug_survival, *KM_VALUES)


def _kaplan_meier_procedures(s: Study) -> DataFrame:
    return rounded(s.procedure_survival, *KM_VALUES)


def _kaplan_meier_all_rows(s: Study) -> DataFrame:
    km = survival.kaplan_meier(s.drug_survival_rows, strata="drug_name", distinct_rows=False)
    return rounded(km, *KM_VALUES)


def _risk_table(s: Study) -> DataFrame:
    return survival.risk_table(s.drug_survival, RISK_TIMES)


def _propensity_score(s: Study) -> DataFrame:
    scored = regression.propensity_score(s.covariates)
    return rounded(scored.select("person_id", "has_lsd", "Age", "Race", "Sex", "score"), "score")


def _propensity_equations(s: Study) -> DataFrame:
    """Sums over the scores of the full fit, which must be those over the exposure."""
    covariates = s.params.score_covariates
    scored = regression.propensity_score(s.covariates, covariates=covariates)
    return rounded(regression.score_equations(scored, "has_lsd", "score", covariates), "observed", "fitted", digits=3)


def _severity_equations(s: Study) -> DataFrame:
    """The same for the severity model with all its terms."""
    terms = s.params.severity_terms
    scored = regression.propensity_score(s.severity_counts, "Binary_Severity", terms, count="n_rows")
    sums = regression.score_equations(scored, "Binary_Severity", "score", terms, count="n_rows")
    return rounded(sums, "observed", "fitted", digits=3)


def _propensity_one_factor(s: Study) -> DataFrame:
    scored = regression.propensity_score(s.covariates, covariates=("Race",))
    return rounded(scored.select("person_id", "has_lsd", "Race", "score"), "score")


TERM_VALUES = ("estimate", "std_error", "statistic", "conf_low", "conf_high")


def _one_factor_terms(s: Study) -> DataFrame:
    return regression.logistic_terms(s.covariates, "has_lsd", ("Race",))


def _logistic_terms(s: Study) -> DataFrame:
    return rounded(_one_factor_terms(s), *TERM_VALUES, "p_value", digits=5)


def _odds_ratios(s: Study) -> DataFrame:
    odds = regression.odds_ratios(_one_factor_terms(s))
    return rounded(odds.select("term", "odds_ratio", "top_ci", "bottom_ci"), "odds_ratio", "top_ci", "bottom_ci", digits=5)


def _profile_bounds(s: Study) -> DataFrame:
    return rounded(regression.profile_bounds(s.covariates, "has_lsd", ("Race",)), "estimate", "conf_low", "conf_high", digits=5)


def _min_group_size(s: Study) -> DataFrame:
    return regression.min_group_size(s.outcome_drugs, "drug_concept_name", s.params.group_floor)


def _hospitalized_label(s: Study) -> DataFrame:
    return s.tables["patient_facts"].select(
        "person_id", "severity_type", hospitalized_label(F.col("severity_type")).alias("Binary_Severity")
    )


def _density(s: Study) -> DataFrame:
    return rounded(survival.density_by_group(s.death_by_severity), "x", "density", digits=8)


def _comorbidity_flags(s: Study) -> DataFrame:
    return comorbidity.comorbidity_flags(s.condition_codes)


def _comorbidity_score(s: Study) -> DataFrame:
    flags = comorbidity.comorbidity_flags(s.condition_codes)
    return comorbidity.comorbidity_score(flags).select("person_id", "score")


def _score_histogram(s: Study) -> DataFrame:
    return comorbidity.score_histogram(s.cohort_comorbidity, by="has_lsd")


def _score_histogram_exposed(s: Study) -> DataFrame:
    return comorbidity.score_histogram(s.exposed_comorbidity)


def _elixhauser_flags(s: Study) -> DataFrame:
    return comorbidity.comorbidity_flags(s.condition_codes, mapping=comorbidity.ELIXHAUSER_PREFIXES)


def _demographics(s: Study) -> DataFrame:
    return s.demographics


STUDY_QUERIES: dict[str, Callable[[Study], DataFrame]] = {
    "codeset_members": _codeset_members,
    "codeset_members_any_version": _codeset_members_any,
    "events_in_concept_set": _events_in_concept_set,
    "events_in_concept_set_distinct": _events_in_concept_set_distinct,
    "code_to_standard_map": lambda s: s.code_map,
    "extract_code": _extract_code,
    "code_if_known": _code_if_known,
    "resolve_condition_codes": _resolve,
    "resolve_condition_codes_keep_unmapped": _resolve_all,
    "latest_per_code": lambda s: s.condition_codes,
    "latest_per_code_exposed": lambda s: s.exposed_codes,
    "resolve_condition_codes_wide": lambda s: s.cohort_conditions_wide,
    "match_codes_any_route": lambda s: s.cohort_conditions,
    "concept_hierarchy": lambda s: s.hierarchy,
    "most_specific_condition": lambda s: s.specific_conditions,
    "events_of_persons": lambda s: s.exposed_conditions,
    "patient_facts": lambda s: s.facts,
    "typed_table": _typed_table,
    "rejected_cells": _rejected_cells,
    "demographics": _demographics,
    "impute_covariates": lambda s: s.covariates,
    "propensity_score": _propensity_score,
    "propensity_score_equations": _propensity_equations,
    "propensity_score_one_factor": _propensity_one_factor,
    "match_nearest": _match_nearest,
    "restrict_to": _restrict_to,
    "index_window_join": lambda s: s.cohort_drugs,
    "index_window_join_procedures": lambda s: s.cohort_procedures,
    "binary_severity": _binary_severity,
    "severity_outcome_drugs": lambda s: s.outcome_drugs,
    "measurements_with_units": _measurements,
    "measurement_window": lambda s: s.panel_labs,
    "scale_of_code": lambda s: s.loinc,
    "lab_panel": lambda s: s.panel,
    "worst_value_grid": _worst_value_grid,
    "pivot_wide": _pivot_wide,
    "missing_profile": _missing_profile,
    "impute_median": _impute_median,
    "impute_median_wide": _impute_median_wide,
    "death_summary": lambda s: s.cohort_death,
    "hospitalized_label": _hospitalized_label,
    "keyword_class": _keyword_class,
    "keyword_class_procedures": _keyword_class_procedures,
    "survival_table": lambda s: s.drug_survival_rows,
    "survival_table_procedures": lambda s: s.procedure_survival_rows,
    "kaplan_meier": _kaplan_meier,
    "kaplan_meier_procedures": _kaplan_meier_procedures,
    "kaplan_meier_all_rows": _kaplan_meier_all_rows,
    "risk_table": _risk_table,
    "min_group_size": _min_group_size,
    "logistic_terms": _logistic_terms,
    "odds_ratios": _odds_ratios,
    "severity_model_equations": _severity_equations,
    "profile_bounds": _profile_bounds,
    "comorbidity_flags": _comorbidity_flags,
    "comorbidity_score": _comorbidity_score,
    "score_by_exposure": lambda s: s.cohort_comorbidity,
    "score_histogram": _score_histogram,
    "score_histogram_exposed": _score_histogram_exposed,
    "comorbidity_flags_elixhauser": _elixhauser_flags,
    "density_by_group": _density,
    "map_phecodes": lambda s: s.cohort_phecodes,
    "map_phecodes_exposed": lambda s: s.exposed_phecodes,
}

# Runs on the propensity-matched cohort, which SQL cannot state.
MATCHED_QUERIES: dict[str, Callable[[Study], DataFrame]] = {
    "matched_cohort": lambda s: s.cohort,
    "matched_drug_survival": lambda s: s.drug_survival,
    "severity_model": lambda s: s.drug_odds,
}


# On a score with a closed form SQL can state the whole way from facts to curve.
ONE_FACTOR_QUERIES: dict[str, Callable[[Study], DataFrame]] = {
    "matched_persons_one_factor": lambda s: rounded(s.matched_persons, "score"),
    "matched_cohort_one_factor": lambda s: s.cohort,
    "matched_drug_survival_one_factor": _kaplan_meier,
}


def _bind(plan: Callable[[Study], DataFrame], matched: bool, **changed: object) -> Query:
    return lambda spark, folder: plan(study(spark, folder, matched, **changed))


def all_queries() -> dict[str, Query]:
    plain = {name: _bind(plan, False) for name, plan in STUDY_QUERIES.items()}
    one_factor = {name: _bind(plan, True, score_covariates=("Race",), score_digits=9) for name, plan in ONE_FACTOR_QUERIES.items()}
    return plain | one_factor | {name: _bind(plan, True) for name, plan in MATCHED_QUERIES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Survival after treatment drugs, from concept sets and events to the curve."""
    return study(spark, folder).drug_survival
