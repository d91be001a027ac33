"""The whole study, wired from its source tables.

Each property is one result table; it is planned when first asked for and then
shared. Nothing but model coefficients and block totals reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.labels import DRUG_LABELS, PROCEDURE_LABELS, hospitalized_label, keyword_class
from cohortlake.operators import code_mapping, cohort, comorbidity, concept_sets, events, joins, labs, matching
from cohortlake.operators import regression, survival
from cohortlake.functions.values import r_names
from cohortlake.operators.concept_sets import ConceptSet
from cohortlake.operators.ranks import exact_medians
from cohortlake.session import cut_lineage


@dataclass(frozen=True)
class StudyParameters:
    """Fixed values of the study; the test tables use others."""

    exposure_sets: Sequence[ConceptSet] = (ConceptSet(concept_sets.EXPOSURE_SET),)
    roots: Sequence[int] = concept_sets.HIERARCHY_ROOTS
    treatment_sets: Sequence[ConceptSet] = (
        ConceptSet(concept_sets.COVID_DRUG_SET),
        ConceptSet(concept_sets.CORTICOSTEROID_SET, most_recent_only=False),
    )
    outcome_drug_sets: Sequence[ConceptSet] = (ConceptSet(concept_sets.OUTCOME_DRUG_SET, most_recent_only=False),)
    index_date: str = "COVID_first_poslab_or_diagnosis_date"
    index_range: tuple[str, str] = cohort.INDEX_DATE_RANGE
    study_end: str = events.STUDY_END
    # vocabularies of the source codes
    icd10: Sequence[str] = ("ICD10CM",)
    icd9: Sequence[str] = ("ICD9CM",)
    # the day ages are completed at; the end of the study where it is left out
    ages_at: str | None = None
    lab_codes: Sequence[str] = labs.LAB_CODES
    lab_name: str = "concept_name"
    hidden_drugs: Sequence[str] = ("baricitinib", "tocilizumab", "prednisolone")
    hidden_procedures: Sequence[str] = (
        "Other",
        "assistance with respiratory ventilation",
        "extracorporeal membrane oxygenation treatment",
        "immunization administration",
    )
    group_floor: int = 500
    severity_terms: Sequence[str] = ("drug_concept_name", "age_at_covid", "race", "sex")
    score_covariates: Sequence[str] = ("Age", "Race", "Sex")
    # digits that scores are matched on; scores that only the fit's own error tells apart are then equal
    score_digits: int | None = None
    # whether the matched persons or all persons with facts are the cohort
    matched: bool = True
    # whether results that many others read are stored; without it each query is one plan
    kept: bool = True


@dataclass
class Study:
    tables: Mapping[str, DataFrame]
    params: StudyParameters = field(default_factory=StudyParameters)

    def _kept(self, df: DataFrame) -> DataFrame:
        """Store a result that many others read."""
        return cut_lineage(df) if self.params.kept else df

    # concept sets and code maps

    @cached_property
    def exposure_set(self) -> DataFrame:
        return concept_sets.codeset_members(self.tables["concept_set_members"], self.params.exposure_sets)

    @cached_property
    def code_map(self) -> DataFrame:
        return self._kept(
            code_mapping.code_to_standard_map(self.tables["concept"], self.tables["concept_relationship"], self.params.icd10)
        )

    @cached_property
    def hierarchy(self) -> DataFrame:
        return concept_sets.concept_hierarchy(
            self.tables["concept_ancestor"], self.tables["concept_set_members"], self.exposure_set
        )

    # exposed persons and the cohort

    @cached_property
    def exposure_events(self) -> DataFrame:
        return concept_sets.events_in_concept_set(self.tables["condition_occurrence"], self.exposure_set)

    @cached_property
    def specific_conditions(self) -> DataFrame:
        best = concept_sets.most_specific_condition(self.exposure_events, self.hierarchy, self.params.roots)
        return self._kept(best)

    @cached_property
    def demographics(self) -> DataFrame:
        return cohort.demographics(self.specific_conditions, self.tables["person"], self.params.ages_at or self.params.study_end)

    @cached_property
    def facts(self) -> DataFrame:
        return cohort.patient_facts(
            self.tables["patient_facts"], self.specific_conditions, self.params.index_range, self.params.index_date
        )

    @cached_property
    def covariates(self) -> DataFrame:
        return cohort.impute_covariates(self.facts)

    @cached_property
    def matched_persons(self) -> DataFrame:
        scored = regression.propensity_score(self.covariates, covariates=self.params.score_covariates)
        if self.params.score_digits is not None:
            scored = scored.withColumn("score", F.round("score", self.params.score_digits))
        return matching.match_nearest(scored)

    @cached_property
    def cohort(self) -> DataFrame:
        """Facts of the matched persons; read by most other tables, so kept."""
        if not self.params.matched:
            return self.facts
        return cut_lineage(joins.restrict_to(self.facts, self.matched_persons))

    # conditions

    @cached_property
    def source_codes(self) -> code_mapping.SourceCodes:
        """Codes of the distinct source ids and texts of all conditions."""
        return code_mapping.source_codes(
            self.tables["condition_occurrence"], self.code_map, self.params.icd10, self.params.icd9
        )

    @cached_property
    def condition_codes(self) -> DataFrame:
        """Latest date per person and code of all persons."""
        conditions = self.tables["condition_occurrence"]
        resolved = code_mapping.resolve_condition_codes(conditions, self.code_map, codes=self.source_codes)
        return code_mapping.latest_per_code(resolved)

    @cached_property
    def exposed_conditions(self) -> DataFrame:
        return joins.events_of_persons(self.tables["condition_occurrence"], self.specific_conditions)

    @cached_property
    def exposed_codes(self) -> DataFrame:
        resolved = code_mapping.resolve_condition_codes(self.exposed_conditions, self.code_map, codes=self.source_codes)
        return code_mapping.latest_per_code(resolved)

    @cached_property
    def exposed_phecodes(self) -> DataFrame:
        return code_mapping.map_phecodes(self.exposed_codes, self.tables["phecode_map"])

    @cached_property
    def cohort_conditions(self) -> DataFrame:
        found = code_mapping.match_codes_any_route(self.cohort, self.tables["condition_occurrence"], self.code_map)
        return self._kept(found)

    @cached_property
    def cohort_conditions_wide(self) -> DataFrame:
        return code_mapping.resolve_condition_codes_wide(
            self.cohort, self.tables["condition_occurrence"], self.code_map
        )

    @cached_property
    def cohort_phecodes(self) -> DataFrame:
        return code_mapping.map_phecodes(
            self.cohort_conditions,
            self.tables["phecode_map"],
            "concept_code",
            ("person_id", "condition_start_date", "has_lsd"),
        )

    @cached_property
    def exposed_comorbidity(self) -> DataFrame:
        return comorbidity.comorbidity_score(comorbidity.comorbidity_flags(self.exposed_codes))

    @cached_property
    def cohort_comorbidity(self) -> DataFrame:
        flags = comorbidity.comorbidity_flags(self.cohort_conditions, code="concept_code", carry=("has_lsd",))
        return comorbidity.score_by_exposure(comorbidity.comorbidity_score(flags))

    # deaths

    @cached_property
    def cohort_death(self) -> DataFrame:
        return self._kept(events.death_summary(self.tables["death"], self.cohort, self.params.index_date))

    @cached_property
    def death_by_severity(self) -> DataFrame:
        return self.cohort_death.withColumn("Binary_Severity", hospitalized_label(F.col("severity_type")))

    # drugs and procedures

    @cached_property
    def treatment_names(self) -> DataFrame:
        members = concept_sets.codeset_members(self.tables["concept_set_members"], self.params.treatment_sets)
        return members.select(
            "concept_id", "concept_name", keyword_class(F.col("concept_name"), DRUG_LABELS).alias("drug_name")
        )

    def _in_window(self, table: str, event_date: str) -> DataFrame:
        return self._window_of(self.tables[table], event_date)

    def _window_of(self, rows: DataFrame, event_date: str) -> DataFrame:
        return events.index_window_join(
            rows,
            self.cohort,
            event_date,
            self.params.index_date,
            carry=("severity_type", "has_lsd"),
            index_range=self.params.index_range,
        )

    @cached_property
    def cohort_drugs(self) -> DataFrame:
        return self._in_window("drug_exposure", "drug_exposure_start_date")

    @cached_property
    def cohort_procedures(self) -> DataFrame:
        return self._in_window("procedure_occurrence", "procedure_date")

    @cached_property
    def drug_survival_rows(self) -> DataFrame:
        """The drugs of interest are picked before the rows meet the persons."""
        names = self.treatment_names.distinct().withColumnRenamed("concept_id", "drug_concept_id")
        wanted = self.tables["drug_exposure"].join(names, "drug_concept_id")
        return events.survival_table(
            self._window_of(wanted, "drug_exposure_start_date"),
            self.cohort_death,
            ("drug_concept_id", "concept_name", "drug_name"),
            "drug_exposure_end_date",
            self.params.study_end,
            "drug_exposure_date",
        )

    @cached_property
    def procedure_survival_rows(self) -> DataFrame:
        rows = events.survival_table(
            self.cohort_procedures,
            self.cohort_death,
            ("procedure_concept_id", "procedure_concept_name"),
            "procedure_date",
            self.params.study_end,
        )
        return rows.withColumn("procedure_name", keyword_class(F.col("procedure_concept_name"), PROCEDURE_LABELS))

    @cached_property
    def drug_survival(self) -> DataFrame:
        return survival.kaplan_meier(self.drug_survival_rows, strata="drug_name", exclude=self.params.hidden_drugs)

    @cached_property
    def procedure_survival(self) -> DataFrame:
        return survival.kaplan_meier(
            self.procedure_survival_rows, strata="procedure_name", exclude=self.params.hidden_procedures
        )

    @cached_property
    def outcome_drugs(self) -> DataFrame:
        members = concept_sets.codeset_members(self.tables["concept_set_members"], self.params.outcome_drug_sets)
        return events.severity_outcome_drugs(
            self.tables["drug_exposure"], self.tables["patient_facts"], members, self.params.index_date
        )

    @cached_property
    def severity_rows(self) -> DataFrame:
        return regression.min_group_size(self.outcome_drugs, "drug_concept_name", self.params.group_floor)

    @cached_property
    def severity_counts(self) -> DataFrame:
        """Rows of the model, equal ones counted in ``n_rows``.

        Group sizes, the fit and the scores all read them, so the drug rows are found once.
        """
        columns = dict.fromkeys(("Binary_Severity", "drug_concept_name", *self.params.severity_terms))
        counted = regression.count_rows(self.outcome_drugs, list(columns))
        return regression.min_group_size(counted, "drug_concept_name", self.params.group_floor, count="n_rows")

    @cached_property
    def severity_model(self) -> DataFrame:
        return regression.logistic_terms(self.severity_rows, "Binary_Severity", self.params.severity_terms)

    @cached_property
    def drug_odds(self) -> DataFrame:
        return regression.odds_ratios(self.severity_model)

    @cached_property
    def drug_odds_profile(self) -> DataFrame:
        """Odds ratios with profile-likelihood bounds."""
        bounds = regression.profile_bounds(self.severity_rows, "Binary_Severity", self.params.severity_terms)
        return regression.odds_ratios(bounds)

    # labs

    @cached_property
    def loinc(self) -> DataFrame:
        return labs.scale_of_code(self.tables["concept"], self.tables["concept_synonym"])

    @cached_property
    def panel(self) -> DataFrame:
        return labs.lab_panel(self.loinc, self.params.lab_codes)

    @cached_property
    def cohort_labs(self) -> DataFrame:
        return labs.measurements_with_units(
            self.tables["measurement"], self.cohort, self.tables["concept"], self.params.index_date
        )

    @cached_property
    def panel_labs(self) -> DataFrame:
        """Labs outside the panel are left out before the rows meet the persons."""
        ids = self.panel.select(F.col("concept_id").alias("measurement_concept_id"))
        wanted = self.tables["measurement"].join(ids, "measurement_concept_id", "left_semi")
        complete = labs.measurements_with_units(
            wanted, self.cohort, self.tables["concept"], self.params.index_date
        )
        return labs.measurement_window(complete, self.panel)

    @cached_property
    def worst_labs(self) -> DataFrame:
        """Worst value per person and lab name; read by the pivot and by the medians, so kept."""
        names = self.panel.select(F.col("concept_id").alias("measurement_concept_id"), F.col(self.params.lab_name).alias("name"))
        worst = labs.worst_values(self.panel_labs).join(names, "measurement_concept_id")
        return cut_lineage(worst.select("person_id", "name", "worst_value_as_number"))

    @cached_property
    def lab_names(self) -> list[str]:
        """Names that were measured at all; no more than the panel has."""
        return sorted(row["name"] for row in self.worst_labs.select("name").distinct().collect())

    @cached_property
    def lab_matrix_with_gaps(self) -> DataFrame:
        """Pivot of the values that exist; the gaps come from the join to all persons."""
        wide = labs.pivot_wide(self.worst_labs, "person_id", "name", "worst_value_as_number", self.lab_names)
        return self.cohort.select("person_id").distinct().join(wide, "person_id", "left")

    @cached_property
    def lab_matrix(self) -> DataFrame:
        gaps = self.lab_matrix_with_gaps
        medians = exact_medians(self.worst_labs, "name", "worst_value_as_number")
        columns = dict(zip(self.lab_names, r_names(self.lab_names), strict=True))
        return labs.impute_median(gaps, list(columns.values()), medians.replace(columns, subset=["name"]))
