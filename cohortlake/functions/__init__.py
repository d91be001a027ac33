from cohortlake.functions.codes import ICD9_RULES, ICD10_RULES, CodeRule, extract_code
from cohortlake.functions.labels import (
    DRUG_LABELS,
    LAB_SCALE_LABELS,
    PROCEDURE_LABELS,
    binary_severity,
    hospitalized_label,
    keyword_class,
)
from cohortlake.functions.values import completed_age, r_name, to_float, to_int

__all__ = [
    "CodeRule",
    "DRUG_LABELS",
    "ICD10_RULES",
    "ICD9_RULES",
    "LAB_SCALE_LABELS",
    "PROCEDURE_LABELS",
    "binary_severity",
    "completed_age",
    "extract_code",
    "hospitalized_label",
    "keyword_class",
    "r_name",
    "to_float",
    "to_int",
]
