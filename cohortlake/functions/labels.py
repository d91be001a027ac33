"""Text to label: keyword classes and severity outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LabelRules = Sequence[tuple[str, Sequence[str]]]

# Label, then the lower-case words that stand for it. Order counts.
DRUG_LABELS: LabelRules = (
    ("dexamethasone", ("dexamethasone",)),
    ("baricitinib", ("baricitinib",)),
    ("paxlovid", ("nirmatrelvir", "ritonavir", "paxlovid")),
    ("remdesivir", ("remdesivir",)),
    ("tocilizumab", ("tocilizumab",)),
    ("hydrocortisone", ("hydrocortisone",)),
    ("prednisolone", ("prednisolone",)),
)
PROCEDURE_LABELS: LabelRules = (
    ("therapeutic, prophylactic, or diagnostic injection", ("therapeutic, prophylactic, or diagnostic",)),
    ("immunization administration", ("vaccination", "immunization")),
    ("continuous positive airway pressure ventilation", ("continuous positive airway",)),
    ("intravenous infusion, for therapy or prophylaxis", ("intravenous infusion, for therapy",)),
    ("intravenous infusion, hydration", ("intravenous infusion, hydration",)),
    ("administration of insulin", ("insulin",)),
    ("extracorporeal membrane oxygenation treatment", ("extracorporeal membrane oxygenation", "ecls")),
    ("assistance with respiratory ventilation", ("assistance with respiratory ventilation",)),
    ("inhalation treatment with aerosol or nebulizer", ("inhalation treatment",)),
)
LAB_SCALE_LABELS: LabelRules = (
    ("OrdQn", ("ordinal",)),
    ("Qn", ("quantitative",)),
    ("Nom", ("nominal", "qualitative")),
    ("Nar", ("narrative",)),
    ("Doc", ("doc",)),
    ("Set", ("set",)),
    ("Multi", ("multi",)),
    ("Pnl", ("panel", "pnl", "panl")),
)

# Severity levels around the index date.
MILD_SEVERITY = "Mild_No_ED_or_Hosp_around_COVID_index"
SEVERE_SEVERITIES = (
    "Mild_ED_around_strong_signal_COVID_index",
    "Mild_ED_around_weak_signal_COVID_index",
    "Moderate_Hosp_around_strong_signal_COVID_index",
    "Moderate_Hosp_around_weak_signal_COVID_index",
    "Death_within_n_days_after_COVID_index",
    "Severe_ECMO_IMV_in_Hosp_around_weak_signal_COVID_index",
    "Severe_ECMO_IMV_in_Hosp_around_strong_signal_COVID_index",
)


def keyword_class(text: Column, rules: LabelRules, default: str = "Other") -> Column:
    """Label of the first rule one of whose words occurs in the lower-cased text."""
    lowered = F.lower(text)
    hits = []
    for label, words in rules:
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        hits.append(F.when(hit, F.lit(label)))
    return F.coalesce(*hits, F.lit(default))


def binary_severity(severity: Column) -> Column:
    """0 for the mild level, 1 for any other known level, else NULL."""
    return F.when(severity == MILD_SEVERITY, 0).when(severity.isin(*SEVERE_SEVERITIES), 1)


def hospitalized_label(severity: Column) -> Column:
    """Two-way label; a missing severity counts as hospitalized."""
    return F.when(severity == MILD_SEVERITY, "Not Hospitalized").otherwise("Hospitalized")
