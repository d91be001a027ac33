"""The expected result of each query as SQL over the base tables.

Written from the meaning of each operator, not from its plan: where a query
aggregates, the check ranks; where a query explodes keys, the check unions.
"""

from __future__ import annotations

import re

from cohortlake.sources.bindings import VIEWS, with_views

# Whole or part of the text around a marker, by pattern instead of by splitting.
ICD10_TEXT = r"""
    case when strpos(condition_source_value, 'ICD10CM:') > 0
           then regexp_extract(condition_source_value, '^.*ICD10CM:(.*)$', 1)
         when strpos(condition_source_value, ':ICD-10-CM') > 0
           then regexp_extract(condition_source_value, '^(.*?):ICD-10-CM', 1)
         when strpos(condition_source_value, '|ICD-10-CM') > 0
           then regexp_extract(condition_source_value, '^(.*?)\|ICD-10-CM', 1) end"""

ICD9_TEXT = r"""
    case when strpos(condition_source_value, 'ICD9CM:') > 0
           then regexp_extract(condition_source_value, '^.*ICD9CM:(.*)$', 1)
         when strpos(condition_source_value, ':ICD-9-CM') > 0
           then regexp_extract(condition_source_value, '^(.*?):ICD-9-CM', 1) end"""

DRUG_NAME = """
    case when regexp_matches({0}, 'dexamethasone', 'i') then 'dexamethasone'
         when regexp_matches({0}, 'baricitinib', 'i') then 'baricitinib'
         when regexp_matches({0}, 'nirmatrelvir|ritonavir|paxlovid', 'i') then 'paxlovid'
         when regexp_matches({0}, 'remdesivir', 'i') then 'remdesivir'
         when regexp_matches({0}, 'tocilizumab', 'i') then 'tocilizumab'
         when regexp_matches({0}, 'hydrocortisone', 'i') then 'hydrocortisone'
         when regexp_matches({0}, 'prednisolone', 'i') then 'prednisolone' else 'Other' end"""

PROCEDURE_NAME = """
    case when regexp_matches({0}, 'therapeutic, prophylactic, or diagnostic', 'i')
           then 'therapeutic, prophylactic, or diagnostic injection'
         when regexp_matches({0}, 'vaccination|immunization', 'i') then 'immunization administration'
         when regexp_matches({0}, 'continuous positive airway', 'i')
           then 'continuous positive airway pressure ventilation'
         when regexp_matches({0}, 'intravenous infusion, for therapy', 'i')
           then 'intravenous infusion, for therapy or prophylaxis'
         when regexp_matches({0}, 'intravenous infusion, hydration', 'i') then 'intravenous infusion, hydration'
         when regexp_matches({0}, 'insulin', 'i') then 'administration of insulin'
         when regexp_matches({0}, 'extracorporeal membrane oxygenation|ecls', 'i')
           then 'extracorporeal membrane oxygenation treatment'
         when regexp_matches({0}, 'assistance with respiratory ventilation', 'i')
           then 'assistance with respiratory ventilation'
         when regexp_matches({0}, 'inhalation treatment', 'i')
           then 'inhalation treatment with aerosol or nebulizer' else 'Other' end"""

# Charlson categories as patterns on bare codes.
CHARLSON = {
    "mi": "I21|I22|I252",
    "chf": "I099|I110|I130|I132|I255|I420|I42[5-9]|I43|I50|P290",
    "pvd": "I7[01]|I731|I738|I739|I771|I79[02]|K55[189]|Z95[89]",
    "cevd": "G4[56]|H340|I6",
    "dementia": "F0[0-3]|F051|G30|G311",
    "cpd": "I27[89]|J4[0-7]|J6[0-7]|J684|J70[13]",
    "rheumd": "M0[56]|M315|M3[2-4]|M35[13]|M360",
    "pud": "K2[5-8]",
    "mld": "B18|K70[01239]|K71[3457]|K7[34]|K76[023489]|Z944",
    "diab": "E1[0-4][01689]",
    "diabwc": "E1[0-4][23457]",
    "hp": "G041|G114|G80[12]|G8[12]|G83[0-4]|G839",
    "rend": "I120|I131|N03[2-7]|N05[2-7]|N1[89]|N250|Z49[0-2]|Z940|Z992",
    "canc": "C[01]|C2[0-6]|C3[0-4]|C3[7-9]|C4[0135-9]|C5[0-8]|C6|C7[0-6]|C8[1-58]|C9[0-7]",
    "msld": "I85[09]|I864|I982|K704|K711|K72[19]|K76[5-7]",
    "metacanc": "C7[789]|C80",
    "aids": "B2[0124]",
}
WEIGHTS = {"chf": 2, "dementia": 2, "cpd": 1, "rheumd": 1, "mld": 2, "diabwc": 1, "hp": 2, "rend": 1, "canc": 2}
WEIGHTS |= {"msld": 4, "metacanc": 6, "aids": 4}
# C0, C1 and C6 stand for two-digit stems, so the code needs three characters.
ELIXHAUSER = {
    "chf": CHARLSON["chf"],
    "carit": "I44[123]|I45[69]|I4[789]|R00[018]|T821|Z450|Z950",
    "valv": "A520|I0[5-8]|I09[18]|I3[4-9]|Q23[0-3]|Z95[234]",
    "pcd": "I2[67]|I28[089]",
    "pvd": CHARLSON["pvd"],
    "hypunc": "I10",
    "hypc": "I1[1235]",
    "para": CHARLSON["hp"],
    "ond": "G1[0-3]|G2[0-2]|G25[45]|G31[289]|G32|G3[5-7]|G4[01]|G93[14]|R470|R56",
    "cpd": CHARLSON["cpd"],
    "diabunc": "E1[0-4][019]",
    "diabc": "E1[0-4][2-8]",
    "hypothy": "E0[0-3]|E890",
    "rf": "I120|I131|N1[89]|N250|Z49[0-2]|Z940|Z992",
    "ld": "B18|I85|I864|I982|K70|K71[13457]|K7[234]|K760|K76[2-9]|Z944",
    "pud": "K2[5-8][79]",
    "aids": CHARLSON["aids"],
    "lymph": "C8[1-58]|C96|C90[02]",
    "metacanc": CHARLSON["metacanc"],
    "solidtum": "C[01]|C2[0-6]|C3[0-4]|C3[7-9]|C4[0135-9]|C5[0-8]|C6|C7[0-6]|C97",
    "rheumd": "L94[013]|M0[568]|M12[03]|M30|M31[0-3]|M3[2-5]|M45|M46[189]",
    "coag": "D6[5-8]|D69[13-6]",
    "obes": "E66",
    "wloss": "E4[0-6]|R634|R64",
    "fed": "E222|E8[67]",
    "blane": "D500",
    "dane": "D50[89]|D5[123]",
    "alcohol": "F10|E52|G621|I426|K292|K70[039]|T51|Z502|Z714|Z721",
    "drug": "F1[1-689]|Z715|Z722",
    "psycho": "F2[0234589]|F302|F31[25]",
    "depre": "F204|F31[345]|F3[23]|F341|F412|F432",
}


def _flag_columns(patterns: dict[str, str]) -> str:
    return ",\n".join(
        f"cast(max(case when length(bare) >= 3 and regexp_matches(bare, '^({pattern})') then 1 else 0 end) as int) as {name}"
        for name, pattern in patterns.items()
    )


FLAG_COLUMNS = _flag_columns(CHARLSON)
SCORE = " + ".join(f"{name} * {weight}" for name, weight in WEIGHTS.items())

# The order of a person's death records.
RECORD_ORDER = """order by cause_concept_id nulls first, cause_concept_name nulls first,
            death_type_concept_id nulls first"""

# Intermediate results, as named table expressions over the study tables.
STEPS = {
    "exposure_set": "select * from concept_set_members where codeset_id = 1 and is_most_recent_version",
    "treatments": """
        select * from concept_set_members where codeset_id = 3 or (codeset_id = 2 and is_most_recent_version)""",
    "code_map": """
        select m.concept_id_1 as icd_concept_id, s.concept_name as icd_concept_name, s.domain_id, s.vocabulary_id,
          s.concept_code, m.relationship_id, m.concept_id_2 as snomed_concept_id, t.concept_name as mapped_concept_name,
          t.domain_id as mapped_domain_id, t.vocabulary_id as mapped_vocabulary_id
        from (from concept where vocabulary_id = 'ICD10CM') s
        left join (from concept_relationship where relationship_id = 'Maps to') m on m.concept_id_1 = s.concept_id
        left join (from concept where vocabulary_id = 'SNOMED') t on t.concept_id = m.concept_id_2""",
    "hierarchy": """
        select distinct a.ancestor_concept_id, u.concept_name as ancestor_name, a.descendant_concept_id,
          d.concept_name as descendant_name, a.min_levels_of_separation, a.max_levels_of_separation
        from concept_ancestor a, concept_set_members u, concept_set_members d
        where u.concept_id = a.ancestor_concept_id and d.concept_id = a.descendant_concept_id
          and a.ancestor_concept_id in (select concept_id from exposure_set)""",
    "exposure_events": """
        select c.* from condition_occurrence c, exposure_set e where e.concept_id = c.condition_concept_id""",
    "specific": """
        select person_id, condition_concept_id, condition_source_concept_id, condition_source_value,
          descendant_name as specific_condition_name, condition_start_date, condition_end_date, data_partner_id
        from exposure_events join hierarchy on descendant_concept_id = condition_concept_id
        where ancestor_concept_id in (0, 1)
        qualify row_number() over (partition by person_id
          order by max_levels_of_separation desc nulls last, condition_start_date desc nulls last,
            condition_concept_id desc nulls last, condition_source_value desc nulls last,
            condition_source_concept_id desc nulls last, descendant_name desc nulls last,
            condition_end_date desc nulls last, data_partner_id desc nulls last) = 1""",
    "facts": """
        select f.person_id, f.data_partner_id, f.covid_index_date, f.severity_type,
          try_cast(trunc(try_cast(f.number_of_visits_before_covid as double)) as int) as number_of_visits_before_covid,
          try_cast(trunc(try_cast(f.number_of_visits_post_covid as double)) as int) as number_of_visits_post_covid,
          try_cast(trunc(try_cast(f.number_of_COVID_vaccine_doses_before_or_day_of_covid as double)) as int) as number_of_COVID_vaccine_doses_before_or_day_of_covid,
          try_cast(trunc(try_cast(f.number_of_COVID_vaccine_doses_post_covid as double)) as int) as number_of_COVID_vaccine_doses_post_covid,
          try_cast(f.BMI_max_observed_or_calculated_before_or_day_of_covid as float) as BMI_max_observed_or_calculated_before_or_day_of_covid,
          try_cast(f.BMI_max_observed_or_calculated_post_covid as float) as BMI_max_observed_or_calculated_post_covid,
          try_cast(f.age_at_covid as int) as Age, f.race as Race, nullif(f.sex, 'No matching concept') as Sex,
          x.condition_concept_id, x.condition_source_concept_id, x.condition_source_value, x.specific_condition_name,
          x.condition_start_date, x.condition_end_date, x.data_partner_id as lsd_data_partner_id,
          if(x.condition_concept_id is null, 0, 1) as has_lsd
        from patient_facts f left join specific x on x.person_id = f.person_id
        where f.covid_index_date between date '1995-01-01' and date '2000-12-31'""",
    "covariates": """
        select person_id, has_lsd, ifnull(Sex, 'Unknown') as Sex,
          ifnull(cast(Age as double), (select quantile_cont(Age, 0.5) from facts)) as Age,
          if(ifnull(Race, 'Other') = 'Other', 'Other/Unknown', Race) as Race, severity_type, data_partner_id
        from facts""",
    "known_codes": "select distinct concept_code as known from code_map",
    "resolved_all": f"""
        select c.person_id, c.condition_concept_id, c.condition_concept_name, c.condition_start_date,
          c.condition_end_date, c.condition_source_value, c.condition_source_concept_id, m.icd_concept_id,
          m.vocabulary_id, m.icd_concept_name, {ICD9_TEXT} as icd_9_concept_code,
          coalesce({ICD10_TEXT}, k.known) as icd_10_concept_code, m.concept_code,
          coalesce(m.concept_code, {ICD10_TEXT}, k.known, {ICD9_TEXT}) as combined_concept_code, c.data_partner_id
        from condition_occurrence c left join code_map m on m.icd_concept_id = c.condition_source_concept_id
        left join known_codes k on k.known = c.condition_source_value
        where coalesce(m.concept_code, {ICD10_TEXT}, k.known, {ICD9_TEXT}) is not null""",
    "resolved": "select * from resolved_all where vocabulary_id is not null",
    "latest": """
        select person_id, vocabulary_id, combined_concept_code, condition_start_date from resolved
        qualify row_number() over (partition by person_id, vocabulary_id, combined_concept_code
          order by condition_start_date desc nulls last) = 1""",
    "exposed_conditions": """
        select distinct * from condition_occurrence where person_id in (select person_id from specific)""",
    "exposed_latest": """
        select * from latest where person_id in (select person_id from specific)""",
    "texts": f"select *, {ICD10_TEXT} as parsed from condition_occurrence",
    "any_route": """
        select f.person_id, f.has_lsd, c.condition_start_date, c.condition_source_value,
          c.condition_source_concept_id, m.icd_concept_name, m.vocabulary_id, m.concept_code, c.data_partner_id
        from facts f join texts c on c.person_id = f.person_id
          join code_map m on m.icd_concept_id = c.condition_source_concept_id
        union
        select f.person_id, f.has_lsd, c.condition_start_date, c.condition_source_value,
          c.condition_source_concept_id, m.icd_concept_name, m.vocabulary_id, m.concept_code, c.data_partner_id
        from facts f join texts c on c.person_id = f.person_id
          join code_map m on m.concept_code = c.condition_source_value or m.concept_code = c.parsed""",
    "deaths": f"""
        select d.person_id, ifnull(string_agg(cast(cause_concept_id as varchar), ';' {RECORD_ORDER}), '')
            as cause_concept_id,
          ifnull(string_agg(cause_concept_name, ';' {RECORD_ORDER}), '') as cause_concept_name,
          ifnull(string_agg(cast(death_type_concept_id as varchar), ';' {RECORD_ORDER}), '')
            as death_type_concept_id,
          min(d.death_date) as death_date, min(d.data_partner_id) as data_partner_id,
          cast(min(d.death_date) - any_value(f.covid_index_date) as int) as days_diff,
          any_value(f.severity_type) as severity_type
        from death d join facts f on f.person_id = d.person_id where d.death_date is not null
        group by d.person_id having min(d.death_date) >= any_value(f.covid_index_date)""",
    "drug_window": """
        select d.*, f.severity_type, f.has_lsd, f.covid_index_date,
          cast(d.drug_exposure_start_date - f.covid_index_date as int) as days_diff
        from drug_exposure d join facts f on f.person_id = d.person_id
          and d.drug_exposure_start_date between f.covid_index_date and f.covid_index_date + 30""",
    "procedure_window": """
        select d.*, f.severity_type, f.has_lsd, f.covid_index_date,
          cast(d.procedure_date - f.covid_index_date as int) as days_diff
        from procedure_occurrence d join facts f on f.person_id = d.person_id
          and d.procedure_date between f.covid_index_date and f.covid_index_date + 30""",
    "drug_survival": f"""
        with dated as (
          select w.person_id, w.drug_concept_id, t.concept_name, {DRUG_NAME.format("t.concept_name")} as drug_name,
            e.death_date, max(w.drug_exposure_end_date) as drug_exposure_date
          from drug_window w join treatments t on t.concept_id = w.drug_concept_id
            left join deaths e on e.person_id = w.person_id group by all)
        select *, cast(ifnull(death_date, date '2002-12-31') - drug_exposure_date as int) as days,
          if(death_date is null, 0, 1) as status
        from dated where ifnull(death_date, date '2002-12-31') >= drug_exposure_date""",
    "procedure_survival": f"""
        with dated as (
          select w.person_id, w.procedure_concept_id, w.procedure_concept_name, e.death_date,
            max(w.procedure_date) as procedure_date
          from procedure_window w left join deaths e on e.person_id = w.person_id group by all)
        select *, cast(ifnull(death_date, date '2002-12-31') - procedure_date as int) as days,
          if(death_date is null, 0, 1) as status, {PROCEDURE_NAME.format("procedure_concept_name")} as procedure_name
        from dated where ifnull(death_date, date '2002-12-31') >= procedure_date""",
    "drug_lives": """
        select distinct days, status, drug_name as strata from drug_survival
        where drug_name not in ('baricitinib', 'tocilizumab', 'prednisolone')""",
    "all_drug_lives": "select days, status, drug_name as strata from drug_survival",
    "procedure_lives": """
        select distinct days, status, procedure_name as strata from procedure_survival
        where procedure_name not in ('Other', 'assistance with respiratory ventilation',
          'extracorporeal membrane oxygenation treatment', 'immunization administration')""",
    "outcomes": """
        select d.person_id, cast(d.drug_exposure_end_date - f.covid_index_date as int) as days_diff,
          f.covid_index_date, d.drug_exposure_end_date, f.severity_type, d.drug_concept_name,
          if(f.severity_type = 'Mild_No_ED_or_Hosp_around_COVID_index', 0, 1) as Binary_Severity,
          try_cast(f.age_at_covid as int) as age_at_covid, f.race, f.sex, f.data_partner_id
        from drug_exposure d join (from concept_set_members where codeset_id = 4) s on s.concept_id = d.drug_concept_id
          join patient_facts f on f.person_id = d.person_id
        where d.drug_exposure_end_date between f.covid_index_date and f.covid_index_date + 30
          and f.age_at_covid is not null and f.sex is not null and f.race is not null
          and f.severity_type is not null and f.data_partner_id is not null""",
    "labs_with_units": """
        select m.*, f.severity_type, f.covid_index_date, u.concept_code as units,
          cast(m.measurement_date - f.covid_index_date as int) as days_diff
        from measurement m, facts f, concept u
        where f.person_id = m.person_id and u.concept_id = m.harmonized_unit_concept_id
          and m.harmonized_value_as_number is not null""",
    "loinc": """
        select c.concept_id, c.concept_name, c.domain_id, c.vocabulary_id, c.concept_class_id, c.standard_concept,
          c.concept_code,
          list_extract(['Qn','OrdQn','Nom','Nar','Doc','Set','Multi','Pnl','Other'], min(
            case when regexp_matches(s.concept_synonym_name, 'ordinal', 'i') then 2
                 when regexp_matches(s.concept_synonym_name, 'quantitative', 'i') then 1
                 when regexp_matches(s.concept_synonym_name, 'nominal|qualitative', 'i') then 3
                 when regexp_matches(s.concept_synonym_name, 'narrative', 'i') then 4
                 when regexp_matches(s.concept_synonym_name, 'doc', 'i') then 5
                 when regexp_matches(s.concept_synonym_name, 'set', 'i') then 6
                 when regexp_matches(s.concept_synonym_name, 'multi', 'i') then 7
                 when regexp_matches(s.concept_synonym_name, 'panel|pnl|panl', 'i') then 8 else 9 end)) as scale
        from concept c join concept_synonym s on s.concept_id = c.concept_id
        where c.vocabulary_id = 'LOINC' and s.language_concept_id = 4180186
          and regexp_matches(s.concept_synonym_name, '[A-Za-z]') group by all""",
    "panel": """
        select concept_id, concept_name, concept_code, scale from loinc
        where concept_code in ('C2', 'C6', 'C10', 'C14', 'C18', 'C22', 'C26')""",
    "panel_labs": """
        select l.* from labs_with_units l join panel p on p.concept_id = l.measurement_concept_id
        where l.days_diff between 0 and 3""",
    "grid": """
        select p.person_id, c.measurement_concept_id, max(l.harmonized_value_as_number) as worst_value_as_number
        from (select distinct person_id from facts) p
          cross join (select distinct measurement_concept_id from panel_labs) c
          left join panel_labs l
            on l.person_id = p.person_id and l.measurement_concept_id = c.measurement_concept_id
        group by all""",
    "flags": f"""
        select person_id, {FLAG_COLUMNS} from (
          select person_id, upper(regexp_replace(combined_concept_code, '[^A-Za-z0-9]', '', 'g')) as bare
          from latest where vocabulary_id = 'ICD10CM') group by person_id""",
    "scores": f"""
        select person_id, cast({SCORE} as int) as score from (
          select person_id, {FLAG_COLUMNS} from (
            select person_id, upper(regexp_replace(concept_code, '[^A-Za-z0-9]', '', 'g')) as bare
            from any_route where vocabulary_id = 'ICD10CM') group by person_id)""",
    "score_flags": """
        select distinct s.person_id, s.score, a.has_lsd
        from scores s left join any_route a on a.person_id = s.person_id and a.vocabulary_id = 'ICD10CM'""",
}
LAB_COLUMNS = ("C2", "C6", "C10", "C14", "C18", "C22", "C26")
CELLS = ",\n".join(f"max(worst_value_as_number) filter (where concept_code = '{c}') as {c}" for c in LAB_COLUMNS)
STEPS["cells"] = f"""
        select person_id, {CELLS}
        from grid join panel on panel.concept_id = grid.measurement_concept_id group by person_id"""


def check(body: str, head: str = "with") -> str:
    """The body with every study table and step it reads, directly or not, defined before it."""
    text, steps = body, []
    changed = True
    while changed:
        changed = False
        for name in STEPS:
            if name not in steps and re.search(rf"\b{name}\b", text):
                steps.append(name)
                text += STEPS[name]
                changed = True
    views = [name for name in VIEWS if re.search(rf"\b{name}\b", text)]
    parts = [with_views(*views)] if views else []
    parts += [f"{name} as ({STEPS[name].strip()})" for name in STEPS if name in steps]
    return f"{head} " + ",\n".join(parts) + "\n" + body


def _life_table(lives: str) -> str:
    """Product-limit estimate with its running sums."""
    return f"""
        , days as (
          select strata, cast(days as double) as time, count(*) filter (where status = 1) as d,
            count(*) filter (where status = 0) as c from {lives} group by all),
        risk as (
          select *, cast(sum(d + c) over (partition by strata order by time desc) as bigint) as n from days),
        summed as (
          select *, bool_or(d = n) over w as dead, sum(if(d < n, ln((n - d) / n), 0)) over w as log_s,
            sqrt(sum(if(d < n, d / (n * (n - d)), 0)) over w) as se
          from risk window w as (partition by strata order by time))"""


LIFE_VALUES = """
        select time, n as n_risk, d as n_event, c as n_censor, round(if(dead, 0, exp(log_s)), 6) as estimate,
          if(dead, 'infinity'::double, round(se, 6)) as std_error,
          if(dead, null, round(least(1.0, exp(log_s + 1.959963984540054 * se)), 6)) as conf_high,
          if(dead, null, round(exp(log_s - 1.959963984540054 * se), 6)) as conf_low, strata from summed"""

# A factor alone fits its cells exactly: log odds and errors have closed forms.
FACTOR_TERMS = """
        , cells_of as (
          select Race, sum(has_lsd) as a, sum(1 - has_lsd) as b, row_number() over (order by Race) as place
          from covariates group by Race),
        terms as (
          select if(x.place = 1, '(Intercept)', 'Race' || x.Race) as term,
            ln(x.a / x.b) - if(x.place = 1, 0, ln(r.a / r.b)) as estimate,
            sqrt(1 / x.a + 1 / x.b + if(x.place = 1, 0, 1 / r.a + 1 / r.b)) as std_error
          from cells_of x, (from cells_of where place = 1) r)"""

# Turn by turn: the k-th exposed of each partner takes the nearest control left.
def _turns(score: str) -> str:
    return f"""
        , scored as (select *, {score} as score from covariates),
        queue as (
          select person_id, data_partner_id, score, row_number() over (
            partition by data_partner_id order by score desc, person_id) as turn
          from scored where has_lsd = 1),
        pool as (select person_id, data_partner_id, score from scored where has_lsd = 0),
        played(data_partner_id, turn, exposed, control, gone) as (
          select distinct data_partner_id, cast(0 as bigint), cast(null as varchar), cast(null as varchar),
            cast([] as varchar[]) from covariates
          union all
          select data_partner_id, turn, exposed, control, list_append(gone, control) from (
            select q.data_partner_id, q.turn, q.person_id as exposed, p.gone, (
              select arg_min(c.person_id, row(abs(c.score - q.score), c.score, c.person_id)) from pool c
              where c.data_partner_id = q.data_partner_id and not list_contains(p.gone, c.person_id)) as control
            from played p join queue q on q.data_partner_id = p.data_partner_id and q.turn = p.turn + 1)
          where control is not null),
        pairs as (select exposed, control from played where exposed is not null)"""


# A single factor's scores are the shares exposed of its levels.
ONE_FACTOR = _turns("round(avg(has_lsd) over (partition by Race), 9)")
MATCHED_FACTS = """
        , matched_facts as (
          select * from facts where person_id in (select exposed from pairs union select control from pairs))"""
MATCHED_STEPS = ("deaths", "drug_window", "drug_survival", "drug_lives")


def _on_matched(name: str) -> str:
    """A step with the matched persons in the place of all."""
    body = re.sub(r"\bfacts\b", "matched_facts", STEPS[name])
    for step in MATCHED_STEPS:
        body = re.sub(rf"(from|join) {step}\b", rf"\1 matched_{step}", body)
    return f"matched_{name} as ({body.strip()})"


# Where the likelihood ratio of one factor's terms reaches the quantile, by halving. Given a
# level's coefficient, the intercept that fits best is the root of a quadratic.
PROFILE = """
        , cells_of as (
          select Race, sum(has_lsd)::double as a, sum(1 - has_lsd)::double as b, row_number() over (order by Race) as place
          from covariates group by Race),
        terms as (
          select if(x.place = 1, '(Intercept)', 'Race' || x.Race) as term, x.place = 1 as base, r.a as a0, r.a + r.b as n0,
            x.a as a1, x.a + x.b as n1, ln(x.a / x.b) - if(x.place = 1, 0, ln(r.a / r.b)) as estimate
          from cells_of x, (from cells_of where place = 1) r),
        sides as (
          select *, if(base, a0 * estimate - n0 * ln(1 + exp(estimate)),
              a0 * ln(a0 / (n0 - a0)) - n0 * ln(n0 / (n0 - a0)) + a1 * ln(a1 / (n1 - a1)) - n1 * ln(n1 / (n1 - a1))) as top
          from terms, (select unnest([-1, 1]) as side)),
        halved(step, term, side, near, far) as (
          select 0, term, side, estimate, estimate + 20 * side from sides
          union all
          select step + 1, term, side, if(inside, middle, near), if(inside, far, middle) from (
            select *, 2 * (top - if(base, a0 * middle - n0 * ln(1 + exp(middle)),
                (a0 + a1) * ln(x) + a1 * middle - n0 * ln(1 + x) - n1 * ln(1 + x * exp(middle)))) < 3.841458820694124 as inside
            from (
              select *, (-linear + sqrt(linear * linear + 4 * square * (a0 + a1))) / (2 * square) as x
              from (
                select h.*, s.base, s.a0, s.n0, s.a1, s.n1, s.top, (h.near + h.far) / 2 as middle,
                  exp((h.near + h.far) / 2) * (s.n0 + s.n1 - s.a0 - s.a1) as square,
                  s.n0 + s.n1 * exp((h.near + h.far) / 2) - (s.a0 + s.a1) * (1 + exp((h.near + h.far) / 2)) as linear
                from halved h join sides s on s.term = h.term and s.side = h.side where h.step < 60))))
        select term, round(any_value(estimate), 5) as estimate, round(max(near) filter (where side = -1), 5) as conf_low,
          round(max(near) filter (where side = 1), 5) as conf_high
        from halved join terms using (term) where step = 60 group by term"""


def _equations(rows: str, outcome: str, number: str, texts: tuple[str, ...]) -> str:
    """Sums of the outcome by term; at the fit those of the probabilities are the same."""
    sums = [f"select '(Intercept)' as term, sum({outcome}) as s from {rows}", f"select '{number}', sum({outcome} * {number}) from {rows}"]
    sums += [f"select '{text}' || {text}, sum({outcome}) from {rows} group by {text}" for text in texts]
    both = ", ".join(f"round(s::double, 3) as {name}" for name in ("observed", "fitted"))
    return f"select term, {both} from ({' union all '.join(sums)})"


# The facts columns that are cast.
INT_FACTS = (
    "age_at_covid",
    "number_of_visits_before_covid",
    "number_of_visits_post_covid",
    "number_of_COVID_vaccine_doses_before_or_day_of_covid",
    "number_of_COVID_vaccine_doses_post_covid",
)
FLOAT_FACTS = (
    "BMI_max_observed_or_calculated_before_or_day_of_covid",
    "BMI_max_observed_or_calculated_post_covid",
)
TYPED_CELLS = ", ".join(
    [f"try_cast(trunc(try_cast({name} as double)) as int) as {name}" for name in INT_FACTS]
    + [f"try_cast({name} as float) as {name}" for name in FLOAT_FACTS]
)
REJECTED = " union all ".join(
    f"select person_id, '{name}' as column_name, {name}::varchar as cell from patient_facts" for name in INT_FACTS + FLOAT_FACTS
)


def oracle_texts() -> dict[str, str]:
    rounded_cells = ", ".join(f"round(ifnull({c}, median({c}) over ()), 6) as {c}" for c in LAB_COLUMNS)
    missing = " union all ".join(
        f"select '{c}' as column_name, round(avg(if({c} is null, 1.0, 0.0)), 9) as missing_share from cells"
        for c in ("person_id", *LAB_COLUMNS)
    )
    bodies = {
        "codeset_members": "select * from exposure_set",
        "codeset_members_any_version": "select * from treatments",
        "events_in_concept_set": "select * from exposure_events",
        "events_in_concept_set_distinct": """
            select * from drug_exposure where drug_concept_id in (select concept_id from treatments)""",
        "code_to_standard_map": "select * from code_map",
        "extract_code": f"""
            select person_id, condition_start_date, condition_source_value, {ICD10_TEXT} as code
            from condition_occurrence""",
        "code_if_known": """
            select person_id, condition_start_date, condition_source_value, known as code
            from condition_occurrence left join known_codes on known = condition_source_value""",
        "resolve_condition_codes": "select * from resolved",
        "resolve_condition_codes_keep_unmapped": "select * from resolved_all",
        "latest_per_code": "select * from latest",
        "latest_per_code_exposed": "select * from exposed_latest",
        "resolve_condition_codes_wide": f"""
            , rows_of as (
              select distinct c.*, f.has_lsd from condition_occurrence c join facts f on f.person_id = c.person_id),
            coded as (
              select c.*, m.icd_concept_id, m.vocabulary_id, m.icd_concept_name,
                coalesce({ICD10_TEXT}, k.known) as icd_10_concept_code, m.concept_code,
                coalesce(m.concept_code, {ICD10_TEXT}, k.known) as combined_concept_code
              from rows_of c left join code_map m on m.icd_concept_id = c.condition_source_concept_id
              left join known_codes k on k.known = c.condition_source_value)
            select c.*, m.vocabulary_id as icd10_vocab_id, cast(null as varchar) as icd9_vocab_id,
              ifnull(c.vocabulary_id, m.vocabulary_id) as combined_vocab_id
            from coded c left join code_map m on m.concept_code = c.combined_concept_code""",
        "match_codes_any_route": "select * from any_route",
        "concept_hierarchy": "select * from hierarchy",
        "most_specific_condition": "select * from specific",
        "events_of_persons": "select * from exposed_conditions",
        "patient_facts": "select * from facts",
        "typed_table": f"""
            select f.* replace ({TYPED_CELLS}) from patient_facts f""",
        "rejected_cells": f"""
            select person_id, column_name, cell, if(column_name like 'BMI%', 'float', 'int') as wanted_type
            from ({REJECTED}) where cell is not null and try_cast(cell as double) is null""",
        "demographics": """
            select s.*, race_concept_id, race_concept_name, gender_concept_id, gender_concept_name, month_of_birth,
              year_of_birth, cast(2002 - year_of_birth - if(month_of_birth > 6, 1, 0) as int) as Age
            from specific s left join person p on p.person_id = s.person_id""",
        "impute_covariates": "select * from covariates",
        "propensity_score_one_factor": """
            select person_id, has_lsd, Race, round(avg(has_lsd) over (partition by Race), 6) as score from covariates""",
        "match_nearest": _turns("Age") + """
            select c.person_id, c.data_partner_id, c.has_lsd, c.score, p.exposed as subclass
            from pairs p join scored c on c.person_id in (p.exposed, p.control)""",
        "matched_persons_one_factor": ONE_FACTOR + """
            select c.person_id, c.data_partner_id, c.has_lsd, round(c.score, 6) as score, p.exposed as subclass
            from pairs p join scored c on c.person_id in (p.exposed, p.control)""",
        "matched_cohort_one_factor": ONE_FACTOR + MATCHED_FACTS + " select * from matched_facts",
        "matched_drug_survival_one_factor": ONE_FACTOR + MATCHED_FACTS + "".join(
            f", {_on_matched(name)}" for name in MATCHED_STEPS) + _life_table("matched_drug_lives") + LIFE_VALUES,
        "profile_bounds": PROFILE,
        "propensity_score_equations": _equations("covariates", "has_lsd", "Age", ("Race", "Sex")),
        "severity_model_equations": """
            , large as (select * from outcomes where age_at_covid is not null
              qualify count(*) over (partition by drug_concept_name) > 10)
            """ + _equations("large", "Binary_Severity", "age_at_covid", ("drug_concept_name", "race", "sex")),
        "restrict_to": "select * from patient_facts where person_id in (select person_id from specific)",
        "index_window_join": "select * from drug_window",
        "index_window_join_procedures": "select * from procedure_window",
        "binary_severity": """
            select person_id, severity_type, case when severity_type = 'Mild_No_ED_or_Hosp_around_COVID_index' then 0
              when severity_type is not null then 1 end as Binary_Severity from patient_facts""",
        "severity_outcome_drugs": "select * from outcomes",
        "measurements_with_units": "select * from labs_with_units",
        "measurement_window": "select * from panel_labs",
        "scale_of_code": "select * from loinc",
        "lab_panel": "select * from panel",
        "worst_value_grid": "select * from grid",
        "pivot_wide": """
            select * from cells where person_id in (select person_id from panel_labs)""",
        "missing_profile": missing,
        "impute_median_wide": f"select person_id, {rounded_cells} from cells",
        "impute_median": f"select person_id, {rounded_cells} from cells",
        "death_summary": "select * from deaths",
        "hospitalized_label": """
            select person_id, severity_type, if(severity_type is not distinct from
              'Mild_No_ED_or_Hosp_around_COVID_index', 'Not Hospitalized', 'Hospitalized') as Binary_Severity
            from patient_facts""",
        "keyword_class": f"""
            select codeset_id, concept_id, concept_name, {DRUG_NAME.format("concept_name")} as drug_name
            from concept_set_members""",
        "keyword_class_procedures": f"""
            select person_id, procedure_date, procedure_concept_name,
              {PROCEDURE_NAME.format("procedure_concept_name")} as procedure_name from procedure_occurrence""",
        "survival_table": "select * from drug_survival",
        "survival_table_procedures": "select * from procedure_survival",
        "kaplan_meier": _life_table("drug_lives") + LIFE_VALUES,
        "kaplan_meier_procedures": _life_table("procedure_lives") + LIFE_VALUES,
        "kaplan_meier_all_rows": _life_table("all_drug_lives") + LIFE_VALUES,
        "risk_table": """
            select strata, cast(t as double) as display_time, count(*) filter (where days >= t) as at_risk,
              count(*) filter (where days <= t and status = 1) as events
            from drug_lives, (select unnest([0, 500, 1000, 2000]) as t) group by strata, t""",
        "min_group_size": """
            select * from outcomes qualify count(*) over (partition by drug_concept_name) > 10""",
        "logistic_terms": FACTOR_TERMS + """
            select term, round(estimate, 5) as estimate, round(std_error, 5) as std_error,
              round(estimate / std_error, 5) as statistic,
              (select round(1 - 2 * sum(
                  exp(-0.5 * pow(abs(estimate / std_error) * i / 4000, 2))
                    * case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end)
                * abs(estimate / std_error) / 12000 / sqrt(2 * pi()), 5)
                from (select unnest(range(4001)) as i)) as p_value,
              round(estimate - 1.959963984540054 * std_error, 5) as conf_low,
              round(estimate + 1.959963984540054 * std_error, 5) as conf_high from terms""",
        "odds_ratios": FACTOR_TERMS + """
            select term, round(exp(estimate), 5) as odds_ratio,
              round(exp(estimate + 1.959963984540054 * std_error), 5) as top_ci,
              round(exp(estimate - 1.959963984540054 * std_error), 5) as bottom_ci from terms""",
        "comorbidity_flags": "select * from flags",
        "comorbidity_score": f"select person_id, cast({SCORE} as int) as score from flags",
        "comorbidity_flags_elixhauser": f"""
            select person_id, {_flag_columns(ELIXHAUSER)} from (
              select person_id, upper(regexp_replace(combined_concept_code, '[^A-Za-z0-9]', '', 'g')) as bare
              from latest where vocabulary_id = 'ICD10CM') group by person_id""",
        "score_histogram_exposed": f"""
            select cast({SCORE} as int) as score, count(*) as n
            from flags where person_id in (select person_id from specific) group by all""",
        "score_by_exposure": "select * from score_flags",
        "score_histogram": "select score, has_lsd, count(*) as n from score_flags group by all",
        "density_by_group": """
            , v as (
              select 'Hospitalized' as grp, days_diff as x from deaths
              where severity_type is distinct from 'Mild_No_ED_or_Hosp_around_COVID_index'
              union all
              select 'Not Hospitalized', days_diff from deaths
              where severity_type = 'Mild_No_ED_or_Hosp_around_COVID_index'),
            width as (
              select grp, 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34)
                * pow(count(*), -0.2) as h, count(*) as n from v group by grp),
            grid_of as (
              select lo + (hi - lo) * i / 511.0 as g
              from (select min(x) as lo, max(x) as hi from v), (select unnest(range(512)) as i))
            select v.grp as "group", round(g, 8) as x,
              round(sum(exp(-0.5 * pow((g - v.x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) as density
            from grid_of, v join width on width.grp = v.grp group by v.grp, g""",
        "map_phecodes": """
            select a.person_id, a.condition_start_date, a.has_lsd, p.*
            from any_route a join phecode_map p on p.code = a.concept_code""",
        "map_phecodes_exposed": """
            select l.person_id, p.* from exposed_latest l join phecode_map p on p.code = l.combined_concept_code""",
    }
    return {
        name: check(body, "with recursive" if "played(" in body or "halved(" in body else "with") for name, body in bodies.items()
    }
