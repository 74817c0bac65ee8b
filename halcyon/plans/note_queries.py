"""Registered queries: clinical-note operators (N1-N7) on the claims notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from halcyon.functions import notes as N
from halcyon.plans.registry import register
from halcyon.plans.sqlviews import with_claims
from halcyon.sources.claims import claims


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(expr: str) -> str:
    """The cleaning rule as DuckDB SQL (RE2 regexes with the global flag)."""
    x = expr
    for abbr, full in N.ABBREVIATIONS:
        x = f"regexp_replace({x}, '\\b{abbr}\\b', {_sql_str(full)}, 'gi')"
    x = f"lower({x})"
    x = f"regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"trim({x})"


def _in_list(words):
    return "[" + ", ".join(_sql_str(w) for w in words) + "]"


def urgency_sql(cleaned: str) -> str:
    words = f"string_split({cleaned}, ' ')"
    u = f"len(list_filter({words}, lambda w: list_contains({_in_list(N.URGENT_WORDS)}, w)))"
    r = f"len(list_filter({words}, lambda w: list_contains({_in_list(N.ROUTINE_WORDS)}, w)))"
    return f"CASE WHEN {u} > {r} THEN 'urgent' WHEN {r} > {u} THEN 'routine' ELSE 'moderate' END"


def terms_sql(expr: str, terms, synonyms=None) -> str:
    canon = {t.lower(): t for t in terms}
    canon.update(synonyms or {})
    pat = N._alternation(terms).replace("'", "''")
    found = f"regexp_extract_all(lower({expr}), '{pat}', 0)"
    case = "CASE t " + " ".join(f"WHEN {_sql_str(k)} THEN {_sql_str(v)}" for k, v in canon.items()) + " ELSE t END"
    return f"array_to_string(list_sort(list_distinct(list_transform({found}, lambda t: {case}))), '|')"


def vital_sql(expr: str, pattern: str, group: int, typ: str) -> str:
    p = pattern.replace("'", "''")
    return f"CAST(nullif(regexp_extract(lower({expr}), '{p}', {group}), '') AS {typ})"


@register("clean_note", with_claims() + f"SELECT claim_key, {clean_sql('clinical_note')} AS cleaned_note FROM claims")
def q_clean_note(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_key", N.clean_note("clinical_note").alias("cleaned_note"))


@register("note_urgency", with_claims() + f"""
SELECT claim_key, {urgency_sql(clean_sql('clinical_note'))} AS urgency FROM claims""")
def q_urgency(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_key", N.urgency("clinical_note").alias("urgency"))


@register("note_entities", with_claims() + f"""
SELECT claim_key,
       {terms_sql('clinical_note', N.MEDICATIONS)} AS medications,
       {terms_sql('clinical_note', N.CONDITIONS, N.CONDITION_SYNONYMS)} AS conditions,
       {terms_sql('clinical_note', N.PROCEDURES)} AS procedures
FROM claims""")
def q_entities(spark, sf_dir):
    c = claims(spark, sf_dir)
    return c.select("claim_key",
                    F.array_join(N.medications("clinical_note"), "|").alias("medications"),
                    F.array_join(N.conditions("clinical_note"), "|").alias("conditions"),
                    F.array_join(N.procedures("clinical_note"), "|").alias("procedures"))


@register("note_vitals", with_claims() + f"""
SELECT claim_key,
       {vital_sql('clinical_note', N.BP_PATTERN, 1, 'INTEGER')} AS systolic,
       {vital_sql('clinical_note', N.BP_PATTERN, 2, 'INTEGER')} AS diastolic,
       {vital_sql('clinical_note', N.BMI_PATTERN, 1, 'DOUBLE')} AS bmi,
       {vital_sql('clinical_note', N.HBA1C_PATTERN, 1, 'DOUBLE')} AS hba1c,
       {vital_sql('clinical_note', N.HR_PATTERN, 1, 'INTEGER')} AS heart_rate
FROM claims""")
def q_vitals(spark, sf_dir):
    v = claims(spark, sf_dir).select("claim_key", N.vitals("clinical_note").alias("v"))
    return v.select("claim_key", F.col("v.blood_pressure.systolic").alias("systolic"),
                    F.col("v.blood_pressure.diastolic").alias("diastolic"),
                    F.col("v.bmi").alias("bmi"), F.col("v.hba1c").alias("hba1c"),
                    F.col("v.heart_rate").alias("heart_rate"))


def _summary_sql():
    conds = terms_sql("clinical_note", N.CONDITIONS, N.CONDITION_SYNONYMS).replace(", '|')", ", ', ')")
    meds = terms_sql("clinical_note", N.MEDICATIONS).replace(", '|')", ", ', ')")
    sys_ = vital_sql("clinical_note", N.BP_PATTERN, 1, "INTEGER")
    dia = vital_sql("clinical_note", N.BP_PATTERN, 2, "INTEGER")
    return f"""
parts AS (
  SELECT claim_key, {conds} AS conds, {meds} AS meds, {sys_} AS sys, {dia} AS dia FROM claims
),
summ AS (
  SELECT claim_key, trim(concat_ws(' ',
           CASE WHEN conds <> '' THEN 'Patient with ' || conds ELSE 'Patient' END,
           CASE WHEN meds <> '' THEN 'prescribed ' || meds END,
           CASE WHEN sys IS NOT NULL THEN 'Vitals: BP ' || CAST(sys AS VARCHAR) || '/' || CAST(dia AS VARCHAR)
                || ' mmHg' END)) AS s
  FROM parts
)"""


@register("clinical_summary", with_claims(_summary_sql()) + """
SELECT claim_key, CASE WHEN s LIKE '%.' THEN s ELSE s || '.' END AS clinical_summary FROM summ""")
def q_summary(spark, sf_dir):
    c = claims(spark, sf_dir)
    meds, conds, vit = N.medications("clinical_note"), N.conditions("clinical_note"), N.vitals("clinical_note")
    return c.select("claim_key", N.clinical_summary(conds, meds, vit).alias("clinical_summary"))
