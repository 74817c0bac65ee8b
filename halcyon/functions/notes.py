"""Clinical-note expressions: cleaning, urgency, dictionaries, vitals, summary.

All of them are native Catalyst expressions (regexp, higher-order array
functions), so they stay inside whole-stage codegen and run over whole notes
of any length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
ABBREVIATIONS = [
    ("BP", "blood pressure"),
    ("BMI", "body mass index"),
    ("Hx", "history"),
    ("Rx", "prescription"),
    ("Dx", "diagnosis"),
    ("Tx", "treatment"),
    ("SOB", "shortness of breath"),
    ("HTN", "hypertension"),
    ("DM", "diabetes mellitus"),
    ("MI", "myocardial infarction"),
    ("ECG", "electrocardiogram"),
    ("FBC", "full blood count"),
    ("OD", "once daily"),
    ("BD", "twice daily"),
    ("TDS", "three times daily"),
    ("QDS", "four times daily"),
]
URGENT_WORDS = [
    "critical", "emergency", "severe", "severely", "uncontrolled", "acute", "urgent",
    "urgently", "admitted", "admission", "troponin", "arrest", "immediate", "unstable",
    "sepsis", "collapse", "worsening", "progressive", "decline", "complication",
    "complicated", "exacerbation", "angina", "dyspnoea", "dyspnea", "infarction",
]
ROUTINE_WORDS = [
    "stable", "controlled", "elective", "routine", "annual", "wellness", "preventive",
    "screening", "normal", "lifestyle", "reassured", "mild", "regular", "check",
    "review", "monitoring", "follow", "scheduled",
]
MEDICATIONS = [
    "metformin", "amlodipine", "atorvastatin", "aspirin", "ramipril", "bisoprolol", "insulin",
    "omeprazole", "paracetamol", "amoxicillin", "salbutamol", "tiotropium", "sertraline",
    "nitrofurantoin", "empagliflozin", "rosuvastatin", "losartan", "prednisolone",
]
CONDITIONS = [
    "diabetes", "hypertension", "COPD", "obesity", "asthma", "hyperlipidemia", "pneumonia",
    "malaria", "typhoid", "anaemia", "depression", "anxiety", "ischaemic",
]
CONDITION_SYNONYMS = {"ischemic": "ischaemic"}
PROCEDURES = [
    "ECG", "X-ray", "MRI", "CT scan", "ultrasound", "spirometry", "echocardiogram",
    "blood test", "urinalysis", "colonoscopy",
]
BP_PATTERN = r"(\d{2,3})[/\\](\d{2,3})\s*mmhg"
BMI_PATTERN = r"bmi\s*(?:of\s*)?(?:is\s*)?(\d{2,3}(?:\.\d)?)"
HBA1C_PATTERN = r"hba1c\s*(?:of\s*)?(\d{1,2}(?:\.\d)?)\s*%"
HR_PATTERN = r"hr\s*(\d{2,3})\s*bpm"
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


_ABBREVIATION = r"\b(?:" + "|".join(a for a, _ in ABBREVIATIONS) + r")\b"
#: an abbreviation, or the text up to the next one
_PIECE = rf"(?is){_ABBREVIATION}|.+?(?={_ABBREVIATION}|\z)"


def clean_note(col) -> Column:
    """Expand abbreviations (whole word, any case), lower-case, keep
    [a-z0-9] and blanks, squeeze blanks, trim (N1).

    One pass cuts the note into abbreviations and the text between them; no
    expansion holds an abbreviation, so one look-up each replaces them all."""
    full = F.create_map(*[F.lit(v) for abbr, text in ABBREVIATIONS for v in (abbr.lower(), text)])
    pieces = F.regexp_extract_all(_c(col), F.lit(_PIECE), 0)
    expanded = F.transform(pieces, lambda p: F.coalesce(F.element_at(full, F.lower(p)), p))
    x = F.lower(F.array_join(expanded, ""))
    return F.trim(F.regexp_replace(x, F.lit(r"[^a-z0-9]+"), F.lit(" ")))


def urgency(col, cleaned: bool = False) -> Column:
    """urgent / routine / moderate by counting marker words (N2); the note is cleaned once."""
    text = _c(col) if cleaned else clean_note(col)
    more = F.aggregate(F.split(F.coalesce(text, F.lit("")), " "), F.lit(0), lambda n, w: n + w.isin(URGENT_WORDS).cast("int") - w.isin(ROUTINE_WORDS).cast("int"))
    labels = F.array(F.lit("routine"), F.lit("moderate"), F.lit("urgent"))
    return F.element_at(labels, F.signum(more).cast("int") + 2)


def _alternation(terms: Sequence[str]) -> str:
    import re
    return r"\b(?:" + "|".join(re.escape(t.lower()).replace(r"\ ", " ") for t in terms) + r")\b"


def find_terms(col, terms: Sequence[str], synonyms: Mapping[str, str] | None = None) -> Column:
    """Sorted distinct dictionary terms found in the note, in canonical case."""
    canon = {t.lower(): t for t in terms}
    canon.update(synonyms or {})
    found = F.regexp_extract_all(F.lower(_c(col)), F.lit(_alternation(terms)), 0)
    m = F.create_map(*[x for k, v in canon.items() for x in (F.lit(k), F.lit(v))])
    mapped = F.transform(found, lambda t: F.coalesce(F.element_at(m, t), t))
    return F.array_sort(F.array_distinct(mapped))


def medications(col) -> Column:
    return find_terms(col, MEDICATIONS)


def conditions(col) -> Column:
    return find_terms(col, CONDITIONS, CONDITION_SYNONYMS)


def procedures(col) -> Column:
    return find_terms(col, PROCEDURES)


def _first_group(col, pattern: str, group: int) -> Column:
    v = F.regexp_extract(F.lower(_c(col)), pattern, group)
    return F.nullif(v, F.lit(""))


def vitals(col) -> Column:
    """First BP (systolic/diastolic), BMI, HbA1c and heart rate; null when absent."""
    sys_ = _first_group(col, BP_PATTERN, 1).cast("int")
    dia = _first_group(col, BP_PATTERN, 2).cast("int")
    bp = F.when(sys_.isNotNull(), F.struct(sys_.alias("systolic"), dia.alias("diastolic")))
    return F.struct(
        bp.alias("blood_pressure"),
        _first_group(col, BMI_PATTERN, 1).cast("double").alias("bmi"),
        _first_group(col, HBA1C_PATTERN, 1).cast("double").alias("hba1c"),
        _first_group(col, HR_PATTERN, 1).cast("int").alias("heart_rate"),
    )


def clinical_summary(conds: Column, meds: Column, vit: Column) -> Column:
    """'Patient with ... prescribed ... Vitals: BP s/d mmHg.' (N7)."""
    head = F.when(F.size(conds) > 0, F.concat(F.lit("Patient with "), F.array_join(conds, ", "))) \
        .otherwise(F.lit("Patient"))
    med = F.when(F.size(meds) > 0, F.concat(F.lit("prescribed "), F.array_join(meds, ", ")))
    bp = vit.getField("blood_pressure")
    bpt = F.when(bp.isNotNull(), F.concat(F.lit("Vitals: BP "), bp.getField("systolic").cast("string"), F.lit("/"),
                                          bp.getField("diastolic").cast("string"), F.lit(" mmHg")))
    s = F.trim(F.concat_ws(" ", head, med, bpt))
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def entities(col) -> Column:
    """All note entities as one struct column."""
    meds, conds, procs, vit = medications(col), conditions(col), procedures(col), vitals(col)
    return F.struct(meds.alias("medications"), conds.alias("conditions"), procs.alias("procedures"),
                    vit.alias("vitals"), clinical_summary(conds, meds, vit).alias("clinical_summary"))
