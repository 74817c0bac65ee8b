import pytest
import random

from pyspark.sql import functions as F

from halcyon.functions import notes as N


def _one(spark, note, expr):
    return spark.createDataFrame([(note,)], "n string").select(expr(F.col("n")).alias("o")).first()["o"]


def test_medications_are_whole_words_in_any_case(spark):
    assert _one(spark, "LOSARTAN kept, ramipril stopped; no aspirins.", N.medications) == ["losartan", "ramipril"]


def test_blood_pressure_alone(spark):
    v = _one(spark, "Sitting 117/71 mmHg after ten minutes.", N.vitals)
    assert (v["blood_pressure"]["systolic"], v["blood_pressure"]["diastolic"]) == (117, 71)
    assert v["bmi"] is None and v["hba1c"] is None and v["heart_rate"] is None


def test_other_vitals_without_blood_pressure(spark):
    v = _one(spark, "hr 61 bpm; bmi of 22.8; HbA1c 6.2 %", N.vitals)
    assert (v["heart_rate"], v["bmi"], v["hba1c"], v["blood_pressure"]) == (61, 22.8, 6.2, None)


def test_conditions_canonical_case(spark):
    c = _one(spark, "Known copd and Diabetes; asthma in childhood.", N.conditions)
    assert c == ["COPD", "asthma", "diabetes"]


def test_procedures_canonical_case(spark):
    assert _one(spark, "ecg and chest x-ray, then a ct scan.", N.procedures) == ["CT scan", "ECG", "X-ray"]


def test_clean_expands_abbreviations(spark):
    out = _one(spark, "  Tx: FBC repeated (QDS), Dx open?  ", N.clean_note)
    assert out == out.strip() and "  " not in out and "?" not in out and "(" not in out
    assert all(x in out for x in ("treatment", "full blood count", "four times daily", "diagnosis"))


def test_clean_word_boundary(spark):
    # 'od' inside a word is not an abbreviation
    assert "once daily" not in _one(spark, "A good outcome.", N.clean_note)


def test_clean_is_the_same_as_one_replacement_after_the_other(spark):
    rng = random.Random(5)
    parts = [a for a, _ in N.ABBREVIATIONS] + ["bp", "Od", "mI", "é", "_", "-", " ", "  ", "\n", "\t", "\r\n", "x", "7", "BMIs", "K", "\u2028", "/", "İ", "😀"]
    notes = ["", " ", "BP", "BPBP", "éBP", "x_BP", "BP\n", "\nBP\n", None] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    x = F.col("n")
    for abbr, full in N.ABBREVIATIONS:
        x = F.regexp_replace(x, r"(?i)\b" + abbr + r"\b", full)
    x = F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    words = F.split(x, " ")
    u, r = F.size(F.filter(words, lambda w: w.isin(N.URGENT_WORDS))), F.size(F.filter(words, lambda w: w.isin(N.ROUTINE_WORDS)))
    label = F.when(u > r, "urgent").when(r > u, "routine").otherwise("moderate")
    df = spark.createDataFrame([(n,) for n in notes + ["Severe, stable; urgent", "Mild BP check", "Angina"]], "n string")
    got = df.select("n", N.clean_note("n").alias("a"), x.alias("b"), N.urgency("n").alias("c"), label.alias("d")).collect()
    assert [(q.n, q.a, q.c) for q in got] == [(q.n, q.b, q.d) for q in got]


def test_urgency_by_majority(spark):
    assert _one(spark, "Sepsis feared, collapse at home; troponin sent.", N.urgency) == "urgent"
    assert _one(spark, "Screening visit, mild hay fever, reassured.", N.urgency) == "routine"
    assert _one(spark, "Came with a form to sign.", N.urgency) == "moderate"


def test_summary(spark):
    df = spark.createDataFrame([("Diabetes, on metformin. BP 140/90 mmHg.",)], "n string")
    s = df.select(N.entities("n").alias("e")).first()["e"]["clinical_summary"]
    assert s == "Patient with diabetes prescribed metformin Vitals: BP 140/90 mmHg."


def test_summary_without_entities(spark):
    df = spark.createDataFrame([("Nothing notable.",)], "n string")
    assert df.select(N.entities("n").alias("e")).first()["e"]["clinical_summary"] == "Patient."


def test_stop_words_match_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    from halcyon.operators.text import english_stop_words
    assert english_stop_words() == list(StopWordsRemover.loadDefaultStopWords("english"))


def test_model_fits_shuffle_and_keep_notes_not_their_terms(monkeypatch, small_claims):
    from halcyon.operators import notemodels as NM
    seen = []

    def record(df, *args, **kwargs):
        seen.append(df.columns)
        raise RuntimeError("seen")
    monkeypatch.setattr(NM, "size_partitions", record)
    for fit in (NM.fit_icd, NM.fit_topics):
        with pytest.raises(RuntimeError, match="seen"):
            fit(small_claims)
    assert len(seen) == 2 and all("terms" not in c for c in seen)
