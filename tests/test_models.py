"""Invariant tests for the fitted models on seeded inputs (values depend on
RNG and binning, so only the properties are pinned, never the numbers)."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from halcyon.operators import approval as AP
from halcyon.operators import clusters as CL
from halcyon.operators import isoforest as IF
from halcyon.operators import notemodels as NM


BLOBS = [(-6.0, 1.0, 3.0), (5.0, -4.0, 0.5), (0.0, 8.0, -7.0), (9.0, 9.0, 6.0)]


@pytest.fixture(scope="module")
def blobs(spark):
    """Four uniform cubes of 40 points around fixed centres."""
    rng = np.random.default_rng(1707)
    x = np.concatenate([c + rng.uniform(-1.5, 1.5, size=(40, 3)) for c in np.array(BLOBS)])
    rows = [(int(i), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "claim_key long, a double, b double, c double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_isolation_forest_flags_a_far_point(spark, blobs):
    model, train = IF.fit_isolation_forest(blobs, ["claim_key"], n_trees=50)
    far = spark.createDataFrame([(-1, -70.0, 66.0, -61.5)], "claim_key long, a double, b double, c double")
    far = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(far)
    r = model.predict(far, train).first()
    assert r["is_anomaly"] is True
    assert r["flag_reason"].startswith("Severely")
    assert r["percentile_rank"] == 0.0


def test_isolation_forest_rate_and_ranks(blobs):
    model, train = IF.fit_isolation_forest(blobs, ["claim_key"], n_trees=50)
    rate = model.train_stats["anomaly_rate_pct"]
    assert 3.0 <= rate <= 7.0
    ranks = [r["percentile_rank"] for r in model.predict(blobs, train).collect()]
    assert all(0.0 <= p <= 100.0 for p in ranks)


def test_isolation_forest_is_deterministic(blobs):
    a, _ = IF.fit_isolation_forest(blobs, ["claim_key"], n_trees=20)
    b, _ = IF.fit_isolation_forest(blobs.repartition(5), ["claim_key"], n_trees=20)
    assert a.offset == pytest.approx(b.offset)


def test_avg_path_length():
    assert IF.avg_path_length(1) == 0.0 and IF.avg_path_length(2) == 1.0
    assert IF.avg_path_length(256) == pytest.approx(10.244770920116851, rel=1e-9)


def test_kmeans_segments(spark, blobs):
    """The four cubes are the four segments, labelled by their mean charge."""
    df = blobs.selectExpr("*", "40 + a AS age", "27 + b AS bmi", "9000 + 400 * c AS charges", "claim_key % 3 AS children", "a * 0.2 AS risk_score")
    seg = CL.fit_segments(df, k=4, n_init=3)
    out = seg.assign(df).collect()
    assert len(out) == 160 and all(len({r["cluster_id"] for r in out if r["claim_key"] // 40 == k}) == 1 for k in range(4))
    by_charge = sorted(range(4), key=lambda k: BLOBS[k][2])
    label = {r["claim_key"] // 40: r["risk_label"] for r in out}
    assert [label[k] for k in by_charge] == ["Low Risk", "Moderate Risk", "High Risk", "Critical Risk"]
    assert {r["segment_risk_score"] for r in out} == {0.0, 3.3, 6.7, 10.0}


def test_silhouette_of_separate_cubes(spark, blobs):
    m = CL.fit_kmeans(blobs, 4, n_init=2)
    s = CL.silhouette(m.transform(blobs)).first()
    assert 0.7 < s["silhouette"] <= 1.0 and s["n"] == 160


def test_approval_probabilities(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, size=(200, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    rows = [(int(i), int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "claim_key long, approved int, f0 double, f1 double, f2 double, f3 double, "
                                     "f4 double")
    df = VectorAssembler(inputCols=[f"f{i}" for i in range(5)], outputCol="features").transform(df)
    model, scored = AP.fit_approval(df, num_trees=30)
    preds = model.predict(df).collect()
    assert all(0.0 <= r["approval_probability"] <= 1.0 for r in preds)
    assert all(r["approval_confidence"] in ("high", "medium", "low") for r in preds)
    assert len(preds[0]["decision_factors"]) == 3 and all(isinstance(f, str) for f in preds[0]["decision_factors"])
    assert model.evaluation["roc_auc"] > 0.8


ICD_NOTES = {
    "K21": ["Heartburn after every meal, acid taste at night.", "Burning behind the breastbone, antacid helps."],
    "M54": ["Stiff lower back since lifting a crate.", "Back ache spreads to the left leg when bending."],
    "L20": ["Itchy dry skin in the elbow folds.", "Eczema flare on both hands, emollient renewed."],
    "N39": ["Burning on passing urine for three days.", "Frequent urination, urine culture sent off."],
    "H10": ["Sticky red eye on waking, drops started.", "Watery itchy eyes in pollen season."],
}


def test_icd_classifier_learns_the_codes(spark):
    rows = [(i, n, c) for i, (c, n) in enumerate((c, n) for _ in range(5) for c, notes in ICD_NOTES.items() for n in notes)]
    df = spark.createDataFrame(rows, "claim_key long, clinical_note string, icd_code string")
    model, held = NM.fit_icd(df, max_iter=200)
    probes = {"Acid and heartburn at night.": "K21", "Lower back ache when lifting.": "M54", "Dry itchy skin, eczema again.": "L20"}
    got = model.predict(spark.createDataFrame(list(enumerate(probes)), "claim_key long, clinical_note string")).collect()
    for r in got:
        assert r["predicted_icd"] == list(probes.values())[r["claim_key"]]
        assert len(r["alternative_codes"]) == 3 and r["predicted_icd"] not in [a["code"] if not isinstance(a, str) else a for a in r["alternative_codes"]][1:]
        assert set(r["all_probabilities"]) == set(ICD_NOTES) and sum(r["all_probabilities"].values()) == pytest.approx(1.0)


def test_topic_labels(spark):
    df = spark.createDataFrame([(["cough", "asthma"],), (["heart", "insulin"],), (["fever"],)], "t array<string>")
    got = [r["l"] for r in df.select(NM.topic_label(F.col("t")).alias("l")).collect()]
    assert got == ["Respiratory Conditions", "Metabolic Disorders", "General Medicine"]
