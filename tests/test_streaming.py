"""Stream = batch checks for the Structured Streaming jobs (availableNow)."""

import datetime

import pytest
from pyspark.sql import functions as F

from halcyon.operators import ingest as V
from halcyon.operators import stats as T
from halcyon.session import scratch_path
from halcyon.sources.claims import RAW_COLUMNS
from halcyon.streaming import jobs as J
from halcyon.streaming import scoring as SC


def _claims_with_ts(small_claims):
    return small_claims.withColumn("claim_ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'")
                                   + F.make_interval(days=F.col("claim_key").cast("int")))


def test_stream_dedupe_equals_batch(spark, small_claims):
    c = _claims_with_ts(small_claims)
    copies = c.unionByName(c.where("claim_key % 2 = 0")).unionByName(c.where("claim_key = 1"))
    path = J.land_files(copies, scratch_path(spark, "t-landing"), files=4, order_by="claim_ts")
    out = J.dedupe_stream(spark, path, copies.schema)
    batch = V.dedupe_claims(V.with_claim_id(copies, RAW_COLUMNS).select("claim_id"))
    assert sorted(r["claim_id"] for r in out.select("claim_id").collect()) == \
        sorted(r["claim_id"] for r in batch.collect())
    assert out.count() == 8


def test_drift_does_not_depend_on_batches(spark, small_claims):
    """KS of each window against the windows before it, the same from one file a batch and from all at once, and by brute force."""
    c = spark.createDataFrame([(k, 20 + (k * 7) % 45, float(k % 13) + (k // 50)) for k in range(200)], "claim_key long, age int, bmi double") \
        .withColumn("claim_ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_interval(days=F.col("claim_key").cast("int")))
    got = []
    for files in (1, 7):
        path = J.land_files(c, scratch_path(spark, "t-landing"), files=files, order_by="claim_ts")
        out = J.drift_stream(spark, path, c.schema, ["age", "bmi"], window="50 days", delay="10 days")
        got.append(sorted((str(r.window_start), r.feature, r.ks_statistic, r.n_ref, r.n_cur, r.p_value) for r in out.collect()))
    assert got[0] == got[1] and len({r[0] for r in got[0]}) >= 3
    rows = [(r.claim_ts, r.age, r.bmi) for r in c.collect()]
    for start, feature, ks, n_ref, n_cur, _ in got[0]:
        lo = datetime.datetime.fromisoformat(start)
        i = 1 if feature == "age" else 2
        ref = [r[i] for r in rows if r[0] < lo]
        cur = [r[i] for r in rows if lo <= r[0] < lo + datetime.timedelta(days=50)]
        assert (n_ref, n_cur) == (len(ref), len(cur))
        assert abs(ks - max(abs(sum(x <= v for x in ref) / len(ref) - sum(x <= v for x in cur) / len(cur)) for v in {*ref, *cur})) < 1e-12


class TinyScorer:
    """Stands in for the fitted models: flags large ages; fails once, in the middle of a batch, if asked to."""
    fail_at = None

    def score(self, df, key="claim_key"):
        if TinyScorer.fail_at is not None:
            bad = TinyScorer.fail_at
            df = df.withColumn("age", F.when(F.col(key) == bad, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("age")))
        note = F.when(F.col("clinical_note").isNotNull(), F.struct(F.lit("x").alias("keywords")))
        return df.select(key, F.struct((F.col("age") > 60).alias("is_anomaly")).alias("anomaly_detection"), note.alias("nlp_analysis"), "sex", "region", "smoker")


def _requests(spark, n):
    rows = [(k, -3 if k % 10 == 0 else 20 + k % 60, " MALE" if k % 2 else "female", 25.0, 1, k % 3 == 0, "nowhere" if k % 15 == 1 else " southeast ",
             None if k % 4 == 0 else "note") for k in range(n)]
    return spark.createDataFrame(rows, "claim_key long, age int, gender string, bmi double, children int, smoker boolean, region string, clinical_note string")


def test_requests_scored_and_rejected_exactly_once(spark):
    """A batch fails after it wrote one of its outputs; the restarted stream repeats it, and files and totals hold every request once."""
    req = _requests(spark, 300)
    path = J.land_files(req, scratch_path(spark, "t-requests"), files=30)
    sink, checkpoint = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    run = lambda: J.score_stream(spark, TinyScorer(), path, req.schema, sink, checkpoint, requests=True, files_per_batch=1)
    TinyScorer.fail_at = 157
    with pytest.raises(Exception, match="lost"):
        run()
    before = J.serving_metrics(spark, sink).first()
    assert 0 < before.batches_total < 30
    TinyScorer.fail_at = None
    run()
    ok, bad = V.split_valid_rejected(req)
    scored, rejected = J.scored(spark, sink), J.rejected(spark, sink)
    batch, _ = SC.score_requests(TinyScorer(), req)
    cols = batch.columns
    assert sorted(map(str, scored.select(*cols).collect())) == sorted(map(str, batch.collect()))
    assert sorted(r.claim_key for r in rejected.collect()) == sorted(r.claim_key for r in bad.collect())
    total = J.serving_metrics(spark, sink).first()
    assert (total.batches_total, total.predictions_total, total.rejected_total) == (30, ok.count(), bad.count())
    assert total.anomalies_flagged == ok.where("age > 60").count() and total.nlp_analyses_total == ok.where("clinical_note IS NOT NULL").count()
    assert total.total_processing_ms > before.total_processing_ms > 0 and total.avg_processing_ms == round(total.total_processing_ms / total.predictions_total, 2)
    assert scored.where("timestamp IS NULL OR processing_time_ms <= 0").count() == 0


def test_claim_stream_turns_down_invalid_claims(spark, small_claims):
    """Arriving claims pass V8 before they are scored; those that do keep their columns, the others stand beside them with reasons."""
    bad = [(11, 0, "male", 25.0, 1, "no", "southeast"), (12, 40, None, 25.0, 1, "no", "southeast"), (13, 40, "male", 71.0, 11, "no", "southeast"),
           (14, 40, "male", 25.0, 1, None, "nowhere")]
    odd = spark.createDataFrame([(*r, 100.0, "note", "E11") for r in [*bad, (15, 40, " MALE", 25.0, 1, "yes", "SouthEast ")]], small_claims.schema)
    c = small_claims.unionByName(odd)
    path = J.land_files(c, scratch_path(spark, "t-claims"), files=3)
    sink = J.score_stream(spark, TinyScorer(), path, c.schema)
    scored = {r.claim_key: (r.sex, r.region) for r in J.scored(spark, sink).collect()}
    assert scored == {r.claim_key: (r.sex, r.region) for r in c.collect() if not 11 <= r.claim_key <= 14}
    assert {r.claim_key: r.reject_reasons for r in J.rejected(spark, sink).collect()} == {
        11: ["age_out_of_range"], 12: ["gender_missing"], 13: ["bmi_out_of_range", "children_out_of_range"], 14: ["smoker_missing", "region_invalid"]}
    total = J.serving_metrics(spark, sink).first()
    assert (total.predictions_total, total.rejected_total) == (len(scored), 4)


def test_monitor_summary(spark):
    log = spark.createDataFrame([(True,), (False,), (False,), (False,)], "is_anomaly boolean")
    drift = spark.createDataFrame([("bmi", True), ("age", False), ("charges", True)],
                                  "feature string, drift_detected boolean")
    r = T.monitor_summary(log, drift, processing_ms=10.0).first()
    assert r["request_count"] == 4 and r["anomaly_count"] == 1 and r["anomaly_rate"] == 25.0
    assert r["avg_processing_ms"] == 2.5
    assert r["drift_status"] == "Data drift detected in features: bmi, charges"
    none = spark.createDataFrame([("age", False)], "feature string, drift_detected boolean")
    assert T.monitor_summary(log, none).first()["drift_status"] == "No drift detected."
