"""Registered queries: combined scoring (X1) and the streaming jobs.

Streams read claim and request files that Spark writes from the given tables into the
shared folder, run with ``availableNow`` and return the sink contents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from halcyon.operators import ranks as K
from halcyon.plans import model_queries as MQ
from halcyon.plans.claims_queries import _CANON_SQL
from halcyon.plans.registry import register
from halcyon.plans.sqlviews import CLAIM_REQUESTS, with_claims
from halcyon.session import scratch_path
from halcyon.sources.claims import claim_requests, claims
from halcyon.sources.models import load_models, save_models
from halcyon.streaming import jobs as J
from halcyon.streaming import scoring as SC

DRIFT_COLUMNS = ["age", "bmi", "children", "charges"]


def scorer(spark, sf_dir) -> SC.ClaimScorer:
    def build():
        m, pre = MQ.matrix(spark, sf_dir)
        iso, train = MQ.anomaly_model(spark, sf_dir)
        return SC.ClaimScorer(pre=pre, cost=MQ.cost_model(spark, sf_dir), anomaly=iso, levels=K.rank_levels(train, "decision"),
                              segments=MQ.segmentation(spark, sf_dir), approval=MQ.approval_model(spark, sf_dir)[0],
                              icd=MQ.icd_model(spark, sf_dir)[0], keywords=SC.fit_keywords(claims(spark, sf_dir)))
    return MQ._memo(spark, sf_dir, "scorer", build)


def landed_claims(spark, sf_dir, with_copies: bool = False) -> tuple[str, object]:
    """Claims written as 8 files in event-time order (the stream source)."""
    def build():
        c = claims(spark, sf_dir)
        if with_copies:
            c = c.unionByName(c.where(F.col("claim_key") % 10 == 0))
        path = J.land_files(c, scratch_path(spark, "landing-claims"), files=8, order_by="claim_ts")
        return path, c.schema
    return MQ._memo(spark, sf_dir, f"landed-{with_copies}", build)


@register("score_claims")
def q_score_claims(spark, sf_dir):
    """One nested row per claim from all models (+ NLP when a note exists)."""
    return scorer(spark, sf_dir).score(claims(spark, sf_dir))


@register("score_requests")
def q_score_requests(spark, sf_dir):
    """Requests without charges, validated, made canonical and scored."""
    return SC.score_requests(scorer(spark, sf_dir), claim_requests(spark, sf_dir))[0]


@register("model_folder")
def q_model_folder(spark, sf_dir):
    """All models of the scorer and the topics saved as one published version, loaded back and used to score the requests."""
    s = scorer(spark, sf_dir)
    folder = scratch_path(spark, "model-folder")
    models = {"pre": s.pre, "cost": s.cost, "anomaly": s.anomaly, "segments": s.segments, "approval": s.approval, "icd": s.icd,
              "keywords": s.keywords, "topics": MQ.topic_model(spark, sf_dir)}
    save_models(spark, folder, models)
    m = load_models(spark, folder)
    again = SC.ClaimScorer(levels=s.levels, **{k: v for k, v in m.items() if k != "topics"})
    topics = m["topics"].assign(claims(spark, sf_dir).select("claim_key", "clinical_note")).select("claim_key", "topic_label")
    return SC.score_requests(again, claim_requests(spark, sf_dir))[0].join(topics, "claim_key")


@register("scoring_metrics")
def q_scoring_metrics(spark, sf_dir):
    """X3 (batch): predictions, anomalies flagged, notes analysed."""
    return SC.scoring_metrics(q_score_claims(spark, sf_dir))


@register("score_claims_stream")
def q_score_stream(spark, sf_dir):
    """The same scoring over a file stream of arriving claims, those that V8 turns down left out."""
    return J.scored(spark, scored_stream(spark, sf_dir)).drop("timestamp", "processing_time_ms")


def scored_stream(spark, sf_dir):
    def build():
        path, schema = landed_claims(spark, sf_dir)
        return J.score_stream(spark, scorer(spark, sf_dir), path, schema)
    return MQ._memo(spark, sf_dir, "scored-stream", build)


def request_stream(spark, sf_dir):
    def build():
        requests = claim_requests(spark, sf_dir)
        path = J.land_files(requests, scratch_path(spark, "landing-requests"), files=8)
        return J.score_stream(spark, scorer(spark, sf_dir), path, requests.schema, requests=True)
    return MQ._memo(spark, sf_dir, "request-stream", build)


@register("score_requests_stream")
def q_score_requests_stream(spark, sf_dir):
    """Responses to a stream of requests, each with its time and the milliseconds it took."""
    return J.scored(spark, request_stream(spark, sf_dir))


@register("rejected_requests_stream", with_claims(CLAIM_REQUESTS, _CANON_SQL)
          + "SELECT claim_key, reasons AS reject_reasons FROM checked WHERE reasons <> ''")
def q_rejected_requests_stream(spark, sf_dir):
    """The requests that the stream turned down, with reasons."""
    return J.rejected(spark, request_stream(spark, sf_dir)).select("claim_key", F.array_join("reject_reasons", ",").alias("reject_reasons"))


@register("serving_counts", with_claims(CLAIM_REQUESTS, _CANON_SQL) + """
SELECT count(CASE WHEN reasons = '' THEN 1 END) AS predictions_total, count(CASE WHEN reasons <> '' THEN 1 END) AS rejected_total,
       count(CASE WHEN reasons = '' AND length(trim(clinical_note)) > 0 THEN 1 END) AS nlp_analyses_total
FROM checked""")
def q_serving_counts(spark, sf_dir):
    """Totals of the request stream, read from its commit records."""
    return J.serving_metrics(spark, request_stream(spark, sf_dir)).select("predictions_total", "rejected_total", "nlp_analyses_total")


@register("serving_metrics")
def q_serving_metrics(spark, sf_dir):
    """The same with anomalies and milliseconds (total and average per prediction)."""
    return J.serving_metrics(spark, request_stream(spark, sf_dir))


@register("scoring_metrics_stream")
def q_metrics_stream(spark, sf_dir):
    """X3 (stream): metrics per 30-day event-time window with a watermark."""
    path, schema = landed_claims(spark, sf_dir)
    return J.metrics_stream(spark, scorer(spark, sf_dir), path, schema)


@register("stream_dedupe", with_claims() + """
SELECT claim_key, 'CLM-' || upper(substr(sha256(concat_ws('|', CAST(age AS VARCHAR), sex, CAST(bmi AS VARCHAR),
       CAST(children AS VARCHAR), smoker, region, CAST(charges AS VARCHAR))), 1, 12)) AS claim_id, claim_ts
FROM claims""")
def q_stream_dedupe(spark, sf_dir):
    """Repeated claims dropped within the watermark delay."""
    path, schema = landed_claims(spark, sf_dir, with_copies=True)
    return J.dedupe_stream(spark, path, schema).select("claim_key", "claim_id", "claim_ts")


_KS_P = """CASE WHEN lam < CAST(0.001 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE least(greatest(list_sum(list_transform(range(1, 201),
           lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * lam * lam))), 0), 1) END"""


@register("stream_drift", with_claims(
    f"v AS (UNPIVOT (SELECT time_bucket(INTERVAL 365 DAYS, claim_ts, TIMESTAMP '1970-01-01') AS window_start, "
    f"{', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DRIFT_COLUMNS)} FROM claims) ON {', '.join(DRIFT_COLUMNS)} INTO NAME feature VALUE value)",
    "w AS (SELECT DISTINCT window_start AS ws FROM v)",
    "s AS (SELECT w.ws, feature, value, sum((window_start < ws)::BIGINT) AS r, sum((window_start = ws)::BIGINT) AS c "
    "FROM v JOIN w ON window_start <= ws GROUP BY ALL)",
    "cum AS (SELECT *, sum(r) OVER o AS cr, sum(c) OVER o AS cc, sum(r) OVER p AS tr, sum(c) OVER p AS tc FROM s "
    "WINDOW o AS (PARTITION BY ws, feature ORDER BY value), p AS (PARTITION BY ws, feature))",
    "d AS (SELECT ws, feature, max(abs(cr::DOUBLE / tr - cc::DOUBLE / tc)) AS ks, any_value(tr) AS n_ref, any_value(tc) AS n_cur, "
    "sum(value * r) / any_value(tr) AS m_ref, sum(value * c) / any_value(tc) AS m_cur FROM cum WHERE tr > 0 AND tc > 0 GROUP BY ws, feature)",
    "l AS (SELECT *, sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) * ks AS lam FROM d)") + f"""
SELECT CAST(ws AS VARCHAR) AS window_start, feature, round(ks, 6) AS ks_statistic, n_ref::BIGINT AS n_ref, n_cur::BIGINT AS n_cur,
       round(m_ref, 6) AS reference_mean, round(m_cur, 6) AS current_mean, round(100 * (m_cur - m_ref) / m_ref, 6) AS mean_shift_pct,
       round({_KS_P}, 6) AS p_value, {_KS_P} < CAST(0.05 AS DOUBLE) AS drift_detected
FROM l""")
def q_stream_drift(spark, sf_dir):
    """KS drift of each year of claims against all claims before it, from the stream's histograms."""
    path, schema = landed_claims(spark, sf_dir)
    d = J.drift_stream(spark, path, schema, DRIFT_COLUMNS)
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "feature",
                    *[F.round(c, 6).alias(c) for c in ("ks_statistic", "reference_mean", "current_mean", "mean_shift_pct", "p_value")],
                    F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"), "drift_detected")


@register("monitor_summary")
def q_monitor_summary(spark, sf_dir):
    """Requests, anomalies, rate, average ms per request (from the stream's
    commit records) and the drift message of the newest claims (claims of
    the last year vs all earlier ones)."""
    from halcyon.operators.stats import drift_report, feature_drift, monitor_summary
    sink = scored_stream(spark, sf_dir)
    log = J.scored(spark, sink).select(F.col("anomaly_detection.is_anomaly").alias("is_anomaly"))
    total_ms = J.serving_metrics(spark, sink).first()["total_processing_ms"]
    c = claims(spark, sf_dir)
    cut = c.agg(F.max("claim_ts")).first()[0]
    recent = F.col("claim_ts") > F.lit(cut).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")
    drift = drift_report(feature_drift(c.where(~recent), c.where(recent), DRIFT_COLUMNS))
    return monitor_summary(log, drift, total_ms)
