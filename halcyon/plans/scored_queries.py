"""Registered queries: what the model operators compute *from a given score*, checked by SQL.

A fitted model's values have no second engine to compare with, but everything behind its score has: the
same operators run here on scores that SQL can state too (a decision value from the charges, class shares
from the key, a cost from the risk score).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from halcyon.operators import analytics as A
from halcyon.operators import clusters as CL
from halcyon.operators import cost as CO
from halcyon.operators import isoforest as IF
from halcyon.operators import modeling as M
from halcyon.operators import notemodels as NM
from halcyon.operators import segments as S
from halcyon.operators import stats as T
from halcyon.plans.claims_queries import ENC_SQL, FEAT_SQL, MINMAX_SQL, TGT_SQL, THR_SQL, _features
from halcyon.plans.registry import register
from halcyon.plans.sqlviews import with_claims
from halcyon.plans.stats_queries import ALPHA, Z_SUM, _DRIFT_SQL, _SEG_SQL, _drift, _r, _tbl
from halcyon.plans.stream_queries import _KS_P, DRIFT_COLUMNS
from halcyon.sources.claims import claims

# ----------------------------------------------------------------------------- anomalies: decision = 0.35 - charges / 100,000

_DEC_SQL = "dec AS (SELECT claim_key, charges, 0.35::DOUBLE - charges / 100000::DOUBLE AS decision FROM claims)"


def _decided(spark, sf_dir):
    d = claims(spark, sf_dir).select("claim_key", "charges", (F.lit(0.35) - F.col("charges") / F.lit(100000.0)).alias("decision"))
    return d.withColumn("is_anomaly", F.col("decision") < 0)


@register("score_overview", with_claims(_DEC_SQL) + """
SELECT count(*) AS n, count(CASE WHEN decision < 0 THEN 1 END) AS n_flagged, round(avg(decision), 6) AS score_mean,
       round(stddev_pop(decision), 6) AS score_std, round(min(decision), 6) AS score_min, round(max(decision), 6) AS score_max,
       round(quantile_cont(decision, 0.05), 6) AS score_p5, round(quantile_cont(decision, 0.25), 6) AS score_q1,
       round(quantile_cont(decision, 0.5), 6) AS score_median, round(quantile_cont(decision, 0.75), 6) AS score_q3,
       round(quantile_cont(decision, 0.95), 6) AS score_p95, round(100.0 * count(CASE WHEN decision < 0 THEN 1 END) / count(*), 2) AS rate_pct
FROM dec""")
def q_score_overview(spark, sf_dir):
    """A8, A9 on the given decision values."""
    s = A.score_summary(_decided(spark, sf_dir), "decision", "is_anomaly")
    return s.select("n", "n_flagged", "rate_pct", *[_r(F.col(c)).alias(c) for c in s.columns if c.startswith("score_")])


@register("score_train_stats", with_claims(_DEC_SQL) + """
SELECT count(*) AS n, count(CASE WHEN decision < 0 THEN 1 END) AS n_anomalies,
       round(100.0 * count(CASE WHEN decision < 0 THEN 1 END) / count(*), 6) AS anomaly_rate_pct,
       round(avg(decision), 6) AS score_mean, round(stddev_pop(decision), 6) AS score_std FROM dec""")
def q_score_train_stats(spark, sf_dir):
    """A10 on the given decision values."""
    s = IF.train_statistics(_decided(spark, sf_dir))
    return s.select("n", "n_anomalies", *[_r(F.col(c)).alias(c) for c in ("anomaly_rate_pct", "score_mean", "score_std")])


@register("flag_reasons", with_claims(_DEC_SQL, "lim AS (SELECT quantile_cont(decision, 0.02) AS severe FROM dec)") + f"""
SELECT claim_key, CASE WHEN decision >= 0 THEN '{IF.REASON_NORMAL}' WHEN decision < severe THEN '{IF.REASON_SEVERE}'
       ELSE '{IF.REASON_UNUSUAL}' END AS flag_reason FROM dec, lim""")
def q_flag_reasons(spark, sf_dir):
    """M11 on the given decision values."""
    d = _decided(spark, sf_dir)
    return d.select("claim_key", IF.flag_reason(F.col("decision"), F.col("is_anomaly"), IF.severe_limit(d)).alias("flag_reason"))


@register("kpi_row_given", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL) + """
SELECT count(*) AS n_claims, round(100.0 * avg(CASE WHEN approved = 1 THEN 1 ELSE 0 END), 1) AS approval_rate_pct,
       round(avg(charges), 2) AS avg_cost,
       round(100.0 * avg(CASE WHEN 0.35::DOUBLE - charges / 100000::DOUBLE < 0 THEN 1 ELSE 0 END), 1) AS anomaly_rate_pct FROM tgt""")
def q_kpi_row_given(spark, sf_dir):
    """A19 with the anomaly share of the given decision values."""
    f = _features(spark, sf_dir).withColumn("is_anomaly", F.lit(0.35) - F.col("charges") / F.lit(100000.0) < 0)
    return A.kpi_row(f, anomaly="is_anomaly")


# ----------------------------------------------------------------------------- cost: 4,000 (1 + risk score)

@register("cost_evaluation", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL) + """
SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(charges) * count(*)), 6) AS r2, count(*) AS n
FROM (SELECT charges, charges - 4000 * (1 + risk_score) AS e FROM feat)""")
def q_cost_evaluation(spark, sf_dir):
    """M5 on a given prediction."""
    f = _features(spark, sf_dir, targets=False).withColumn("yhat", F.lit(4000) * (1 + F.col("risk_score")))
    m = T.regression_metrics(f, "charges", "yhat")
    return m.select(_r(F.col("mae"), 4).alias("mae"), _r(F.col("rmse"), 4).alias("rmse"), _r(F.col("r2")).alias("r2"), "n")


@register("cost_tiers", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL,
          "t AS (SELECT quantile_cont(charges, 0.25) AS a, quantile_cont(charges, 0.75) AS b, quantile_cont(charges, 0.9) AS c FROM claims)") + """
SELECT claim_key, CASE WHEN y <= a THEN 'low' WHEN y <= b THEN 'medium' WHEN y <= c THEN 'high' ELSE 'very_high' END AS cost_tier
FROM (SELECT claim_key, 4000 * (1 + risk_score) AS y FROM feat), t""")
def q_cost_tiers(spark, sf_dir):
    """M8 on a given prediction, with the training charges' quantiles."""
    f = _features(spark, sf_dir, targets=False)
    tiers = CO.cost_tier_thresholds(f)
    return f.select("claim_key", CO.cost_tier(F.lit(4000) * (1 + F.col("risk_score")), tiers).alias("cost_tier"))


# ----------------------------------------------------------------------------- segments

@register("segment_profiles", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL) + """
SELECT l.risk_label, d.n, d.pct, p.* EXCLUDE (cluster_id) FROM lab l JOIN prof p USING (cluster_id)
JOIN (SELECT cluster_id, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM seg GROUP BY cluster_id) d USING (cluster_id)""")
def q_segment_profiles(spark, sf_dir):
    """Counts, percentages and mean profile of each risk group."""
    return S.segment_distribution(S.fixed_segments(_features(spark, sf_dir, targets=False)))


@register("silhouette_given", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL,
          "s AS (SELECT claim_key, cluster_id, age::DOUBLE AS a, bmi::DOUBLE AS b FROM seg ORDER BY md5('42:' || claim_key::VARCHAR) LIMIT 500)",
          "d AS (SELECT x.claim_key AS i, x.cluster_id AS ci, y.cluster_id AS cj, sum(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS t, "
          "count(*) AS m FROM s x, s y GROUP BY ALL)",
          "o AS (SELECT i, max(CASE WHEN ci = cj THEN t / nullif(m - 1, 0) END) AS a, min(CASE WHEN ci <> cj THEN t / m END) AS b, "
          "max(CASE WHEN ci = cj THEN m END) AS own FROM d GROUP BY i)") + """
SELECT round(avg(CASE WHEN own = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM o""")
def q_silhouette_given(spark, sf_dir):
    """M14 on given segments."""
    seg = S.fixed_segments(_features(spark, sf_dir, targets=False))
    seg = VectorAssembler(inputCols=["age", "bmi"], outputCol="features").transform(seg.select("claim_key", "cluster_id", "age", "bmi"))
    return CL.silhouette(seg).select(_r(F.col("silhouette")).alias("silhouette"), "n")


# ----------------------------------------------------------------------------- splits

@register("stratified_holdout", with_claims("""
c AS (SELECT icd_code, count(*) AS n FROM claims GROUP BY icd_code),
t AS (SELECT icd_code, n, CASE WHEN n < 2 THEN 0 ELSE least(greatest(round(n * 0.2::DOUBLE), 1), n - 1) END::BIGINT AS k FROM c)""") + """
SELECT icd_code, 'test' AS split, k AS n FROM t WHERE k > 0 UNION ALL SELECT icd_code, 'train', n - k FROM t WHERE n > k""")
def q_stratified_holdout(spark, sf_dir):
    """M2: rows of every class on either side of the stratified split."""
    sides = zip(("train", "test"), M.stratified_split(claims(spark, sf_dir).select("claim_key", "icd_code"), "icd_code", ["claim_key"]))
    counts = [df.groupBy("icd_code").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.lit(side)) for side, df in sides]
    return counts[0].unionByName(counts[1])


# ----------------------------------------------------------------------------- notes

def _topic_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(s, '{w}')" for w in words) + f" THEN '{label}'" for label, words in NM.TOPIC_RULES)
    return f"CASE {cases} ELSE '{NM.DEFAULT_TOPIC}' END"


@register("topic_labels_given", with_claims() + f"""
SELECT claim_key, {_topic_sql()} AS topic_label FROM (SELECT claim_key, lower(clinical_note) AS s FROM claims)""")
def q_topic_labels(spark, sf_dir):
    """The label rules on the words of each note as the topic's terms."""
    return claims(spark, sf_dir).select("claim_key", NM.topic_label(F.split("clinical_note", " ")).alias("topic_label"))


_CODES = ["B54", "D50", "E11", "F41", "I10", "J44", "J45", "Z00"]


@register("icd_auc_given", with_claims(
    "p AS (SELECT icd_code, unnest([" + ", ".join(f"{{'cls': '{c}', 'p': ((claim_key * 7 + {i} * 13) % 101 + (CASE WHEN icd_code = '{c}' THEN 20 ELSE 0 END))::DOUBLE / 121}}"
                                                   for i, c in enumerate(_CODES)) + "]) AS u FROM claims)",
    "g AS (SELECT u.cls AS cls, u.p AS v, sum((icd_code = u.cls)::BIGINT) AS wp, sum((icd_code <> u.cls)::BIGINT) AS wn FROM p GROUP BY ALL)",
    "c AS (SELECT *, sum(wn) OVER (PARTITION BY cls ORDER BY v) - wn AS below FROM g)",
    "a AS (SELECT cls, sum(wp * (below + wn / 2.0::DOUBLE)) / (sum(wp)::DOUBLE * sum(wn)) AS auc, sum(wp) AS pos FROM c GROUP BY cls)") + """
SELECT round(sum(auc * pos) / sum(pos), 6) AS roc_auc_ovr_weighted FROM a WHERE pos > 0""")
def q_icd_auc_given(spark, sf_dir):
    """N14 on given class shares."""
    shares = F.array(*[(F.pmod(F.col("claim_key") * 7 + i * 13, F.lit(101)) + F.when(F.col("icd_code") == c, 20).otherwise(0)).cast("double") / 121
                       for i, c in enumerate(_CODES)])
    a = T.weighted_ovr_auc(claims(spark, sf_dir).withColumn("p", shares), "icd_code", _CODES, "p")
    return a.select(_r(F.col("roc_auc_ovr_weighted")).alias("roc_auc_ovr_weighted"))


# ----------------------------------------------------------------------------- p-values

@register("drift_report_p", f"SELECT * EXCLUDE (lam), round({_KS_P}, 6) AS p_value, {_KS_P} < {ALPHA}::DOUBLE AS drift_detected FROM ("
          + "SELECT q.*, sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) * ks_statistic AS lam FROM (" + _DRIFT_SQL + ") q)")
def q_drift_report_p(spark, sf_dir):
    """T6 with its p-value (the series evaluated by SQL too) and flag."""
    d = _drift(spark, sf_dir).withColumn("ks_statistic", _r(F.col("ks_statistic")))
    d = T.drift_report(d, ALPHA)
    return d.select("feature", "ks_statistic", F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"),
                    *[_r(F.col(c)).alias(c) for c in ("reference_mean", "current_mean", "mean_shift_pct", "p_value")], "drift_detected")


#: P(|T| >= |t|) as 2 C times the integral of cos(u)^(v-1) from atan(|t| / sqrt(v)), by Simpson's rule
_T_P = """2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * list_sum(list_transform(range(0, 8001), lambda i:
       (CASE WHEN i = 0 OR i = 8000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(u0 + i * h), 0), dof - 1))) * h / 3"""


@register("ab_significance", f"""
WITH arms AS (
  SELECT l_linestatus || l_linenumber::VARCHAR AS experiment,
         count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n_c, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_t,
         avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS m_c, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS m_t,
         var_samp(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS v_c, var_samp(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS v_t
  FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY ALL
), t AS (
  SELECT *, (n_c + n_t - 2)::DOUBLE AS dof,
         (m_c - m_t) / sqrt(((n_c - 1) * v_c + (n_t - 1) * v_t) / (n_c + n_t - 2) * (1.0::DOUBLE / n_c + 1.0::DOUBLE / n_t)) AS t,
         (m_t - m_c) / sqrt((v_c + v_t) / 2) AS es FROM arms
), u AS (
  SELECT *, atan(abs(t) / sqrt(dof)) AS u0, least(pi() / 2 - atan(abs(t) / sqrt(dof)), 14 / sqrt(dof)) / 8000 AS h FROM t
), p AS (SELECT *, {_T_P} AS p FROM u)
SELECT experiment, round(t, 6) AS t_stat, round(p, 6) AS p_value, p < {ALPHA}::DOUBLE AS is_significant,
       CASE WHEN p < {ALPHA}::DOUBLE AND m_t > m_c THEN 'R' ELSE 'N' END AS winner,
       CAST(ceil(pow({Z_SUM!r} / es, 2)) AS BIGINT) AS min_sample_size FROM p""")
def q_ab_significance(spark, sf_dir):
    """P-value (its integral evaluated by SQL too), significance and winner of an experiment per line number."""
    li = _tbl(spark, sf_dir, "lineitem", F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("experiment"), "l_returnflag", "l_quantity")
    d = T.ab_decision(T.ab_test(li, "l_returnflag", "l_quantity", "N", "R", experiment="experiment"), ALPHA)
    return d.select("experiment", _r(F.col("t_stat")).alias("t_stat"), _r(F.col("p_value")).alias("p_value"), "is_significant", "winner", "min_sample_size")


# ----------------------------------------------------------------------------- monitoring

@register("monitor_summary_given", with_claims(_DEC_SQL,
          "cut AS (SELECT max(claim_ts) - INTERVAL 365 DAYS AS c FROM claims)",
          "v AS (UNPIVOT (SELECT claim_ts > c AS recent, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in DRIFT_COLUMNS)
          + " FROM claims, cut) ON " + ", ".join(DRIFT_COLUMNS) + " INTO NAME feature VALUE value)",
          "s AS (SELECT feature, value, sum((NOT recent)::BIGINT) AS r, sum(recent::BIGINT) AS c FROM v GROUP BY ALL)",
          "cum AS (SELECT *, sum(r) OVER o AS cr, sum(c) OVER o AS cc, sum(r) OVER p AS tr, sum(c) OVER p AS tc FROM s "
          "WINDOW o AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature))",
          "ks AS (SELECT feature, sqrt(any_value(tr)::DOUBLE * any_value(tc) / (any_value(tr) + any_value(tc))) "
          "* max(abs(cr::DOUBLE / tr - cc::DOUBLE / tc)) AS lam FROM cum GROUP BY feature)",
          f"names AS (SELECT string_agg(feature, ', ' ORDER BY feature) AS d FROM ks WHERE {_KS_P} < 0.05::DOUBLE)") + """
SELECT count(*) AS request_count, count(CASE WHEN decision < 0 THEN 1 END) AS anomaly_count,
       round(100.0::DOUBLE * count(CASE WHEN decision < 0 THEN 1 END) / count(*), 2) AS anomaly_rate,
       round(12345.5::DOUBLE / count(*), 2) AS avg_processing_ms,
       any_value(CASE WHEN d IS NULL THEN 'No drift detected.' ELSE 'Data drift detected in features: ' || d END) AS drift_status
FROM dec, names""")
def q_monitor_summary_given(spark, sf_dir):
    """T8 on the given decision values, 12,345.5 ms of processing and the drift of the last year's claims."""
    c = claims(spark, sf_dir)
    cut = c.agg(F.max("claim_ts")).first()[0]
    recent = F.col("claim_ts") > F.lit(cut).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")
    drift = T.drift_report(T.feature_drift(c.where(~recent), c.where(recent), DRIFT_COLUMNS))
    return T.monitor_summary(_decided(spark, sf_dir), drift, 12345.5)
