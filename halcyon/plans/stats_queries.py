"""Registered queries: statistics, ranks, corpus TF-IDF and fixed-centroid segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from halcyon.functions import notes as N
from halcyon.operators import analytics as A
from halcyon.operators import ranks as K
from halcyon.operators import segments as S
from halcyon.operators import stats as T
from halcyon.operators import text as X
from halcyon.plans.claims_queries import ENC_SQL, FEAT_SQL, MINMAX_SQL, THR_SQL, TGT_SQL, _features
from halcyon.plans.note_queries import terms_sql
from halcyon.plans.registry import register
from halcyon.plans.sqlviews import with_claims
from halcyon.sources.claims import claims

SPLIT_TS = "1998-01-01"          # training claims are older than this
DRIFT_TS = "2024-01-16"          # events: reference half / current half
ALPHA, POWER = 0.05, 0.80
Z_SUM = T.z_quantile(1 - ALPHA / 2) + T.z_quantile(POWER)


def _r(c, d=6):
    return F.round(c, d)


def _tbl(spark, sf_dir, name, *cols):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


# ----------------------------------------------------------------------------- A/B

@register("ab_test", f"""
WITH arms AS (
  SELECT l_linestatus AS experiment,
         count(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n_c,
         count(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS n_t,
         avg(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DOUBLE) END) AS mean_c,
         avg(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DOUBLE) END) AS mean_t,
         var_samp(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DOUBLE) END) AS var_c,
         var_samp(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DOUBLE) END) AS var_t
  FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY l_linestatus
), d AS (
  SELECT *, CAST(n_c + n_t - 2 AS DOUBLE) AS dof,
         ((n_c - 1) * var_c + (n_t - 1) * var_t) / CAST(n_c + n_t - 2 AS DOUBLE) AS sp2,
         CASE WHEN sqrt((var_c + var_t) / 2) > 0 THEN (mean_t - mean_c) / sqrt((var_c + var_t) / 2) ELSE 0.0 END AS es
  FROM arms
)
SELECT experiment, 'N' AS control_name, 'R' AS treatment_name, 'l_quantity' AS metric, n_c, n_t,
       round(mean_c, 6) AS control_mean, round(mean_t, 6) AS treatment_mean,
       round((mean_c - mean_t) / sqrt(sp2 * (1.0 / n_c + 1.0 / n_t)), 6) AS t_stat, dof,
       round(es, 6) AS effect_size,
       CAST(CASE WHEN es = 0 THEN 0 ELSE ceil(pow({Z_SUM!r} / es, 2)) END AS BIGINT) AS min_sample_size
FROM d""")
def q_ab_test(spark, sf_dir):
    li = _tbl(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_quantity")
    t = T.ab_test(li, "l_returnflag", "l_quantity", "N", "R", experiment="l_linestatus")
    return t.select(F.col("l_linestatus").alias("experiment"), "control_name", "treatment_name", "metric",
                    "n_c", "n_t", _r(F.col("control_mean")).alias("control_mean"),
                    _r(F.col("treatment_mean")).alias("treatment_mean"), _r(F.col("t_stat")).alias("t_stat"), "dof",
                    _r(F.col("effect_size")).alias("effect_size"),
                    T.min_sample_size(F.col("effect_size"), ALPHA, POWER).alias("min_sample_size"))


@register("ab_decision")
def q_ab_decision(spark, sf_dir):
    """T1/T3 with the Student-t p-value (Arrow UDF on one row per experiment)."""
    li = _tbl(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_quantity")
    t = T.ab_test(li, "l_returnflag", "l_quantity", "N", "R", experiment="l_linestatus")
    return T.ab_decision(t, ALPHA)


# ----------------------------------------------------------------------------- drift

_NUM = ["age", "bmi", "children", "charges"]


@register("reference_stats", with_claims() + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
        round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max, count({c}) AS n FROM claims""" for c in _NUM))
def q_reference_stats(spark, sf_dir):
    r = T.reference_stats(claims(spark, sf_dir), _NUM)
    return r.select("feature", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"), "min", "max", "n")


_DRIFT_SQL = f"""
WITH u AS (
  SELECT 'value' AS feature, CAST(value AS DOUBLE) AS v,
         CASE WHEN ts < TIMESTAMP '{DRIFT_TS}' THEN 1 ELSE 0 END AS r FROM events
  UNION ALL
  SELECT 'user_id', CAST(user_id AS DOUBLE), CASE WHEN ts < TIMESTAMP '{DRIFT_TS}' THEN 1 ELSE 0 END FROM events
), c AS (
  SELECT feature, v, sum(r) AS nr, sum(1 - r) AS nc FROM u WHERE v IS NOT NULL GROUP BY feature, v
), cum AS (
  SELECT feature, v, sum(nr) OVER (PARTITION BY feature ORDER BY v) AS cr,
         sum(nc) OVER (PARTITION BY feature ORDER BY v) AS cc,
         sum(nr) OVER (PARTITION BY feature) AS tr, sum(nc) OVER (PARTITION BY feature) AS tc
  FROM c
), d AS (
  SELECT feature, max(abs(cr / tr - cc / tc)) AS ks, CAST(max(tr) AS BIGINT) AS n_ref, CAST(max(tc) AS BIGINT) AS n_cur
  FROM cum GROUP BY feature
), m AS (
  SELECT feature, sum(v * r) / sum(r) AS rm, sum(v * (1 - r)) / sum(1 - r) AS cm FROM u GROUP BY feature
)
SELECT d.feature, round(d.ks, 6) AS ks_statistic, d.n_ref, d.n_cur, round(m.rm, 6) AS reference_mean,
       round(m.cm, 6) AS current_mean,
       round(CASE WHEN m.rm <> 0 THEN 100.0 * (m.cm - m.rm) / m.rm ELSE 0.0 END, 6) AS mean_shift_pct
FROM d JOIN m ON d.feature = m.feature"""


def _drift(spark, sf_dir):
    ev = _tbl(spark, sf_dir, "events", "ts", "value", "user_id")
    ref = ev.where(F.col("ts") < F.lit(DRIFT_TS).cast("timestamp_ntz"))
    cur = ev.where(F.col("ts") >= F.lit(DRIFT_TS).cast("timestamp_ntz"))
    return T.feature_drift(ref, cur, ["value", "user_id"])


@register("feature_drift", _DRIFT_SQL)
def q_feature_drift(spark, sf_dir):
    d = _drift(spark, sf_dir)
    return d.select("feature", _r(F.col("ks_statistic")).alias("ks_statistic"),
                    F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"),
                    _r(F.col("reference_mean")).alias("reference_mean"),
                    _r(F.col("current_mean")).alias("current_mean"),
                    _r(F.col("mean_shift_pct")).alias("mean_shift_pct"))


@register("drift_report")
def q_drift_report(spark, sf_dir):
    """T6 with the asymptotic KS p-value and the drift flag."""
    return T.drift_report(_drift(spark, sf_dir), ALPHA)


# ----------------------------------------------------------------------------- ranks

_RANK_SQL = with_claims(
    f"ref AS (SELECT charges FROM claims WHERE claim_ts < TIMESTAMP '{SPLIT_TS}')",
    f"s AS (SELECT claim_key, charges FROM claims WHERE claim_ts >= TIMESTAMP '{SPLIT_TS}')",
    "u AS (SELECT charges AS v, 1 AS r FROM ref UNION ALL SELECT charges, 0 FROM s)",
    "c AS (SELECT v, sum(r) AS nr FROM u GROUP BY v)",
    "cum AS (SELECT v, sum(nr) OVER (ORDER BY v) AS cr, sum(nr) OVER () AS tr FROM c)") + """
SELECT s.claim_key, round(CAST(100 AS DOUBLE) * cum.cr / cum.tr, 1) AS percentile_rank
FROM s JOIN cum ON s.charges = cum.v"""


@register("percentile_rank", _RANK_SQL)
def q_percentile_rank(spark, sf_dir):
    c = claims(spark, sf_dir).select("claim_key", "charges", "claim_ts")
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    ref, new = c.where(F.col("claim_ts") < split), c.where(F.col("claim_ts") >= split)
    return K.percentile_rank(ref, new, "charges").select("claim_key", "percentile_rank")


@register("rank_lookup", _RANK_SQL)
def q_rank_lookup(spark, sf_dir):
    """W1 of values that the reference has not seen, looked up in its at most 1,001 rank levels (as the scorer does in a stream)."""
    c = claims(spark, sf_dir).select("claim_key", "charges", "claim_ts")
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    levels = K.rank_levels(c.where(F.col("claim_ts") < split), "charges")
    return c.where(F.col("claim_ts") >= split).select("claim_key", K.rank_of(F.col("charges"), levels).alias("percentile_rank"))


@register("recent_predictions", """
SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def q_recent(spark, sf_dir):
    """The latest 1,000 log rows (a top-k: each partition keeps its own
    1,000 before the final merge)."""
    ev = _tbl(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    return ev.orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)


# ----------------------------------------------------------------------------- approval evaluation on a given score
# The score is the fixed baseline p = 1 / (1 + risk_score); the operators are
# the same ones that evaluate the random-forest probabilities.

_P_SQL = "sc AS (SELECT claim_key, approved, 1.0 / (1.0 + risk_score) AS p FROM tgt)"


def _scored(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("claim_key", "approved", (F.lit(1.0) / (F.lit(1.0) + F.col("risk_score"))).alias("p"))


@register("approval_auc", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL, _P_SQL,
                                      "c AS (SELECT p, sum(approved) AS np, sum(1 - approved) AS nn FROM sc GROUP BY p)",
                                      """cum AS (SELECT p, np, nn, sum(nn) OVER (ORDER BY p) AS cn,
                                                sum(np) OVER () AS tp, sum(nn) OVER () AS tn FROM c)""") + """
SELECT round(sum(CAST(np AS DOUBLE) * (CAST(cn - nn AS DOUBLE) + CAST(nn AS DOUBLE) / 2.0)) / (CAST(max(tp) AS DOUBLE) * CAST(max(tn) AS DOUBLE)), 6) AS roc_auc,
       CAST(max(tp) AS BIGINT) AS n_pos, CAST(max(tn) AS BIGINT) AS n_neg FROM cum""")
def q_approval_auc(spark, sf_dir):
    a = T.auc(_scored(spark, sf_dir), "approved", "p")
    return a.select(_r(F.col("roc_auc")).alias("roc_auc"), F.col("n_pos").cast("long").alias("n_pos"),
                    F.col("n_neg").cast("long").alias("n_neg"))


@register("approval_metrics", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL, _P_SQL,
                                          "pr AS (SELECT approved, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc)",
                                          """a AS (SELECT count(*) AS n,
                                                sum(CASE WHEN approved = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
                                                sum(CASE WHEN approved = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
                                                sum(CASE WHEN approved = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn,
                                                sum(CASE WHEN approved = pred THEN 1 ELSE 0 END) AS hits FROM pr)""",
                                          """b AS (SELECT n, CAST(hits AS DOUBLE) / n AS accuracy,
                                                CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS prec,
                                                CASE WHEN tp + fp > 0 THEN 0 END AS z,
                                                CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS rec,
                                                CAST(tp + fp AS DOUBLE) / n AS rate FROM a)""") + """
SELECT n, round(accuracy, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
       round(rate, 6) AS approval_rate,
       round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1
FROM b""")
def q_approval_metrics(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    m = T.binary_metrics(s, "approved", "pred")
    return m.select("n", *[_r(F.col(c)).alias(c) for c in ["accuracy", "precision", "recall", "approval_rate", "f1"]])


@register("roc_points", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL, _P_SQL,
                                    "c AS (SELECT p, sum(approved) AS np, sum(1 - approved) AS nn FROM sc GROUP BY p)",
                                    """cum AS (SELECT p, np, nn, sum(np) OVER (ORDER BY p) AS cp, sum(nn) OVER (ORDER BY p) AS cn,
                                              sum(np) OVER () AS tp, sum(nn) OVER () AS tn FROM c)""") + """
SELECT round(p, 6) AS threshold, round((tn - (cn - nn)) / tn, 6) AS fpr, round((tp - (cp - np)) / tp, 6) AS tpr
FROM cum""")
def q_roc_points(spark, sf_dir):
    r = T.roc_points(_scored(spark, sf_dir), "approved", "p")
    return r.select(*[_r(F.col(c)).alias(c) for c in ["threshold", "fpr", "tpr"]])


@register("confusion_matrix", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL, _P_SQL) + """
SELECT approved AS actual, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM sc GROUP BY 1, 2""")
def q_confusion(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return T.confusion(s, "approved", "pred")


# ----------------------------------------------------------------------------- ICD evaluation on a given prediction
# The prediction looks the note's extracted conditions (N4) up in the ICD
# dimension (P19), in dimension order, defaulting to Z00.

def _dim_condition_codes():
    conds = {c.lower() for c in N.CONDITIONS}
    return [(key, code) for key, code, _ in A.ICD_DIMENSION if key in conds]


def _icd_pred_col():
    found = F.transform(N.conditions("clinical_note"), lambda t: F.lower(t))
    expr = None
    for key, code in _dim_condition_codes():
        cond = F.array_contains(found, key)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr.otherwise(F.lit("Z00"))


def _icd_pred_sql():
    conds = terms_sql("clinical_note", N.CONDITIONS, N.CONDITION_SYNONYMS).replace(", '|')", ", '|')")
    case = " ".join(f"WHEN list_contains(str_split(lower(conds), '|'), '{k}') THEN '{c}'"
                    for k, c in _dim_condition_codes())
    return (f"pc AS (SELECT claim_key, icd_code, {conds} AS conds FROM claims)",
            f"pred AS (SELECT claim_key, icd_code, CASE {case} ELSE 'Z00' END AS predicted FROM pc)")


_CLS_SQL = """
cm AS (SELECT icd_code AS actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2),
sup AS (SELECT actual AS cls, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
        FROM cm GROUP BY actual),
np AS (SELECT predicted AS cls, sum(n) AS n_pred FROM cm GROUP BY predicted),
r AS (SELECT coalesce(sup.cls, np.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(n_pred, 0) AS n_pred FROM sup FULL OUTER JOIN np ON sup.cls = np.cls),
r2 AS (SELECT *, CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall FROM r),
r3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
              AS f1 FROM r2)"""


def _icd_report(spark, sf_dir):
    c = claims(spark, sf_dir).select("claim_key", "icd_code", _icd_pred_col().alias("predicted"))
    return T.class_report(c, "icd_code", "predicted")


@register("icd_class_report", with_claims(*_icd_pred_sql(), _CLS_SQL) + """
SELECT cls, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(n_pred AS BIGINT) AS n_pred,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r3""")
def q_icd_class_report(spark, sf_dir):
    r = _icd_report(spark, sf_dir)
    return r.select("cls", F.col("support").cast("long").alias("support"), F.col("tp").cast("long").alias("tp"),
                    F.col("n_pred").cast("long").alias("n_pred"),
                    *[_r(F.col(c)).alias(c) for c in ["precision", "recall", "f1"]])


@register("icd_evaluation", with_claims(*_icd_pred_sql(), _CLS_SQL) + """
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted, CAST(sum(support) AS BIGINT) AS n FROM r3""")
def q_icd_evaluation(spark, sf_dir):
    s = T.class_summary(_icd_report(spark, sf_dir))
    return s.select(*[_r(F.col(c)).alias(c) for c in ["accuracy", "f1_macro", "f1_weighted"]],
                    F.col("n").cast("long").alias("n"))


# ----------------------------------------------------------------------------- corpus TF-IDF on documents

def _stop_sql():
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.english_stop_words()) + "]"


def _tfidf_sql(max_terms=5000):
    return f"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0),
                             lambda w: NOT list_contains({_stop_sql()}, w)) AS t
  FROM documents
), grams AS (
  SELECT doc_id, unnest(list_concat(t, CASE WHEN len(t) >= 2
           THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term
  FROM tok
), per_doc AS (
  SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term
), corpus AS (
  SELECT term, sum(tf) AS total, count(*) AS dfreq FROM per_doc GROUP BY term
), vocab AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + dfreq)) + 1.0 AS idf
  FROM corpus ORDER BY total DESC, term LIMIT {max_terms}
), w AS (
  SELECT p.doc_id, p.term, p.tf, p.tf * v.idf AS w FROM per_doc p JOIN vocab v ON p.term = v.term
), weights AS (
  SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w
)"""


def _tfidf(spark, sf_dir, max_terms=5000):
    docs = _tbl(spark, sf_dir, "documents", "doc_id", "text")
    return X.fit_transform_tfidf(docs, "doc_id", "text", max_terms=max_terms)[1]


@register("tfidf", _tfidf_sql() + "SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, round(weight, 6) AS weight FROM weights")
def q_tfidf(spark, sf_dir):
    w = _tfidf(spark, sf_dir)
    return w.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), _r(F.col("weight")).alias("weight"))


@register("keywords", _tfidf_sql() + """
, ranked AS (
  SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rn
  FROM weights WHERE weight > 0
)
SELECT doc_id, string_agg(term, '|' ORDER BY rn) AS keywords FROM ranked WHERE rn <= 10 GROUP BY doc_id""")
def q_keywords(spark, sf_dir):
    k = X.keywords(_tfidf(spark, sf_dir), "doc_id", 10)
    return k.select("doc_id", F.array_join("keywords", "|").alias("keywords"))


# ----------------------------------------------------------------------------- segments by fixed centroids

_SEG_SQL = S.fixed_segments_sql()


@register("cluster_sizes", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL)
          + "SELECT cluster_id, count(*) AS n FROM seg GROUP BY cluster_id")
def q_cluster_sizes(spark, sf_dir):
    return A.share_by(S.fixed_segments(_features(spark, sf_dir, targets=False)), "cluster_id").drop("pct")


@register("cluster_profiles", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL) + "SELECT * FROM prof")
def q_cluster_profiles(spark, sf_dir):
    return S.profiles(S.fixed_segments(_features(spark, sf_dir, targets=False)))


@register("segment_labels", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL) + "SELECT * FROM lab")
def q_segment_labels(spark, sf_dir):
    return S.labels(S.profiles(S.fixed_segments(_features(spark, sf_dir, targets=False))))


@register("segment_distribution", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL) + """
SELECT l.risk_label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
FROM seg s JOIN lab l ON s.cluster_id = l.cluster_id GROUP BY l.risk_label""")
def q_segment_distribution(spark, sf_dir):
    seg = S.assign_labels(S.fixed_segments(_features(spark, sf_dir, targets=False)))
    return A.share_by(seg, "risk_label")


@register("risk_segment_counts", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL) + """
, dim AS (SELECT * FROM (VALUES (0, 'Low Risk'), (1, 'Moderate Risk'), (2, 'High Risk'), (3, 'Critical Risk'))
          AS t(position, risk_label)),
cnt AS (SELECT l.risk_label, count(*) AS n FROM seg s JOIN lab l ON s.cluster_id = l.cluster_id GROUP BY 1)
SELECT dim.position, dim.risk_label, coalesce(cnt.n, 0) AS n FROM dim LEFT JOIN cnt ON dim.risk_label = cnt.risk_label"""
          .replace("\n, dim AS", ",\ndim AS", 1))
def q_risk_segment_counts(spark, sf_dir):
    seg = S.assign_labels(S.fixed_segments(_features(spark, sf_dir, targets=False)))
    return A.ordered_counts(seg, "risk_label")


@register("profile_heatmap", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL) + """
SELECT cluster_id, mean_age, mean_bmi, mean_charges,
       CASE WHEN max(mean_age) OVER () > min(mean_age) OVER ()
            THEN round((mean_age - min(mean_age) OVER ()) / (max(mean_age) OVER () - min(mean_age) OVER ()), 6)
            ELSE 0.5 END AS mean_age_scaled,
       CASE WHEN max(mean_bmi) OVER () > min(mean_bmi) OVER ()
            THEN round((mean_bmi - min(mean_bmi) OVER ()) / (max(mean_bmi) OVER () - min(mean_bmi) OVER ()), 6)
            ELSE 0.5 END AS mean_bmi_scaled,
       CASE WHEN max(mean_charges) OVER () > min(mean_charges) OVER ()
            THEN round((mean_charges - min(mean_charges) OVER ())
                       / (max(mean_charges) OVER () - min(mean_charges) OVER ()), 6)
            ELSE 0.5 END AS mean_charges_scaled
FROM prof""")
def q_profile_heatmap(spark, sf_dir):
    prof = S.profiles(S.fixed_segments(_features(spark, sf_dir, targets=False)))
    cols = ["mean_age", "mean_bmi", "mean_charges"]
    h = A.column_minmax_scale(prof.select("cluster_id", *cols), cols)
    return h.select("cluster_id", *cols, *[_r(F.col(f"{c}_scaled")).alias(f"{c}_scaled") for c in cols])


@register("assign_segment", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, *_SEG_SQL) + """
, sz AS (SELECT cluster_id, count(*) AS n FROM seg GROUP BY cluster_id)
SELECT s.claim_key, s.cluster_id, l.risk_label, round(CAST(l.charge_rank AS DOUBLE) / CAST(3 AS DOUBLE) * CAST(10 AS DOUBLE), 1) AS segment_risk_score,
       sz.n AS similar_members_count
FROM seg s JOIN lab l ON s.cluster_id = l.cluster_id JOIN sz ON s.cluster_id = sz.cluster_id"""
          .replace("\n, sz AS", ",\nsz AS", 1))
def q_assign_segment(spark, sf_dir):
    seg = S.fixed_segments(_features(spark, sf_dir, targets=False))
    return S.assign_segment(seg).select("claim_key", "cluster_id", "risk_label", "segment_risk_score",
                                        "similar_members_count")
