"""Registered queries: ingest, features and population analytics on claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from halcyon.functions import encode as E
from halcyon.operators import analytics as A
from halcyon.operators import features as P
from halcyon.operators import ingest as V
from halcyon.plans.registry import register
from halcyon.plans.sqlviews import CLAIM_REQUESTS, with_claims
from halcyon.sources.claims import RAW_COLUMNS, claim_requests, claims

R6 = 6  # decimals for derived doubles in query outputs


def _r(c, d=R6):
    return F.round(c, d)


# ----------------------------------------------------------------------------- shared SQL
ENC_SQL = """
enc AS (
  SELECT claim_key, age, bmi, children, charges, region AS region_name, sex AS sex_name,
         smoker AS smoker_name, clinical_note, icd_code,
         CASE WHEN lower(regexp_replace(smoker, '^[[:space:]]+|[[:space:]]+$', '', 'g')) IN ('yes','true','1') THEN 1 ELSE 0 END AS smoker,
         CASE WHEN lower(regexp_replace(sex, '^[[:space:]]+|[[:space:]]+$', '', 'g')) IN ('male','true','1') THEN 1 ELSE 0 END AS sex,
         CASE lower(regexp_replace(region, '^[[:space:]]+|[[:space:]]+$', '', 'g')) WHEN 'northeast' THEN 0 WHEN 'northwest' THEN 1
              WHEN 'southeast' THEN 2 WHEN 'southwest' THEN 3 ELSE 0 END AS region,
         CASE WHEN age > 0 AND age <= 25 THEN 'youth' WHEN age > 25 AND age <= 35 THEN 'young_adult'
              WHEN age > 35 AND age <= 45 THEN 'adult' WHEN age > 45 AND age <= 55 THEN 'middle_aged'
              WHEN age > 55 AND age <= 100 THEN 'senior' END AS age_group,
         CASE WHEN bmi > 0 AND bmi <= 18.5 THEN 'underweight' WHEN bmi > 18.5 AND bmi <= 25 THEN 'normal'
              WHEN bmi > 25 AND bmi <= 30 THEN 'overweight' WHEN bmi > 30 AND bmi <= 100 THEN 'obese'
              END AS bmi_category
  FROM claims
)"""

MINMAX_SQL = """
mm AS (
  SELECT CAST(min(age) AS DOUBLE) AS age_min, CAST(max(age) AS DOUBLE) AS age_max,
         CAST(min(bmi) AS DOUBLE) AS bmi_min, CAST(max(bmi) AS DOUBLE) AS bmi_max,
         CAST(min(children) AS DOUBLE) AS children_min, CAST(max(children) AS DOUBLE) AS children_max
  FROM enc
)"""

FEAT_SQL = """
feat AS (
  SELECT e.*,
         e.smoker * 3
           + (e.bmi - mm.bmi_min) / (CASE WHEN mm.bmi_max <> mm.bmi_min THEN mm.bmi_max - mm.bmi_min ELSE 1.0 END) * 2
           + (e.age - mm.age_min) / (CASE WHEN mm.age_max <> mm.age_min THEN mm.age_max - mm.age_min ELSE 1.0 END) * 1.5
           + (e.children - mm.children_min)
             / (CASE WHEN mm.children_max <> mm.children_min THEN mm.children_max - mm.children_min ELSE 1.0 END) * 0.5
           AS risk_score,
         e.age * e.smoker AS age_smoker, e.bmi * e.smoker AS bmi_smoker, e.age * e.bmi AS age_bmi,
         ln(1 + e.charges) AS log_charges
  FROM enc e, mm
)"""

THR_SQL = """
thr AS (
  SELECT quantile_cont(charges, 0.75) AS high_cost, quantile_cont(charges, 0.9) AS approve FROM claims
)"""

TGT_SQL = """
tgt AS (
  SELECT f.*, CASE WHEN f.charges > thr.high_cost THEN 1 ELSE 0 END AS high_cost_flag,
         CASE WHEN f.charges < thr.approve AND f.bmi < 45 AND NOT (f.smoker = 1 AND f.age > 60)
              THEN 1 ELSE 0 END AS approved
  FROM feat f, thr
)"""


def _features(spark, sf_dir, targets=True):
    c = claims(spark, sf_dir)
    enc = P.encode(c)
    mm = P.fit_minmax(enc).first().asDict()
    out = P.with_interactions(P.with_risk_score(enc, mm))
    if targets:
        out = P.with_targets(out, P.target_thresholds(c))
    return out


# ----------------------------------------------------------------------------- ingest

@register("scan_claims", with_claims() + "SELECT " + ", ".join(RAW_COLUMNS) + " FROM claims")
def q_scan_claims(spark, sf_dir):
    """Write the raw claim columns as CSV to the shared folder and
    read them back with the explicit schema (no inference)."""
    from halcyon.sources.files import read_claims_csv, write_csv
    from halcyon.session import scratch_path
    path = scratch_path(spark, "claims-csv")
    write_csv(claims(spark, sf_dir).select(*RAW_COLUMNS), path)
    return read_claims_csv(spark, path)


_empty_cols = ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c}' END" for c in
                        ["claim_key", "age", "sex", "bmi", "children", "smoker", "region", "charges",
                         "claim_ts", "clinical_note", "icd_code"])


@register("validation_report", with_claims() + f"""
SELECT count(*) AS n_rows, '' AS missing_columns, '' AS non_numeric_columns,
       concat_ws(',', {_empty_cols}) AS empty_columns,
       count(*) < 100 AS too_few_rows,
       (concat_ws(',', {_empty_cols}) = '' AND count(*) >= 100) AS is_valid
FROM claims""")
def q_validation_report(spark, sf_dir):
    return V.validation_report(claims(spark, sf_dir))


@register("normalize_strings", with_claims(CLAIM_REQUESTS) + """
SELECT claim_key, age, lower(regexp_replace(gender, '^[[:space:]]+|[[:space:]]+$', '', 'g')) AS gender, bmi, children, smoker,
       lower(regexp_replace(region, '^[[:space:]]+|[[:space:]]+$', '', 'g')) AS region, lower(regexp_replace(clinical_note, '^[[:space:]]+|[[:space:]]+$', '', 'g')) AS clinical_note
FROM claim_requests""")
def q_normalize_strings(spark, sf_dir):
    return V.normalize_strings(claim_requests(spark, sf_dir))


_DUP_SQL = "SELECT * FROM claims UNION ALL SELECT * FROM claims WHERE claim_key % 10 = 0"


def _with_copies(spark, sf_dir):
    c = claims(spark, sf_dir)
    return c.unionByName(c.where(F.col("claim_key") % 10 == 0))


@register("dedupe_claims", with_claims() + f"SELECT DISTINCT * FROM ({_DUP_SQL}) t")
def q_dedupe_claims(spark, sf_dir):
    return V.dedupe_claims(_with_copies(spark, sf_dir))


@register("dedupe_report", with_claims() + f"""
SELECT (SELECT count(*) FROM ({_DUP_SQL}) a) AS n_before,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DUP_SQL}) b) c) AS n_after,
       (SELECT count(*) FROM ({_DUP_SQL}) a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DUP_SQL}) b) c)
         AS n_removed""")
def q_dedupe_report(spark, sf_dir):
    before = _with_copies(spark, sf_dir)
    return V.dedupe_report(before, V.dedupe_claims(before))


@register("claim_id", with_claims() + """
SELECT claim_key, 'CLM-' || upper(substr(sha256(concat_ws('|', CAST(age AS VARCHAR), sex, CAST(bmi AS VARCHAR),
       CAST(children AS VARCHAR), smoker, region, CAST(charges AS VARCHAR))), 1, 12)) AS claim_id
FROM claims""")
def q_claim_id(spark, sf_dir):
    return V.with_claim_id(claims(spark, sf_dir), RAW_COLUMNS).select("claim_key", "claim_id")


_CANON_SQL = """
canon AS (
  SELECT claim_key, age, bmi, children, smoker, clinical_note,
         CASE lower(regexp_replace(gender, '^[[:space:]]+|[[:space:]]+$', '', 'g')) WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female' ELSE gender END AS gender,
         CASE lower(regexp_replace(region, '^[[:space:]]+|[[:space:]]+$', '', 'g')) WHEN 'northeast' THEN 'Northeast' WHEN 'northwest' THEN 'Northwest'
              WHEN 'southeast' THEN 'Southeast' WHEN 'southwest' THEN 'Southwest' ELSE region END AS region
  FROM claim_requests
),
checked AS (
  SELECT *, concat_ws(',',
      CASE WHEN age IS NULL THEN 'age_missing' END,
      CASE WHEN age <= 0 OR age >= 120 THEN 'age_out_of_range' END,
      CASE WHEN gender IS NULL THEN 'gender_missing' END,
      CASE WHEN gender NOT IN ('Male', 'Female') THEN 'gender_invalid' END,
      CASE WHEN bmi IS NULL THEN 'bmi_missing' END,
      CASE WHEN bmi < 10 OR bmi > 70 THEN 'bmi_out_of_range' END,
      CASE WHEN children IS NULL THEN 'children_missing' END,
      CASE WHEN children < 0 OR children > 10 THEN 'children_out_of_range' END,
      CASE WHEN smoker IS NULL THEN 'smoker_missing' END,
      CASE WHEN region IS NULL THEN 'region_missing' END,
      CASE WHEN region NOT IN ('Northeast', 'Southeast', 'Northwest', 'Southwest') THEN 'region_invalid' END
    ) AS reasons
  FROM canon
)"""


@register("canonical_enums", with_claims(CLAIM_REQUESTS, _CANON_SQL)
          + "SELECT claim_key, gender, region FROM canon")
def q_canonical_enums(spark, sf_dir):
    return V.canonical_enums(claim_requests(spark, sf_dir)).select("claim_key", "gender", "region")


@register("rejected_requests", with_claims(CLAIM_REQUESTS, _CANON_SQL)
          + "SELECT claim_key, reasons AS reject_reasons FROM checked WHERE reasons <> ''")
def q_rejected(spark, sf_dir):
    _, bad = V.split_valid_rejected(claim_requests(spark, sf_dir))
    return bad.select("claim_key", F.array_join("reject_reasons", ",").alias("reject_reasons"))


@register("request_to_claim", with_claims(CLAIM_REQUESTS, _CANON_SQL) + """
SELECT claim_key, age, gender AS sex, bmi, children, CASE WHEN smoker THEN 'yes' ELSE 'no' END AS smoker,
       regexp_replace(region, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS region
FROM checked WHERE reasons = ''""")
def q_request_to_claim(spark, sf_dir):
    ok, _ = V.split_valid_rejected(claim_requests(spark, sf_dir))
    return V.request_to_claim(ok).select("claim_key", "age", "sex", "bmi", "children", "smoker", "region")


# ----------------------------------------------------------------------------- features

@register("encode_claims", with_claims(ENC_SQL)
          + "SELECT claim_key, smoker, sex, region, age_group, bmi_category FROM enc")
def q_encode(spark, sf_dir):
    return P.encode(claims(spark, sf_dir)).select("claim_key", "smoker", "sex", "region", "age_group", "bmi_category")


@register("fit_minmax", with_claims(ENC_SQL, MINMAX_SQL) + "SELECT * FROM mm")
def q_fit_minmax(spark, sf_dir):
    return P.fit_minmax(P.encode(claims(spark, sf_dir)))


@register("engineered_features", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL) + """
SELECT claim_key, round(risk_score, 6) AS risk_score, age_smoker, round(bmi_smoker, 6) AS bmi_smoker,
       round(age_bmi, 6) AS age_bmi, round(log_charges, 6) AS log_charges
FROM feat""")
def q_engineered(spark, sf_dir):
    f = _features(spark, sf_dir, targets=False)
    return f.select("claim_key", _r(F.col("risk_score")).alias("risk_score"), "age_smoker",
                    _r(F.col("bmi_smoker")).alias("bmi_smoker"), _r(F.col("age_bmi")).alias("age_bmi"),
                    _r(F.col("log_charges")).alias("log_charges"))


@register("targets", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL)
          + "SELECT claim_key, high_cost_flag, approved FROM tgt")
def q_targets(spark, sf_dir):
    return _features(spark, sf_dir).select("claim_key", "high_cost_flag", "approved")


@register("approval_rate", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL) + """
SELECT avg(approved) AS approval_rate, CAST(sum(approved) AS BIGINT) AS n_approved, count(*) AS n_claims FROM tgt""")
def q_approval_rate(spark, sf_dir):
    return P.approval_rate(_features(spark, sf_dir))


_ONEHOT_COLS = ([(f"region_{i}", f"CASE WHEN region = {i} THEN 1 ELSE 0 END") for i in range(4)]
                + [(f"age_group_{x}", f"CASE WHEN age_group = '{x}' THEN 1 ELSE 0 END") for x in E.AGE_LABELS]
                + [(f"bmi_cat_{x}", f"CASE WHEN bmi_category = '{x}' THEN 1 ELSE 0 END") for x in E.BMI_LABELS])
ONEHOT_SQL = "onehot AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _ONEHOT_COLS) + " FROM tgt)"


@register("one_hot", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL, ONEHOT_SQL)
          + "SELECT claim_key, " + ", ".join(n for n, _ in _ONEHOT_COLS) + " FROM onehot")
def q_one_hot(spark, sf_dir):
    return P.one_hot(_features(spark, sf_dir)).select("claim_key", *[n for n, _ in _ONEHOT_COLS])


_Z_STATS = "zs AS (SELECT " + ", ".join(
    f"avg(CAST({n} AS DOUBLE)) AS m_{n}, "
    f"CASE WHEN stddev_pop(CAST({n} AS DOUBLE)) > 0 THEN stddev_pop(CAST({n} AS DOUBLE)) ELSE 1.0 END AS s_{n}"
    for n in P.FEATURES) + " FROM onehot)"


@register("standardize", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL, ONEHOT_SQL, _Z_STATS)
          + "SELECT claim_key, " + ", ".join(
              f"round((CAST(o.{n} AS DOUBLE) - zs.m_{n}) / zs.s_{n}, 6) AS {n}_z" for n in P.FEATURES)
          + " FROM onehot o, zs")
def q_standardize(spark, sf_dir):
    feats = P.align(P.one_hot(_features(spark, sf_dir)))
    sc = P.fit_scaler(feats)
    z = P.scale(feats, sc, suffix="_z")
    return z.select("claim_key", *[_r(F.col(f"{n}_z")).alias(f"{n}_z") for n in P.FEATURES])


@register("patient_category", with_claims() + """
SELECT claim_key, CASE WHEN smoker = 'yes' AND bmi > 30 THEN 'high_bmi_smoker'
                       WHEN smoker = 'no' AND bmi > 30 THEN 'high_bmi_nonsmoker'
                       WHEN age < 35 AND bmi < 28 THEN 'young_healthy'
                       WHEN age > 55 THEN 'elderly_hypertension' ELSE 'general' END AS patient_category
FROM claims""")
def q_patient_category(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_key", E.patient_category().alias("patient_category"))


def _icd_values_sql():
    rows = ", ".join(f"('{c}', '{d}')" for _, c, d in A.ICD_DIMENSION)
    return f"icd_dim AS (SELECT * FROM (VALUES {rows}) AS t(icd_code, icd_description))"


@register("icd_describe", with_claims(_icd_values_sql()) + """
SELECT c.claim_key, c.icd_code, coalesce(d.icd_description, 'Unknown') AS icd_description
FROM claims c LEFT JOIN icd_dim d ON c.icd_code = d.icd_code""")
def q_icd_describe(spark, sf_dir):
    return A.icd_describe(claims(spark, sf_dir)).select("claim_key", "icd_code", "icd_description")


# ----------------------------------------------------------------------------- analytics

_CAT_SQL = """
cat AS (
  SELECT *, CASE WHEN smoker = 'yes' AND bmi > 30 THEN 'high_bmi_smoker'
                 WHEN smoker = 'no' AND bmi > 30 THEN 'high_bmi_nonsmoker'
                 WHEN age < 35 AND bmi < 28 THEN 'young_healthy'
                 WHEN age > 55 THEN 'elderly_hypertension' ELSE 'general' END AS patient_category
  FROM claims
)"""


@register("category_distribution", with_claims(_CAT_SQL) + """
SELECT patient_category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
FROM cat GROUP BY patient_category""")
def q_category_distribution(spark, sf_dir):
    c = claims(spark, sf_dir).withColumn("patient_category", E.patient_category())
    return A.share_by(c, "patient_category")


@register("icd_top8", with_claims(_icd_values_sql()) + """
SELECT t.icd_code, t.n, coalesce(d.icd_description, 'Unknown') AS icd_description
FROM (SELECT icd_code, count(*) AS n FROM claims GROUP BY icd_code ORDER BY n DESC, icd_code LIMIT 8) t
LEFT JOIN icd_dim d ON t.icd_code = d.icd_code""")
def q_icd_top8(spark, sf_dir):
    return A.icd_describe(A.top_k(claims(spark, sf_dir), "icd_code", 8))


@register("icd_top10", with_claims()
          + "SELECT icd_code, count(*) AS n FROM claims GROUP BY icd_code ORDER BY n DESC, icd_code LIMIT 10")
def q_icd_top10(spark, sf_dir):
    return A.top_k(claims(spark, sf_dir), "icd_code", 10)


@register("icd_distinct", with_claims() + "SELECT count(DISTINCT icd_code) AS n_distinct_icd_code FROM claims")
def q_icd_distinct(spark, sf_dir):
    return A.distinct_count(claims(spark, sf_dir), "icd_code")


@register("cost_percentiles", with_claims() + """
SELECT round(quantile_cont(charges, 0.25), 6) AS q25, round(quantile_cont(charges, 0.5), 6) AS q50,
       round(quantile_cont(charges, 0.75), 6) AS q75, round(quantile_cont(charges, 0.9), 6) AS q90
FROM claims""")
def q_cost_percentiles(spark, sf_dir):
    q = A.cost_percentiles(claims(spark, sf_dir))
    return q.select(*[_r(F.col(c)).alias(c) for c in ["q25", "q50", "q75", "q90"]])


@register("cost_histogram", with_claims(
    "st AS (SELECT min(charges) AS lo, max(charges) AS hi, avg(charges) AS mean FROM claims)",
    "w AS (SELECT lo, mean, CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 END AS width FROM st)",
    """b AS (SELECT CAST(least(floor((c.charges - w.lo) / w.width), 29) AS INTEGER) AS bin, count(*) AS n
            FROM claims c, w GROUP BY 1)""",
    "bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))") + """
SELECT bins.bin, round(w.lo + bins.bin * w.width, 6) AS bin_lo, round(w.lo + (bins.bin + 1) * w.width, 6) AS bin_hi,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n, round(w.mean, 6) AS mean
FROM bins CROSS JOIN w LEFT JOIN b ON bins.bin = b.bin""")
def q_cost_histogram(spark, sf_dir):
    h = A.histogram(claims(spark, sf_dir), "charges", 30)
    return h.select("bin", _r(F.col("bin_lo")).alias("bin_lo"), _r(F.col("bin_hi")).alias("bin_hi"), "n",
                    _r(F.col("mean")).alias("mean"))


@register("cost_by_smoker", with_claims(
    """q AS (SELECT smoker, quantile_cont(charges, 0.25) AS q1, quantile_cont(charges, 0.5) AS median,
                    quantile_cont(charges, 0.75) AS q3, min(charges) AS mn, max(charges) AS mx
             FROM claims GROUP BY smoker)""",
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)") + """
SELECT f.smoker, round(f.mn, 6) AS min, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.mx, 6) AS max,
       round(min(CASE WHEN c.charges >= f.lf THEN c.charges END), 6) AS whisker_lo,
       round(max(CASE WHEN c.charges <= f.uf THEN c.charges END), 6) AS whisker_hi,
       CAST(sum(CASE WHEN c.charges < f.lf OR c.charges > f.uf THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM claims c JOIN f ON c.smoker = f.smoker
GROUP BY f.smoker, f.mn, f.q1, f.median, f.q3, f.mx""")
def q_cost_by_smoker(spark, sf_dir):
    b = A.five_numbers(claims(spark, sf_dir), "smoker", "charges")
    return b.select("smoker", *[_r(F.col(c)).alias(c) for c in
                                ["min", "q1", "median", "q3", "max", "whisker_lo", "whisker_hi"]],
                    F.col("n_outliers").cast("long").alias("n_outliers"))


@register("approval_breakdown", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL) + """
SELECT approved, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
FROM tgt GROUP BY approved""")
def q_approval_breakdown(spark, sf_dir):
    return A.share_by(_features(spark, sf_dir), "approved")


@register("approval_by_region", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL) + """
SELECT region_name AS region, round(100.0 * avg(approved), 2) AS approved_rate_pct, count(*) AS n
FROM tgt GROUP BY region_name""")
def q_approval_by_region(spark, sf_dir):
    """Flagship slice: scan + join + encode + distributed quantile + group-by."""
    c = claims(spark, sf_dir)
    t = P.with_targets(c.withColumn("smoker", E.encode_smoker("smoker")), P.target_thresholds(c))
    return A.rate_by(t, "region", "approved")


@register("kpi_row", with_claims(ENC_SQL, MINMAX_SQL, FEAT_SQL, THR_SQL, TGT_SQL) + """
SELECT count(*) AS n_claims, round(100.0 * avg(CASE WHEN approved = 1 THEN 1 ELSE 0 END), 1) AS approval_rate_pct,
       round(avg(charges), 2) AS avg_cost FROM tgt""")
def q_kpi_row(spark, sf_dir):
    return A.kpi_row(_features(spark, sf_dir))


@register("enriched_claims", with_claims(_CAT_SQL, _icd_values_sql()) + """
SELECT c.claim_key, c.age, c.sex, c.bmi, c.children, c.smoker, c.region, c.charges, c.clinical_note, c.icd_code,
       coalesce(d.icd_description, 'Unknown') AS icd_description, c.patient_category
FROM cat c LEFT JOIN icd_dim d ON c.icd_code = d.icd_code""")
def q_enriched_claims(spark, sf_dir):
    """Build the enriched table (notes, code description, category),
    write it to the shared folder, and continue from the written table."""
    from halcyon.session import scratch_path
    from halcyon.sources.files import read_or_build

    def build():
        c = claims(spark, sf_dir).withColumn("patient_category", E.patient_category())
        return A.icd_describe(c)
    t = read_or_build(spark, scratch_path(spark, "enriched-claims"), build)
    return t.select("claim_key", *RAW_COLUMNS, "clinical_note", "icd_code", "icd_description", "patient_category")
