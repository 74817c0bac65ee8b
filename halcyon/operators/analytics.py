"""Population aggregates the claims team reads (all one-pass group-bys).

Shares use a window over the *aggregated* rows (one row per key, bounded by
the key cardinality), never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halcyon.operators.ranks import BROADCAST_ROWS, global_quantiles, quantiles
from halcyon.session import cut_lineage

ICD_DIMENSION = [
    # ---- fixed values: diagnosis key, ICD-10 code, description (20 rows) ----
    ("diabetes", "E11", "Type 2 Diabetes Mellitus"),
    ("copd", "J44", "Chronic Obstructive Pulmonary Disease"),
    ("hypertension", "I10", "Essential Hypertension"),
    ("wellness", "Z00", "General Health Examination"),
    ("hyperlipidemia", "E78", "Disorders of Lipoprotein Metabolism"),
    ("obesity", "E66", "Obesity"),
    ("respiratory", "J06", "Acute Upper Respiratory Infection"),
    ("ischemic_heart", "I25", "Chronic Ischaemic Heart Disease"),
    ("anxiety", "F41", "Anxiety Disorder"),
    ("gastro", "K21", "Gastro-Oesophageal Reflux Disease"),
    ("uti", "N39", "Urinary Tract Infection"),
    ("back_pain", "M54", "Dorsalgia / Chronic Back Pain"),
    ("asthma", "J45", "Asthma"),
    ("anaemia", "D50", "Iron-Deficiency Anaemia"),
    ("depression", "F32", "Depressive Episode"),
    ("malaria", "B54", "Unspecified Malaria"),
    ("typhoid", "A01", "Typhoid Fever"),
    ("skin", "L30", "Dermatitis"),
    ("eye", "H52", "Refractive Error"),
    ("dental", "K08", "Dental Disorder"),
]
RISK_LABELS = ["Low Risk", "Moderate Risk", "High Risk", "Critical Risk"]


def icd_dimension(spark) -> DataFrame:
    return spark.createDataFrame(ICD_DIMENSION, "diagnosis string, icd_code string, icd_description string")


def icd_describe(df: DataFrame, code: str = "icd_code") -> DataFrame:
    """Attach the description (P19); the 20-row dimension is broadcast (fixed size)."""
    dim = icd_dimension(df.sparkSession).select(F.col("icd_code").alias("_code"), "icd_description")
    return df.join(F.broadcast(dim), F.col(code) == F.col("_code"), "left") \
        .withColumn("icd_description", F.coalesce("icd_description", F.lit("Unknown"))).drop("_code")


def share_by(df: DataFrame, key: str, pct_digits: int = 2) -> DataFrame:
    """count and percentage share per key (A1, A7, A13).  The total is a
    scalar subquery over the aggregated rows (evaluated once, no
    single-partition window), so any key cardinality is fine."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n")).scalar()
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / tot, pct_digits))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """k most frequent keys, ties by key (A2, A18): partial-aggregate then
    TakeOrderedAndProject — only k rows per partition reach the driver side."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def distinct_count(df: DataFrame, key: str, approx: bool = False) -> DataFrame:
    """number of distinct keys (A3); ``approx`` uses HyperLogLog++ for scale."""
    f = F.approx_count_distinct(key) if approx else F.countDistinct(key)
    return df.agg(f.alias(f"n_distinct_{key}"))


def cost_percentiles(df: DataFrame, col: str = "charges",
                     qs: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """q25/q50/q75/q90 with linear interpolation, exact and distributed (A4)."""
    return quantiles(df, col, qs)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (A11); empty bins kept.

    min/max/mean come from one aggregate; the bin table is generated from the
    bin count, not from the data.
    """
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("mean")).first()
    lo, hi, mean = float(st["lo"]), float(st["hi"]), float(st["mean"])
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    allbins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return allbins.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.lit(mean).alias("mean"))


def five_numbers(df: DataFrame, key: str, col: str) -> DataFrame:
    """Box-plot summary per key (A12): min, q1, median, q3, max and 1.5 IQR
    whisker ends (the most extreme data values inside the fences)."""
    # everything is read off one row per (key, value), so a key with most rows is no hot join key
    counts = cut_lineage(df.groupBy(key, col).agg(F.count(F.lit(1)).alias("n")))
    q = quantiles(counts, col, [0.25, 0.5, 0.75], by=[key], names=["q1", "median", "q3"], weight=F.col("n"))
    mm = counts.groupBy(key).agg(F.min(col).alias("min"), F.max(col).alias("max"))
    base = cut_lineage(q.join(mm, key))
    fences = base.select(key, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lf"),
                         (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_uf"))
    fences = F.broadcast(fences) if base.count() <= BROADCAST_ROWS else fences
    wh = counts.join(fences, key).groupBy(key).agg(
        F.min(F.when(F.col(col) >= F.col("_lf"), F.col(col))).alias("whisker_lo"),
        F.max(F.when(F.col(col) <= F.col("_uf"), F.col(col))).alias("whisker_hi"),
        F.sum(F.when((F.col(col) < F.col("_lf")) | (F.col(col) > F.col("_uf")), F.col("n")).otherwise(0)).alias("n_outliers"))
    return base.join(wh, key)


def rate_by(df: DataFrame, key: str, flag: str, pct_digits: int = 2) -> DataFrame:
    """100 * mean(flag) per key."""
    return df.groupBy(key).agg(F.round(F.lit(100.0) * F.avg(flag), pct_digits).alias(f"{flag}_rate_pct"),
                               F.count(F.lit(1)).alias("n"))


def profile_by(df: DataFrame, key: str, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Rounded means per key."""
    return df.groupBy(key).agg(*[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in cols])


def label_by_rank(profiles: DataFrame, key: str, order_col: str,
                  labels: Sequence[str] = RISK_LABELS, out: str = "risk_label") -> DataFrame:
    """Rank keys by ``order_col`` (ties by key) and name them (W2).  Runs on one
    row per cluster, so the global window is bounded by K."""
    w = Window.orderBy(F.col(order_col).asc(), F.col(key).asc())
    rank = F.row_number().over(w) - 1
    lab = None
    for i, name in enumerate(labels):
        lab = F.when(rank == i, F.lit(name)) if lab is None else lab.when(rank == i, F.lit(name))
    return profiles.select("*", rank.alias("charge_rank"),
                           F.coalesce(lab, F.concat(F.lit("Segment "), rank.cast("string"))).alias(out))


def ordered_counts(df: DataFrame, key: str, order: Sequence[str] = RISK_LABELS) -> DataFrame:
    """Counts in a fixed label order with zeros for absent labels."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, v) for i, v in enumerate(order)], f"position int, {key} string")
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(c, key, "left").select("position", key, F.coalesce("n", F.lit(0)).alias("n"))


def column_minmax_scale(df: DataFrame, cols: Sequence[str], const_value: float = 0.5) -> DataFrame:
    """Column-wise min-max of a small profile table; constant column -> 0.5."""
    w = Window.partitionBy(F.lit(1))
    out = df
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        out = out.withColumn(f"{c}_scaled", F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(const_value)))
    return out


def score_summary(df: DataFrame, score: str, flag: str) -> DataFrame:
    """n, flagged, rate %, mean, population std and five quantiles of a score
    (A8-A10) — one aggregate plus one distributed quantile pass."""
    base = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("int")).cast("long").alias("n_flagged"),
                  F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"),
                  F.min(score).alias("score_min"), F.max(score).alias("score_max"))
    q = global_quantiles(df, score, [0.05, 0.25, 0.5, 0.75, 0.95],
                         names=["score_p5", "score_q1", "score_median", "score_q3", "score_p95"])
    # the quantiles are one bounded row: attach them as literals
    return base.select("*", *[F.lit(v).cast("double").alias(k) for k, v in q.items()]) \
        .withColumn("rate_pct", F.round(F.lit(100.0) * F.col("n_flagged") / F.col("n"), 2))


def kpi_row(df: DataFrame, cost: str = "charges", approved: str = "approved", anomaly: str | None = None) -> DataFrame:
    """claims, approval %, average cost, anomaly % (A19), 1 dp."""
    aggs = [F.count(F.lit(1)).alias("n_claims"),
            F.round(F.lit(100.0) * F.avg((F.col(approved) == 1).cast("int")), 1).alias("approval_rate_pct"),
            F.round(F.avg(cost), 2).alias("avg_cost")]
    if anomaly:
        aggs.append(F.round(F.lit(100.0) * F.avg(F.col(anomaly).cast("int")), 1).alias("anomaly_rate_pct"))
    return df.agg(*aggs)
