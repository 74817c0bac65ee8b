"""Experiment, drift and model-evaluation statistics.

Every statistic is a group-by over sufficient statistics (counts, sums,
variances) or over the distributed cumulative counts of ``ranks``; Python runs
only on the final per-experiment / per-feature rows (p-values), via Arrow.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from halcyon.operators.ranks import cumulative_counts
from halcyon.session import cut_lineage


# ----------------------------------------------------------------------------- distributions

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def reg_inc_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """P(|T| >= |t|) for Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    return reg_inc_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def kolmogorov_sf(d: float, en: float) -> float:
    """Asymptotic two-sample KS p-value, lambda = sqrt(en) * D, en = n*m/(n+m)."""
    if d is None or en is None or en <= 0:
        return float("nan")
    lam = math.sqrt(en) * d
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for k in range(1, 201):
        term = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
        s += term
        if abs(term) < 1e-16:
            break
    return min(max(s, 0.0), 1.0)


@F.pandas_udf(DoubleType())
def t_pvalue_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def ks_pvalue_udf(d: pd.Series, en: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_sf(a, b) for a, b in zip(d, en)], dtype="float64")


# ----------------------------------------------------------------------------- A/B tests

def ab_test(df: DataFrame, variant: str, metric: str, control: str, treatment: str,
            experiment: str | None = None) -> DataFrame:
    """Equal-variance two-sample t statistic and Cohen's d per experiment.

    One aggregate of (n, mean, sample variance) per (experiment, variant),
    then a pivot of the two arms — no raw row leaves its partition.
    """
    keys = [experiment] if experiment else []
    arms = df.where(F.col(variant).isin(control, treatment)).groupBy(*keys).agg(
        *[f(F.when(F.col(variant) == v, F.col(metric).cast("double"))).alias(f"{n}_{s}")
          for v, s in ((control, "c"), (treatment, "t"))
          for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    nc, nt = F.col("n_c").cast("double"), F.col("n_t").cast("double")
    sp2 = F.try_divide((nc - 1) * F.col("var_c") + (nt - 1) * F.col("var_t"), nc + nt - 2)
    t = F.try_divide(F.col("mean_c") - F.col("mean_t"),
                     F.sqrt(sp2 * (F.try_divide(F.lit(1.0), nc) + F.try_divide(F.lit(1.0), nt))))
    pooled = F.sqrt((F.col("var_c") + F.col("var_t")) / 2)
    d = F.when(pooled > 0, (F.col("mean_t") - F.col("mean_c")) / pooled).otherwise(F.lit(0.0))
    return arms.select(*keys, F.lit(control).alias("control_name"), F.lit(treatment).alias("treatment_name"),
                       F.lit(metric).alias("metric"), "n_c", "n_t", F.col("mean_c").alias("control_mean"),
                       F.col("mean_t").alias("treatment_mean"), t.alias("t_stat"), (nc + nt - 2).alias("dof"),
                       d.alias("effect_size"))


def z_quantile(p: float) -> float:
    return statistics.NormalDist().inv_cdf(p)


def min_sample_size(effect: Column, alpha: float = 0.05, power: float = 0.80,
                    two_sample: bool = False) -> Column:
    """ceil(((z_{1-alpha/2} + z_power) / d)^2), 0 when d = 0 (T4).  The z values
    are constants folded at plan time."""
    z = z_quantile(1 - alpha / 2) + z_quantile(power)
    n = F.ceil(F.pow(F.lit(z) / effect, 2)) * (2 if two_sample else 1)
    return F.when(effect == 0, F.lit(0)).otherwise(n).cast("long")


def ab_decision(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p-value, significance, winner and recommendation text."""
    p = tested.withColumn("p_value", t_pvalue_udf(F.col("t_stat"), F.col("dof")))
    sig = F.col("p_value") < F.lit(alpha)
    winner = F.when(sig & (F.col("treatment_mean") > F.col("control_mean")), F.col("treatment_name")) \
        .otherwise(F.col("control_name"))
    better = F.when(F.col("treatment_mean") > F.col("control_mean"), F.lit("outperforms")) \
        .otherwise(F.lit("underperforms"))
    text = F.when(sig, F.format_string(
        "Statistically significant difference detected in %s (p = %.4f). Treatment '%s' (mean: %.4f) %s "
        "Control '%s' (mean: %.4f) with an effect size of %.4f. Recommendation: Deploy %s.",
        "metric", "p_value", "treatment_name", "treatment_mean", better, "control_name", "control_mean",
        "effect_size", winner)).otherwise(F.format_string(
        "No statistically significant difference detected in %s (p = %.4f). Treatment '%s' (mean: %.4f) vs "
        "Control '%s' (mean: %.4f). Effect size: %.4f. Recommendation: Keep %s (Control).",
        "metric", "p_value", "treatment_name", "treatment_mean", "control_name", "control_mean",
        "effect_size", "control_name"))
    return p.withColumn("is_significant", sig).withColumn("winner", winner) \
        .withColumn("recommendation", text).withColumn("min_sample_size", min_sample_size(F.col("effect_size")))


# ----------------------------------------------------------------------------- drift

def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) with value as double."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(list(keep), list(cols), "feature", "value")


def reference_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, sample std, min, max, n per numeric column (T5), one pass."""
    return unpivot(df, cols).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n): all that drift needs of a sample."""
    return unpivot(df, cols).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _drift(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """KS statistic D, sizes, means and shift % per ``by`` from (by..., value, _r, _c): how often each value
    stands in the reference and in the current sample."""
    cc = cumulative_counts(counts.where(F.col("value").isNotNull()), "value", by=by, weights={"r": F.col("_r"), "c": F.col("_c")})
    gap = F.abs(F.try_divide(F.col("cum_r"), F.col("tot_r")) - F.try_divide(F.col("cum_c"), F.col("tot_c")))
    # the means come from the same per-value count table: no second pass over the rows
    d = cc.groupBy(*by).agg(
        F.max(gap).alias("ks_statistic"), F.first("tot_r").alias("n_ref"), F.first("tot_c").alias("n_cur"),
        F.try_divide(F.sum(F.col("value") * F.col("r")), F.first("tot_r")).alias("reference_mean"),
        F.try_divide(F.sum(F.col("value") * F.col("c")), F.first("tot_c")).alias("current_mean"))
    shift = F.when(F.col("reference_mean") != 0,
                   F.lit(100.0) * (F.col("current_mean") - F.col("reference_mean")) / F.col("reference_mean")) \
        .otherwise(F.lit(0.0))
    return d.withColumn("mean_shift_pct", shift)


def feature_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str], counted: bool = False) -> DataFrame:
    """Two-sample KS statistic D per feature plus means and shift %.

    Both samples go into one (feature, value) count table with per-side
    weights; D is the max gap of the two empirical CDFs over the distinct
    values, computed with the distributed cumulative counts.  With ``counted``
    the reference is its ``value_counts`` table.
    """
    r = reference if counted else unpivot(reference, cols).withColumn("n", F.lit(1).cast("long"))
    r = r.select("feature", "value", F.col("n").alias("_r"), F.lit(0).cast("long").alias("_c"))
    c = unpivot(current, cols).select("feature", "value", F.lit(0).cast("long").alias("_r"), F.lit(1).cast("long").alias("_c"))
    return _drift(r.unionByName(c), ["feature"])


def window_drift(counts: DataFrame) -> DataFrame:
    """Drift of each window against all windows before it (X5), from (window_start, feature, value, n); the first
    window has nothing before it and no row.  Only value counts are read: each once for every later
    window (windows are few: one row per period)."""
    counts = cut_lineage(counts)
    if counts.isEmpty():
        return _drift(counts.withColumn("_r", F.col("n")).withColumn("_c", F.col("n")), ["window_start", "feature"])
    windows = [r["window_start"] for r in counts.select("window_start").distinct().collect()]
    later = F.explode(F.filter(F.array(*[F.lit(w).cast("timestamp") for w in windows]), lambda w: w > F.col("window_start"))).alias("_w")
    earlier = counts.select("feature", "value", "n", later) \
        .groupBy(F.col("_w").alias("window_start"), "feature", "value").agg(F.sum("n").alias("_r")).withColumn("_c", F.lit(0).cast("long"))
    now = counts.select("window_start", "feature", "value", F.lit(0).cast("long").alias("_r"), F.col("n").alias("_c"))
    return _drift(earlier.unionByName(now), ["window_start", "feature"]).where((F.col("n_ref") > 0) & (F.col("n_cur") > 0))


def drift_report(drift: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the asymptotic KS p-value and the drift flag."""
    en = F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur"))
    return drift.withColumn("p_value", ks_pvalue_udf(F.col("ks_statistic"), en.cast("double"))) \
        .withColumn("drift_detected", F.col("p_value") < F.lit(alpha))


# ----------------------------------------------------------------------------- model evaluation

def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with ties counted one half (Mann-Whitney), per group.

    AUC = sum_v pos(v) * (neg(< v) + neg(v) / 2) / (P * N) over distinct scores,
    using the distributed cumulative counts — no global sort.
    """
    pos = (F.col(label) == 1).cast("long")
    w = {"wp": pos, "wn": F.lit(1) - pos}
    cc = cumulative_counts(df.where(F.col(score).isNotNull()), score, by=by, weights=w)
    contrib = F.col("wp") * ((F.col("cum_wn") - F.col("wn")) + F.col("wn") / 2.0)
    out = cc.groupBy(*by).agg(F.try_divide(F.sum(contrib), F.first("tot_wp") * F.first("tot_wn")).alias("roc_auc"),
                              F.first("tot_wp").alias("n_pos"), F.first("tot_wn").alias("n_neg"))
    return out


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score: predictions are
    positive when score >= threshold (M18)."""
    pos = (F.col(label) == 1).cast("long")
    cc = cumulative_counts(df.where(F.col(score).isNotNull()), score,
                           weights={"wp": pos, "wn": F.lit(1) - pos})
    tp = F.col("tot_wp") - (F.col("cum_wp") - F.col("wp"))
    fp = F.col("tot_wn") - (F.col("cum_wn") - F.col("wn"))
    return cc.select(F.col(score).alias("threshold"), (fp / F.col("tot_wn")).alias("fpr"),
                     (tp / F.col("tot_wp")).alias("tpr"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per-class precision, recall, F1 and support from the confusion counts."""
    cm = confusion(df, actual, predicted).withColumn("_hit", (F.col("actual") == F.col("predicted")).cast("long"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"),
                                                     F.sum(F.col("n") * F.col("_hit")).alias("tp"))
    pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    r = sup.join(pred, "cls", "full_outer").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("n_pred", F.lit(0)).alias("n_pred"))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    r = r.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return r.withColumn("f1", f1)


def class_summary(report: DataFrame) -> DataFrame:
    """accuracy, macro F1 and support-weighted F1 from ``class_report`` rows."""
    return report.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("n"))


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy, precision/recall/F1 of class 1 and predicted-positive rate."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum((y & p).cast("long")).alias("tp"),
                 F.sum((~y & p).cast("long")).alias("fp"), F.sum((y & ~p).cast("long")).alias("fn"),
                 F.sum((F.col(label) == F.col(predicted)).cast("long")).alias("hits"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    out = agg.select("n", (F.col("hits") / F.col("n")).alias("accuracy"), prec.alias("precision"),
                     rec.alias("recall"), ((F.col("tp") + F.col("fp")) / F.col("n")).alias("approval_rate"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MAE, RMSE and R^2 in one pass (M5): R^2 = 1 - SSE / SST with
    SST = sum(y^2) - n * mean(y)^2 from the same aggregate."""
    e = F.col(y) - F.col(yhat)
    a = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
               F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_vy"), F.count(F.lit(1)).alias("n"))
    return a.select("mae", "rmse", (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))).alias("r2"), "n")


def weighted_ovr_auc(df: DataFrame, label: str, classes: Sequence[str], prob_col: str) -> DataFrame:
    """One-vs-rest AUC per class weighted by class support (N14); ``prob_col``
    is an array of class probabilities aligned with ``classes``."""
    ex = df.select(F.col(label).alias("_y"), F.posexplode(prob_col).alias("_i", "_p"))
    cls = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_i") + 1)
    ex = ex.withColumn("cls", cls).withColumn("_pos", (F.col("_y") == F.col("cls")).cast("int"))
    per = auc(ex, "_pos", "_p", by=["cls"])
    # a class without positives or negatives has no AUC; the rest are weighted by support
    ok = per.where(F.col("roc_auc").isNotNull())
    return ok.agg(F.coalesce(F.try_divide(F.sum(F.col("roc_auc") * F.col("n_pos")), F.sum("n_pos")), F.lit(0.0))
                  .alias("roc_auc_ovr_weighted"))


def monitor_summary(scored: DataFrame, drift: DataFrame, processing_ms: float | None = None,
                    anomaly: str = "is_anomaly") -> DataFrame:
    """requests, anomalies, rate % (2 dp), average ms per request (2 dp) and
    the drift message (T8).  ``drift`` has one row per feature, so the list of
    drifted names is bounded by the feature count."""
    s = scored.agg(F.count(F.lit(1)).alias("request_count"),
                   F.sum(F.col(anomaly).cast("long")).alias("anomaly_count"))
    names = drift.where(F.col("drift_detected")).agg(
        F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("_d")).first()["_d"]
    msg = f"Data drift detected in features: {names}" if names else "No drift detected."
    rate = F.when(F.col("request_count") > 0,
                  F.round(F.lit(100.0) * F.col("anomaly_count") / F.col("request_count"), 2)).otherwise(F.lit(0.0))
    avg = F.lit(None).cast("double") if processing_ms is None else \
        F.when(F.col("request_count") > 0, F.round(F.lit(float(processing_ms)) / F.col("request_count"), 2)) \
         .otherwise(F.lit(0.0))
    return s.select("request_count", F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
                    rate.alias("anomaly_rate"), avg.alias("avg_processing_ms"), F.lit(msg).alias("drift_status"))
