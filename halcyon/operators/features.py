"""Feature engineering, targets, one-hot, alignment and standardisation.

Fitted statistics (min/max, quantile thresholds, means/stds) are a handful
of numbers per feature: they are computed by one distributed aggregate, kept
as a small dict on the driver (bounded by the feature count, never by rows)
and applied as literals, so ``transform`` is a pure projection that also runs
unchanged inside a streaming query.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halcyon.functions import encode as E
from halcyon.operators.ranks import global_quantiles

NUMERIC_FEATURES = ["age", "bmi", "children", "risk_score", "age_smoker", "bmi_smoker",
                    "age_bmi", "smoker", "sex"]
REGION_DUMMIES = [f"region_{i}" for i in range(4)]
AGE_DUMMIES = [f"age_group_{x}" for x in E.AGE_LABELS]
BMI_DUMMIES = [f"bmi_cat_{x}" for x in E.BMI_LABELS]
FEATURES = NUMERIC_FEATURES + REGION_DUMMIES + AGE_DUMMIES + BMI_DUMMIES
MINMAX_COLS = ["age", "bmi", "children"]


def encode(df: DataFrame) -> DataFrame:
    """smoker/sex -> 0/1, region -> 0..3 (P1-P3), age_group/bmi_category."""
    return (df.withColumn("smoker", E.encode_smoker("smoker"))
              .withColumn("sex", E.encode_sex("sex"))
              .withColumn("region", E.encode_region("region"))
              .withColumn("age_group", E.age_group("age"))
              .withColumn("bmi_category", E.bmi_category("bmi")))


def fit_minmax(df: DataFrame, cols: Sequence[str] = MINMAX_COLS) -> DataFrame:
    """One-row table of min/max per column (P6): one aggregate pass."""
    return df.agg(*[F.min(c).cast("double").alias(f"{c}_min") for c in cols],
                  *[F.max(c).cast("double").alias(f"{c}_max") for c in cols])


def minmax_norm(df: DataFrame, stats: dict, cols: Sequence[str] = MINMAX_COLS,
                suffix: str = "_norm") -> DataFrame:
    """(x - min) / range with range 0 -> 1.0 (P7); not clipped."""
    out = df
    for c in cols:
        lo, hi = stats[f"{c}_min"], stats[f"{c}_max"]
        rng = (hi - lo) if hi != lo else 1.0
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - F.lit(lo)) / F.lit(rng))
    return out


def with_risk_score(df: DataFrame, stats: dict) -> DataFrame:
    """3*smoker + 2*bmi_n + 1.5*age_n + 0.5*children_n (P8) on encoded rows."""
    n = minmax_norm(df, stats)
    return n.withColumn("risk_score",
                        F.col("smoker") * F.lit(3) + F.col("bmi_norm") * F.lit(2)
                        + F.col("age_norm") * F.lit(1.5) + F.col("children_norm") * F.lit(0.5)) \
            .drop("age_norm", "bmi_norm", "children_norm")


def with_interactions(df: DataFrame) -> DataFrame:
    """age*smoker, bmi*smoker, age*bmi (P9) and log1p(charges) (P10)."""
    out = (df.withColumn("age_smoker", F.col("age") * F.col("smoker"))
             .withColumn("bmi_smoker", F.col("bmi") * F.col("smoker"))
             .withColumn("age_bmi", F.col("age") * F.col("bmi")))
    if "charges" in df.columns:
        out = out.withColumn("log_charges", F.log1p("charges"))
    return out


def engineer(df: DataFrame, stats: dict) -> DataFrame:
    return with_interactions(with_risk_score(encode(df), stats))


def target_thresholds(df: DataFrame, high_cost_q: float = 0.75, approve_q: float = 0.90) -> dict:
    """Charge quantiles used by the targets (exact, distributed)."""
    return global_quantiles(df, "charges", [high_cost_q, approve_q], names=["high_cost", "approve"])


def with_targets(df: DataFrame, thresholds: dict, bmi_limit: float = 45.0,
                 elderly_age: int = 60) -> DataFrame:
    """high_cost_flag (P11) and approved (P12) on *encoded* rows (smoker 0/1)."""
    return (df.withColumn("high_cost_flag", (F.col("charges") > F.lit(thresholds["high_cost"])).cast("int"))
              .withColumn("approved",
                          ((F.col("charges") < F.lit(thresholds["approve"]))
                           & (F.col("bmi") < F.lit(bmi_limit))
                           & ~((F.col("smoker") == 1) & (F.col("age") > F.lit(elderly_age)))).cast("int")))


def approval_rate(df: DataFrame, flag: str = "approved") -> DataFrame:
    """mean / sum / n of the approval flag."""
    return df.agg(F.avg(flag).alias("approval_rate"), F.sum(flag).cast("long").alias("n_approved"),
                  F.count(F.lit(1)).alias("n_claims"))


def one_hot(df: DataFrame) -> DataFrame:
    """Dummies for every known level (P14); nulls and unknowns give all zeros."""
    cols = [(F.col("region") == i).cast("int").alias(f"region_{i}") for i in range(4)]
    cols += [F.coalesce((F.col("age_group") == x).cast("int"), F.lit(0)).alias(f"age_group_{x}")
             for x in E.AGE_LABELS]
    cols += [F.coalesce((F.col("bmi_category") == x).cast("int"), F.lit(0)).alias(f"bmi_cat_{x}")
             for x in E.BMI_LABELS]
    return df.select("*", *cols)


def align(df: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Project to the fitted feature list as doubles; missing/null -> 0."""
    present = set(df.columns)
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in present
                               else F.lit(0.0)).alias(n) for n in names])


def fit_scaler(df: DataFrame, names: Sequence[str] = FEATURES) -> dict:
    """Population mean/std per feature in one pass (P16); std 0 -> 1."""
    row = df.agg(*[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)],
                 *[F.stddev_pop(n).alias(f"s_{i}") for i, n in enumerate(names)]).first()
    means = {n: float(row[f"m_{i}"] or 0.0) for i, n in enumerate(names)}
    stds = {n: (float(row[f"s_{i}"]) if row[f"s_{i}"] else 1.0) for i, n in enumerate(names)}
    return {"mean": means, "std": stds}


def scale(df: DataFrame, scaler: dict, names: Sequence[str] = FEATURES, suffix: str = "") -> DataFrame:
    out = df
    for n in names:
        out = out.withColumn(f"{n}{suffix}", (F.col(n) - F.lit(scaler["mean"][n])) / F.lit(scaler["std"][n]))
    return out


@dataclass
class Preprocessor:
    """Fitted preprocessing state: everything ``transform`` needs."""
    minmax: dict = field(default_factory=dict)
    thresholds: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    features: list = field(default_factory=lambda: list(FEATURES))

    @classmethod
    def fit(cls, claims: DataFrame) -> "Preprocessor":
        enc = encode(claims)
        mm = fit_minmax(enc).first().asDict()
        thr = target_thresholds(claims)
        feats = align(one_hot(with_interactions(with_risk_score(enc, mm))))
        return cls(minmax=mm, thresholds=thr, scaler=fit_scaler(feats))

    def transform(self, df: DataFrame, targets: bool = True, scaled: bool = True) -> DataFrame:
        out = engineer(df, self.minmax)
        if targets and "charges" in df.columns:
            out = with_targets(out, self.thresholds)
        out = align(one_hot(out), self.features)
        if scaled:
            out = scale(out, self.scaler, self.features, suffix="_z")
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Preprocessor":
        return cls(**json.loads(text))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "state string").coalesce(1) \
            .write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        return cls.from_json(spark.read.json(path).first()["state"])


def assemble(df: DataFrame, names: Sequence[str] = FEATURES, suffix: str = "_z",
             out: str = "features") -> DataFrame:
    """One ``VectorUDT`` column from the scaled features."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=[f"{n}{suffix}" for n in names], outputCol=out).transform(df)
