"""Claim approval classifier (M16-M20, W5): class-balanced random forest,
hold-out evaluation (AUC, accuracy, precision/recall/F1, ROC points,
confusion counts) and scoring with confidence bands and decision factors."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halcyon.operators import forest as T
from halcyon.operators.features import FEATURES
from halcyon.operators.modeling import SEED, stratified_split
from halcyon.operators.stats import auc, binary_metrics, confusion, roc_points

LABEL = "approved"
THRESHOLD = 0.5


def with_balanced_weight(df: DataFrame, label: str = LABEL, out: str = "class_weight") -> tuple[DataFrame, dict]:
    """weight = n / (2 * n_class) per row; the class counts are two numbers."""
    counts = {int(r[label]): int(r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = {c: n / (len(counts) * k) for c, k in counts.items()}
    expr = None
    for c, v in w.items():
        expr = F.when(F.col(label) == c, F.lit(v)) if expr is None else expr.when(F.col(label) == c, F.lit(v))
    return df.withColumn(out, expr), w


@dataclass
class ApprovalModel:
    model: object
    factors: list = field(default_factory=list)
    evaluation: dict = field(default_factory=dict)
    threshold: float = THRESHOLD

    def probability(self, df: DataFrame) -> DataFrame:
        """p_approve: the mean of the trees' weighted shares of approved rows in the leaf."""
        return self.model.transform(df, out="p_approve")

    def predict(self, df: DataFrame) -> DataFrame:
        """approved, probability (4 dp), confidence band, decision factors."""
        p = self.probability(df)
        dist = F.abs(F.col("p_approve") - F.lit(self.threshold))
        conf = F.when(dist > 0.3, F.lit("high")).when(dist > 0.15, F.lit("medium")).otherwise(F.lit("low"))
        return p.select("*", (F.col("p_approve") >= F.lit(self.threshold)).alias("approved_pred"),
                        F.round("p_approve", 4).alias("approval_probability"), conf.alias("approval_confidence"),
                        F.array(*[F.lit(f) for f in self.factors]).alias("decision_factors"))


    def save(self, spark: SparkSession, path: str) -> None:
        state = {"factors": self.factors, "evaluation": self.evaluation, "threshold": self.threshold}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/state")
        self.model.save(spark, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ApprovalModel":
        state = json.loads(spark.read.json(f"{path}/state").first()["state"])
        return cls(model=T.TreeEnsemble.load(spark, f"{path}/model"), **state)


def decision_factors(model: T.TreeEnsemble, names=FEATURES, top: int = 3) -> list:
    """The 3 most important features (W5): 22 numbers sorted on the driver."""
    imp = model.importances
    order = sorted(range(len(imp)), key=lambda i: (-imp[i], i))[:top]
    return [names[i] for i in order if i < len(names)]


def fit_approval(matrix: DataFrame, num_trees: int = 300, min_split: int = 10) -> tuple[ApprovalModel, DataFrame]:
    """Fit on the stratified 80 % and evaluate on the 20 % hold-out.
    Returns the model and the scored hold-out rows.  Trees are as deep as their rows make them; each
    node tries the square root of the number of features."""
    data = matrix.select("claim_key", "features", F.col(LABEL).cast("double").alias(LABEL)) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    train, test = stratified_split(data, LABEL, ["claim_key"])
    train, _ = with_balanced_weight(train)
    rows = T.bin_rows(train, ["claim_key"], LABEL, weight="class_weight")
    model = T.fit_forest(rows, T.Spec(num_trees, min_split, max(1, math.isqrt(rows.width)), SEED))
    am = ApprovalModel(model=model, factors=decision_factors(model))
    scored = am.probability(test).withColumn("pred", (F.col("p_approve") >= am.threshold).cast("int"))
    m = binary_metrics(scored, LABEL, "pred").first().asDict()
    m["roc_auc"] = auc(scored, LABEL, "p_approve").first()["roc_auc"]
    m["threshold"] = am.threshold
    am.evaluation = m
    return am, scored


def approval_roc(scored: DataFrame) -> DataFrame:
    return roc_points(scored, LABEL, "p_approve")


def approval_confusion(scored: DataFrame) -> DataFrame:
    return confusion(scored, LABEL, "pred")
