"""Claim-cost regression (M1-M8, A17): model selection by cross-validated R^2,
grid tuning of the winner, hold-out evaluation on the raw scale, refit on all
rows, and scoring with a +/-18 % band and a cost tier.

Trees come from ``forest``: all folds of a forest grow at once, without a limit on their depth, and one fit
per fold and shape answers every grid point that is a part of it.  Boosted models of up to
``forest.BOOST_ROWS`` rows are fitted one fit a group; beyond, Spark ML's boosting scans the rows once per level.
Ridge is exact from one Gram matrix per fold.  Folds come from a hash of the claim key, so nothing depends on partitioning.
"""

from __future__ import annotations

import json
import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halcyon.operators import forest as T
from halcyon.operators.features import FEATURES
from halcyon.operators.modeling import SEED, coefficients_table, fold_column, hash_split
from halcyon.operators.ranks import global_quantiles
from halcyon.operators.stats import regression_metrics

LABEL = "log_charges"
CI_SHARE = 0.18
TREE_MEMORY_MB = 1024  # statistics of a whole tree level fit, so a level is one pass


@dataclass(frozen=True)
class Protocol:
    """How candidates are compared and the winner is tuned; the defaults are the reference values."""
    folds: int = 5
    tune_folds: int = 3
    boost_trees: int = 100
    boost_shape: tuple = (3, 0.1)                                     # depth, rate
    boost_sizes: tuple = (100, 200)
    boost_shapes: tuple = ((3, 0.05), (4, 0.05), (3, 0.1), (4, 0.1))
    forest_trees: int = 100
    forest_sizes: tuple = (100, 200)
    forest_depths: tuple = (None, 10)
    alpha: float = 1.0
    alphas: tuple = (0.1, 1.0, 10.0)


def _ridge(alpha: float, label_std: float, n: float) -> LinearRegression:
    """Ridge(alpha) as MLlib's normal-equation solver: MLlib scales the
    objective by the label std and 1/n, so regParam = alpha * std(y) / n."""
    return LinearRegression(featuresCol="features", labelCol=LABEL, regParam=alpha * label_std / max(n, 1.0),
                            elasticNetParam=0.0, standardization=False, solver="normal")


def _label_stats(df: DataFrame) -> tuple[float, float]:
    r = df.agg(F.stddev_pop(LABEL).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return float(r["s"] or 1.0), float(r["n"])


def _gbt(trees: int, depth: int, rate: float) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=LABEL, maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED, maxBins=64,
                        maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=True)


def _concurrent(train: DataFrame) -> int:
    """Fits submitted at once: boosting is a chain of small jobs, so fits and not rows keep the cores busy."""
    return max(4, min(16, train.sparkSession.sparkContext.defaultParallelism))


def fold_moments(data: DataFrame, folds: int, label: str = LABEL) -> list[np.ndarray]:
    """Per fold the matrix Z'Z of Z = (1, features, label): one pass, one small matrix per partition and fold."""
    def run(batches):
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            z = np.column_stack([np.ones(b.num_rows), x, b.column(2).to_numpy(zero_copy_only=False)])
            fold = b.column(0).to_numpy()
            for f in np.unique(fold):
                mine = z[fold == f]
                total[f] = total.get(f, 0) + mine.T @ mine
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(f)], pa.int32()), pa.array([m.ravel().tolist()])], names=["fold", "m"])

    rows = (data.select(F.col("fold").cast("int"), vector_to_array("features").alias("x"), F.col(label).cast("double"))
            .mapInArrow(run, "fold int, m array<double>").select("fold", F.posexplode("m").alias("i", "v"))
            .groupBy("fold", "i").agg(F.sum("v").alias("v")).collect())      # folds x (features + 2)^2 numbers
    size = max((r["i"] for r in rows), default=0) + 1
    out = [np.zeros(size) for _ in range(folds)]
    for r in rows:
        out[r["fold"]][r["i"]] = r["v"]
    width = int(round(size ** 0.5))
    return [m.reshape(width, width) for m in out]


def ridge_solution(m: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, weights) of ridge regression from Z'Z; the intercept carries no penalty."""
    n, mean = m[0, 0], m[0, 1:] / max(m[0, 0], 1.0)
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    k = len(mean) - 1
    w = np.linalg.lstsq(centred[:k, :k] + alpha * np.eye(k), centred[:k, k], rcond=None)[0]
    return np.concatenate([[mean[k] - mean[:k] @ w], w])


def ridge_cv(moments: list[np.ndarray], alphas) -> list[list[float]]:
    """R^2 on each fold of the ridge fitted on the others, for each alpha; exact, from the fold matrices alone."""
    whole = sum(moments)
    out = []
    for alpha in alphas:
        scores = []
        for m in moments:
            b = np.concatenate([ridge_solution(whole - m, alpha), [-1.0]])
            sse, n = b @ m @ b, m[0, 0]
            sst = m[-1, -1] - m[0, -1] ** 2 / max(n, 1.0)
            scores.append(float(1 - sse / sst) if sst > 0 else 0.0)
        out.append(scores)
    return out


def boosted_cv(est: GBTRegressor, sizes: list[int], shapes: list[dict], data: DataFrame, folds: int, parallelism: int) -> dict:
    """R^2 per fold for each (shape, number of trees).  A boosted model of n trees is the first n trees of a
    longer one, so one fit of the longest per shape and fold gives the scores of all its prefixes."""
    def run(job):
        shape, f = job
        model = est.copy({est.maxIter: max(sizes), **{getattr(est, k): v for k, v in shapes[shape].items()}}).fit(data.where(F.col("fold") != f))
        valid = data.where(F.col("fold") == f)
        errors = model.evaluateEachIteration(valid, "squared")
        spread = valid.agg(F.var_pop(LABEL)).first()[0]
        return [((shape, n), 1 - errors[n - 1] / spread) for n in sizes]

    scores: dict = {}
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for got in pool.map(run, [(s, f) for s in range(len(shapes)) for f in range(folds)]):
            for key, r2 in got:
                scores.setdefault(key, []).append(r2)
    return scores


def _boosting_cv(data: DataFrame, binned: T.Binned, folds: int, shapes, sizes) -> dict:
    """{(shape, size): R^2 per fold} of boosted models, by the way that fits the number of rows."""
    if binned.n <= T.BOOST_ROWS:
        return T.cv_boost(binned, folds, shapes, sizes)
    grid = [{"maxDepth": d, "stepSize": r} for d, r in shapes]
    return boosted_cv(_gbt(max(sizes), *shapes[0]), list(sizes), grid, data, folds, _concurrent(data))


def _folds(train: DataFrame, folds: int, cuts: list | None = None) -> tuple[DataFrame, T.Binned]:
    data = fold_column(train, ["claim_key"], folds).persist(StorageLevel.MEMORY_AND_DISK)
    return data, T.bin_rows(data, ["claim_key"], LABEL, fold="fold", cuts=cuts)


def compare_regressors(train: DataFrame, protocol: Protocol = Protocol(), cuts: list | None = None) -> DataFrame:
    """Cross-validated R^2 (mean, std) per candidate (M3) -> one row per model."""
    data, binned = _folds(train, protocol.folds, cuts)
    scores = {"GradientBoosting": _boosting_cv(data, binned, protocol.folds, [protocol.boost_shape], [protocol.boost_trees])[0, protocol.boost_trees],
              "RandomForest": T.cv_forest(binned, protocol.folds, T.Spec(protocol.forest_trees, seed=SEED))[protocol.forest_trees, None],
              "Ridge": ridge_cv(fold_moments(data, protocol.folds), [protocol.alpha])[0]}
    data.unpersist()
    rows = [(k, statistics.fmean(v), statistics.pstdev(v)) for k, v in scores.items()]
    return train.sparkSession.createDataFrame(rows, "model_name string, cv_r2_mean double, cv_r2_std double")


@dataclass
class CostModel:
    model: object
    model_name: str
    tiers: dict = field(default_factory=dict)
    evaluation: dict = field(default_factory=dict)
    selection: list = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """predicted cost (2 dp), +/-18 % band, log prediction (4 dp), tier,
        model name (M7, M8)."""
        p = self.model.transform(df).withColumn("_raw", F.expm1("prediction"))
        tier = cost_tier(F.col("_raw"), self.tiers)
        return p.select("*", F.round("_raw", 2).alias("predicted_cost"),
                        F.round(F.col("_raw") * (1 - CI_SHARE), 2).alias("ci_lower"),
                        F.round(F.col("_raw") * (1 + CI_SHARE), 2).alias("ci_upper"),
                        F.round("prediction", 4).alias("log_prediction"), tier.alias("cost_tier"),
                        F.lit(self.model_name).alias("model_used")).drop("_raw")

    def feature_weights(self, spark, names=FEATURES, top: int = 15) -> DataFrame:
        """Top features (A17): importances for trees, |coef| for the linear model."""
        m = self.model
        vals = (m.importances if isinstance(m, T.TreeEnsemble) else m.featureImportances.toArray() if hasattr(m, "featureImportances")
                else m.coefficients.toArray())
        return coefficients_table(spark, names, vals, top)

    def save(self, spark: SparkSession, path: str) -> None:
        """The model and what was measured about it, below ``path``."""
        trees = isinstance(self.model, T.TreeEnsemble)
        state = {"model_name": self.model_name, "tiers": self.tiers, "evaluation": self.evaluation, "selection": self.selection, "trees": trees}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/state")
        if trees:
            self.model.save(spark, f"{path}/model")
        else:
            PipelineModel(stages=[self.model]).write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CostModel":
        state = json.loads(spark.read.json(f"{path}/state").first()["state"])
        model = T.TreeEnsemble.load(spark, f"{path}/model") if state.pop("trees") else PipelineModel.load(f"{path}/model").stages[0]
        return cls(model=model, **state)


def cost_tier(cost, t: dict):
    """<= q25 low, <= q75 medium, <= q90 high, else very_high (M8)."""
    return (F.when(cost <= F.lit(t["q25"]), F.lit("low"))
            .when(cost <= F.lit(t["q75"]), F.lit("medium"))
            .when(cost <= F.lit(t["q90"]), F.lit("high")).otherwise(F.lit("very_high")))


def cost_tier_thresholds(df: DataFrame, col: str = "charges") -> dict:
    """q25/q50/q75/q90 of the training charges (A4), exact and distributed."""
    return global_quantiles(df, col, [0.25, 0.5, 0.75, 0.9])


def _tuned(name: str, train: DataFrame, protocol: Protocol, cuts: list | None = None) -> tuple:
    """The winner's best parameters by cross-validation over its grid; of equal scores the first."""
    data, binned = _folds(train, protocol.tune_folds, cuts)
    if name == "Ridge":
        scores = {(a,): v for a, v in zip(protocol.alphas, ridge_cv(fold_moments(data, protocol.tune_folds), protocol.alphas))}
    elif name == "GradientBoosting":
        got = _boosting_cv(data, binned, protocol.tune_folds, protocol.boost_shapes, protocol.boost_sizes)
        scores = {(n, *shape): got[s, n] for s, shape in enumerate(protocol.boost_shapes) for n in protocol.boost_sizes}
    else:
        got = T.cv_forest(binned, protocol.tune_folds, T.Spec(max(protocol.forest_sizes), seed=SEED), protocol.forest_sizes, protocol.forest_depths)
        scores = {(n, d): got[n, d] for d in protocol.forest_depths for n in protocol.forest_sizes}
    data.unpersist()
    return max(scores, key=lambda k: statistics.fmean(scores[k]))


def fit_named(name: str, params: tuple, rows: DataFrame, cuts: list | None = None):
    """The candidate ``name`` with its tuned parameters on ``rows``."""
    if name == "Ridge":
        return _ridge(params[0], *_label_stats(rows)).fit(rows)
    binned = T.bin_rows(rows, ["claim_key"], LABEL, cuts=cuts)
    if name == "RandomForest":
        return T.fit_forest(binned, T.Spec(params[0], seed=SEED), params[1])
    return T.fit_boost(binned, *params) if binned.n <= T.BOOST_ROWS else _gbt(*params).fit(rows)


def fit_cost(matrix: DataFrame, protocol: Protocol = Protocol()) -> CostModel:
    """M3-M6 end to end on rows with (claim_key, features, log_charges, charges)."""
    data = matrix.select("claim_key", "features", LABEL, "charges").persist(StorageLevel.MEMORY_AND_DISK)
    tiers = cost_tier_thresholds(data)
    train, test = hash_split(data, ["claim_key"])
    cuts = T.feature_cuts(train)              # the bins of all fits
    sel = compare_regressors(train, protocol, cuts).collect()
    best = max(sel, key=lambda r: r["cv_r2_mean"])
    params = _tuned(best["model_name"], train, protocol, cuts)
    # the tuned model on the training split (for the hold-out numbers) and the
    # refit on every row are independent: fit both at once
    with ThreadPoolExecutor(max_workers=2) as pool:
        tuned_model, final = pool.map(lambda rows: fit_named(best["model_name"], params, rows, cuts), (train, data))
    holdout = tuned_model.transform(test).withColumn("_pred_raw", F.expm1("prediction"))
    ev = regression_metrics(holdout, "charges", "_pred_raw").first().asDict()
    evaluation = {"model_name": best["model_name"], "mae": ev["mae"], "rmse": ev["rmse"], "r2": ev["r2"],
                  "cv_r2_mean": best["cv_r2_mean"], "cv_r2_std": best["cv_r2_std"]}
    data.unpersist()
    return CostModel(model=final, model_name=best["model_name"], tiers=tiers, evaluation=evaluation,
                     selection=[r.asDict() for r in sel])
