"""Closed forms of the cost model's selection: ridge from fold matrices, boosted prefixes."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from halcyon.operators import cost as C


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(77)
    x = rng.uniform(-2, 2, size=(240, 4))
    y = 3 + x @ np.array([1.5, -2.0, 0.0, 0.7]) + np.sin(3 * x[:, 2]) + rng.normal(0, 0.3, 240)
    rows = [(i, i % 4, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "claim_key long, fold int, log_charges double, a double, b double, c double, d double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).repartition(3).cache(), x, y


def test_ridge_scores_equal_numpy(data):
    df, x, y = data
    got = C.ridge_cv(C.fold_moments(df, 4), [0.1, 1.0, 10.0])
    fold = np.arange(240) % 4
    for alpha, scores in zip([0.1, 1.0, 10.0], got):
        for f, r2 in enumerate(scores):
            xt, yt, xv, yv = x[fold != f], y[fold != f], x[fold == f], y[fold == f]
            xc, yc = xt - xt.mean(0), yt - yt.mean()
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
            p = yt.mean() + (xv - xt.mean(0)) @ w
            assert r2 == pytest.approx(1 - ((yv - p) ** 2).sum() / ((yv - yv.mean()) ** 2).sum(), rel=1e-9)


def test_prefix_of_a_boosted_model_is_the_shorter_model(data):
    df, _, _ = data
    est = GBTRegressor(featuresCol="features", labelCol="log_charges", seed=1, maxBins=16)
    got = C.boosted_cv(est, [4, 9], [{"maxDepth": 2, "stepSize": 0.3}], df, 4, 4)
    for n in (4, 9):
        for f in range(4):
            model = est.copy({est.maxIter: n, est.maxDepth: 2, est.stepSize: 0.3}).fit(df.where(F.col("fold") != f))
            valid = model.transform(df.where(F.col("fold") == f))
            r2 = RegressionEvaluator(labelCol="log_charges", metricName="r2").evaluate(valid)
            assert got[0, n][f] == pytest.approx(r2, rel=1e-9)


FEW = C.Protocol(boost_trees=5, boost_sizes=(3, 6), forest_trees=4, forest_sizes=(2, 4), forest_depths=(None, 3))


@pytest.mark.parametrize("protocol, winner", [(C.Protocol(boost_trees=1, forest_trees=20, forest_sizes=(10, 20), alpha=1e6), "RandomForest"),
                                              (C.Protocol(boost_trees=60, boost_sizes=(40, 80), forest_trees=1, alpha=1e6), "GradientBoosting"), (FEW, "Ridge")])
def test_winner_is_tuned_saved_and_loaded(spark, data, tmp_path, protocol, winner):
    df, x, _ = data
    y = F.signum("a") * 2 + F.signum("b") if winner != "Ridge" else F.col("a")
    df = df.withColumn("log_charges", F.lit(7.0) + y).withColumn("charges", F.expm1("log_charges"))
    m = C.fit_cost(df, protocol)
    assert m.model_name == winner and m.evaluation["r2"] > 0.9
    assert {r["model_name"] for r in m.selection} == {"GradientBoosting", "RandomForest", "Ridge"}
    m.save(spark, str(tmp_path / "model"))
    again = C.CostModel.load(spark, str(tmp_path / "model"))
    cols = ["claim_key", "predicted_cost", "ci_lower", "ci_upper", "cost_tier", "model_used"]
    assert sorted(again.predict(df).select(cols).collect()) == sorted(m.predict(df).select(cols).collect())
    assert (again.evaluation, again.selection, again.tiers) == (m.evaluation, m.selection, m.tiers)
    assert m.feature_weights(spark, list("abcd")).first()["feature"] == "a"


def test_many_rows_take_the_scanning_way(data, monkeypatch):
    df, _, _ = data
    monkeypatch.setattr(C.T, "BOOST_ROWS", 10)
    got = C._boosting_cv(*C._folds(df, 3), 3, [(2, 0.3)], [2, 4])
    assert set(got) == {(0, 2), (0, 4)} and all(len(v) == 3 for v in got.values())
    assert hasattr(C.fit_named("GradientBoosting", (3, 2, 0.3), df), "trees")
