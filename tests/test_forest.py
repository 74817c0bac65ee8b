"""Trees of any depth: equal to a brute-force tree, whatever the partitioning and wherever levels end and subtrees begin."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from halcyon.operators import forest as T


def brute_tree(bins, y, w, spec, ids, depth=None, level=0):
    """Recursive growth by its definition: (feature, bin, left, right) or a leaf value, in Python integers and exact scores."""
    rows = [i for i in range(len(y)) if w[i] > 0]
    tw, ts = sum(int(w[i]) for i in rows), sum(int(w[i]) * int(y[i]) for i in rows)
    leaf = ("leaf", ts / max(tw, 1))
    if len(rows) < spec.min_split or len({int(y[i]) for i in rows}) < 2 or level == depth:
        return leaf
    width = bins.shape[1]
    best = {}
    for f in range(width):
        for b in sorted({int(bins[i, f]) for i in rows})[:-1]:
            left = [i for i in rows if bins[i, f] <= b]
            lw, ls = float(sum(int(w[i]) for i in left)), float(sum(int(w[i]) * int(y[i]) for i in left))
            score = ls * ls / lw + (ts - ls) * (ts - ls) / (tw - lw)
            if f not in best or score > best[f][0]:
                best[f] = (score, b)
    if spec.features is not None:
        draw = T._mix(np.array([ids], dtype=np.uint64) ^ T._mix(np.arange(1, width + 1, dtype=np.uint64)))
        best = {f: best[f] for f in [f for f in np.argsort(draw, kind="stable").tolist() if f in best][:spec.features]}
    if not best:
        return leaf
    f = min(best, key=lambda f: (-best[f][0], f))
    b = best[f][1]
    right = bins[:, f] > b
    lid, rid = (x[0] for x in T.child_ids(np.array([ids], dtype=np.uint64)))
    return (f, b, brute_tree(bins, y, np.where(right, 0, w), spec, lid, depth, level + 1), brute_tree(bins, y, np.where(right, w, 0), spec, rid, depth, level + 1))


def walk(tree, row):
    while tree[0] != "leaf":
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[1]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(180, 3)), 1)
    y = np.round(x[:, 0] * 2 + np.abs(x[:, 1]) + (x[:, 2] > 0) * x[:, 0] + rng.normal(0, .1, 180), 3)
    rows = [(i, i % 3, float(t), 1.0 + i % 2, *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "claim_key long, fold int, label double, weight double, a double, b double, c double")
    return VectorAssembler(inputCols=list("abc"), outputCol="features").transform(df)


def local(data, weight=None):
    b = T.bin_rows(data, ["claim_key"], "label", weight=weight, fold="fold")
    rows = sorted(b.rows.collect())
    bins = np.stack([np.frombuffer(r.bins, dtype=np.uint8) for r in rows])
    return b, np.array([r.h for r in rows]), np.array([r.fold for r in rows]), np.array([r.y for r in rows]), np.array([r.cw for r in rows]), bins


@pytest.mark.parametrize("features, min_split, weight, depth", [(None, 2, None, None), (2, 6, "weight", None), (1, 2, None, 3)])
@pytest.mark.parametrize("local_rows", [10_000, 40, 5])
def test_forest_equals_brute_force(data, features, min_split, weight, depth, local_rows):
    b, h, _, y, cw, bins = local(data, weight)
    spec = T.Spec(3, min_split, features, seed=9)
    model = T.fit_forest(b, spec, depth, local_rows)
    expected = 0
    for t in range(3):
        w = T.bootstrap_counts(h, spec.root(t)) * cw
        tree = brute_tree(bins, y, w, spec, spec.root(t), depth)
        expected = expected + np.array([b.mean + b.step * walk(tree, r) for r in bins]) / 3
    assert np.allclose(model._walk(bins, 0, 3), expected, rtol=1e-12)
    assert model.importances.sum() == pytest.approx(1) and len(model.roots) == 3


@pytest.mark.parametrize("local_rows", [10_000, 30])
def test_cross_validation_equals_brute_force(data, local_rows):
    b, h, fold, y, cw, bins = local(data)
    spec = T.Spec(4, seed=3)
    got = T.cv_forest(b, 3, spec, [2, 4], (None, 2), local_rows)
    label = b.mean + b.step * y
    for size in (2, 4):
        for depth in (None, 2):
            for f in range(3):
                out = fold == f
                p = np.zeros(out.sum())
                for t in range(size):
                    w = np.where(out, 0, T.bootstrap_counts(h, spec.root(t)) * cw)
                    tree = brute_tree(bins, y, w, spec, spec.root(t), depth)
                    p += np.array([b.mean + b.step * walk(tree, r) for r in bins[out]]) / size
                r2 = 1 - ((label[out] - p) ** 2).sum() / ((label[out] - label[out].mean()) ** 2).sum()
                assert got[size, depth][f] == pytest.approx(r2, rel=1e-9)


def test_same_trees_from_any_partitioning(data):
    spec = T.Spec(5, features=2, seed=1)
    cuts = T.feature_cuts(data)
    models = [T.fit_forest(T.bin_rows(d, ["claim_key"], "label", cuts=cuts), spec, None, n) for d, n in ((data.repartition(7), 50), (data.coalesce(1), 9999))]
    assert models[0].predict_array(np.ones((1, 3))) == models[1].predict_array(np.ones((1, 3)))
    assert sorted(models[0].value) == sorted(models[1].value)


def test_transform_save_and_load(spark, data, tmp_path, monkeypatch):
    model = T.fit_forest(T.bin_rows(data, ["claim_key"], "label"), T.Spec(6))
    rows = model.transform(data).collect()
    x = np.array([[r.a, r.b, r.c] for r in rows])
    assert np.allclose([r.prediction for r in rows], model.predict_array(x))
    assert 1 - np.var([r.label - r.prediction for r in rows]) / np.var([r.label for r in rows]) > 0.9
    model.save(spark, str(tmp_path / "m"))
    again = T.TreeEnsemble.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.predict_array(x), model.predict_array(x)) and np.array_equal(again.importances, model.importances)
    monkeypatch.setattr(T, "NODES_PER_CHUNK", 100)          # applied in several pieces
    again._shared.clear()
    assert len(again._chunks()) > 1
    assert np.allclose([r.prediction for r in again.transform(data).collect()], model.predict_array(x))


def test_constant_label_and_few_rows(spark, data):
    same = data.withColumn("label", F.lit(4.0))
    for n in (2, 10_000):
        assert T.fit_forest(T.bin_rows(same, ["claim_key"], "label"), T.Spec(2), None, n).predict_array(np.zeros((1, 3)))[0] == pytest.approx(4.0)
    one = data.limit(1)
    assert T.fit_boost(T.bin_rows(one, ["claim_key"], "label"), 3, 2, 0.1).predict_array(np.zeros((1, 3)))[0] == pytest.approx(one.first().label)


def brute_boost(bins, y, train, n_trees, depth, rate):
    value = np.full(len(y), y[train].mean())
    for _ in range(n_trees):
        rest = y - value

        def fit(rows, level):
            t, best = rows[train[rows]], None
            if level < depth:
                for f in range(bins.shape[1]):
                    for b in sorted(set(bins[t, f]))[:-1]:
                        lo, hi = t[bins[t, f] <= b], t[bins[t, f] > b]
                        s = rest[lo].sum() ** 2 / len(lo) + rest[hi].sum() ** 2 / len(hi)
                        if best is None or s > best[0] + 1e-9:
                            best = (s, f, b)
            if best is None or best[0] - rest[t].sum() ** 2 / len(t) <= 1e-12:
                step[rows] = rest[t].mean()
                return
            fit(rows[bins[rows, best[1]] <= best[2]], level + 1)
            fit(rows[bins[rows, best[1]] > best[2]], level + 1)

        step = np.zeros(len(y))
        fit(np.arange(len(y)), 0)
        value = value + rate * step
    return value


def test_boosting_equals_brute_force(data):
    b, _, fold, y, _, bins = local(data)
    label = b.mean + b.step * y
    got = T.cv_boost(b, 3, [(2, 0.3), (3, 0.1)], [3, 6])
    for s, (depth, rate) in enumerate([(2, 0.3), (3, 0.1)]):
        for size in (3, 6):
            for f in range(3):
                out = fold == f
                p = brute_boost(bins, label, ~out, size, depth, rate)[out]
                r2 = 1 - ((label[out] - p) ** 2).sum() / ((label[out] - label[out].mean()) ** 2).sum()
                assert got[s, size][f] == pytest.approx(r2, rel=1e-6)
    model = T.fit_boost(b, 6, 3, 0.1)
    assert np.allclose(model._walk(bins, 0, 6) + model.start, brute_boost(bins, label, np.ones(len(y), bool), 6, 3, 0.1), rtol=1e-6)


@pytest.mark.parametrize("features, min_split", [(None, 2), (2, 10)])
def test_histograms_and_sorted_rows_grow_the_same_tree(monkeypatch, features, min_split):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, [2, 5, 256, 256, 40], (2500, 5)).astype(np.uint8)
    y, w = rng.integers(-60, 60, 2500) + bins[:, 1].astype(int) * 9, rng.poisson(1, 2500) * 4096
    spec = T.Spec(1, min_split, features)
    plain = T._grow_levels(bins, y, w, spec, np.uint64(4))
    monkeypatch.setattr(T, "GROW_ROWS", 70)
    got = T.grow(bins, y, w, spec, np.uint64(4))
    assert plain.keys() == got.keys() and all(np.array_equal(plain[k], got[k]) for k in plain)
    # routed row by row to a cut depth
    for depth in (0, 3, 50):
        at = T.node_at(got, got["leaf"], depth)
        node = np.zeros(len(y), dtype=int)
        while len(go := np.flatnonzero((got["feature"][node] >= 0) & (got["depth"][node] < depth))):
            m = node[go]
            node[go] = got["left"][m] + (bins[go, got["feature"][m]] > got["bin"][m])
        assert np.array_equal(at, node)


def test_boosting_keeps_no_copy_of_the_rows_per_feature():
    import tracemalloc
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 256, (20_000, 20)).astype(np.uint8)
    tracemalloc.start()
    T.boost(bins, rng.normal(size=20_000), np.ones(20_000, dtype=bool), 2, 3, .1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * bins.size         # before: several arrays of 8 bytes a row and feature


def test_shipped_rows_carry_no_more_than_subtrees_need(data):
    b = T.bin_rows(data, ["claim_key"], "label", weight="weight", fold="fold")
    spec = T.Spec(2, seed=4)
    for folds, held in (([-2], False), ([0, 1, 2], True)):
        trees = T._upper_levels(b, folds, spec, 10_000)
        for r in T._ship(b, trees, spec, held).collect():
            out = np.frombuffer(r.held, dtype=bool)
            # a hash for held-out rows only, labels and weights of four bytes
            assert len(r.h) == 8 * out.sum() and len(r.y) == len(r.w) == 4 * len(out) and out.any() == held


def test_narrow_numbers_of_both_widths():
    parts = [np.array([1, -5]), np.array([2 ** 40, 3, -2 ** 31]), np.zeros(0, dtype=np.int64), np.array([-2 ** 31, 2 ** 31 - 1])]
    cells = [T._narrow(x) for x in parts]
    assert [len(c) for c in cells] == [8, 24, 0, 8]
    assert (T._widened(cells, [len(x) for x in parts]) == np.concatenate(parts)).all()


@pytest.mark.parametrize("features, min_split", [(None, 2), (2, 5)])
def test_features_of_two_bins_and_constant_ones_against_brute_force(features, min_split):
    rng = np.random.default_rng(6)
    for it in range(12):
        bins = np.stack([rng.integers(0, k, 60) for k in (2, 2, 1, 9, 3, 2)], axis=1).astype(np.uint8)
        bins[:, 5] = bins[:, 0]                                      # equal scores: the first feature counts
        y, w, spec = rng.integers(-9, 9, 60), rng.integers(0, 3, 60), T.Spec(1, min_split, features, seed=it)
        want, got = brute_tree(bins, y, w, spec, spec.root(0)), T.grow(bins, y, w, spec, spec.root(0))
        value = got["s"] / np.maximum(got["w"], 1)
        assert all(value[leaf] == walk(want, r) for leaf, r in zip(got["leaf"], bins))
