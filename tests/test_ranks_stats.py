import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halcyon.operators import ranks as K
from halcyon.operators import stats as T


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(100, 15, 3000), 1)
    vals[:1000] = 42.0            # one value holds a third of all rows
    grp = np.where(np.arange(3000) % 3 == 0, "a", "b")
    pdf = [(int(i), str(g), float(v)) for i, (g, v) in enumerate(zip(grp, vals))]
    return spark.createDataFrame(pdf, "id long, g string, v double"), vals, grp


def test_cumulative_counts_exact(skewed):
    df, vals, _ = skewed
    cc = {r["v"]: (r["n"], r["cum_n"], r["tot_n"]) for r in K.cumulative_counts(df, "v", rows=20).collect()}
    for v in np.unique(vals)[::37]:
        n, cum, tot = cc[float(v)]
        assert n == int((vals == v).sum())
        assert cum == int((vals <= v).sum())
        assert tot == len(vals)


@pytest.mark.parametrize("qs", [[0.25, 0.5, 0.75, 0.9], [0.0, 0.05, 1.0]])
def test_quantiles_match_numpy(skewed, qs):
    df, vals, _ = skewed
    got = K.quantiles(df, "v", qs).first()
    for q in qs:
        assert got[f"q{int(round(q * 100))}"] == pytest.approx(float(np.percentile(vals, q * 100)), abs=1e-9)


def test_grouped_quantiles(skewed):
    df, vals, grp = skewed
    rows = {r["g"]: r for r in K.quantiles(df, "v", [0.5, 0.9], by=["g"]).collect()}
    for g in ("a", "b"):
        assert rows[g]["q50"] == pytest.approx(float(np.percentile(vals[grp == g], 50)))
        assert rows[g]["q90"] == pytest.approx(float(np.percentile(vals[grp == g], 90)))


@pytest.mark.parametrize("rows", [3, 40, 5000])
def test_ranges_are_cut_until_they_are_small(spark, rows):
    """Nearly unique values, most of them in one small interval: ranges stay under the limit and running sums stay exact."""
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(0, 1e-7, 2500), rng.uniform(-1e6, 1e6, 500), [5.0] * 300])
    grp = np.where(rng.random(len(vals)) < 0.9, "a", "b")
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(grp, vals)], "g string, v double")
    counts = K.cut_lineage(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")))
    keyed, ranges = K.with_ranges(counts, "v", ["g"], rows)
    sizes = keyed.groupBy("g", "_b").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert max(r.m for r in sizes) <= rows and len(sizes) <= ranges
    for g in "ab":
        mine = sorted((r["_b"], r.lo, r.hi) for r in sizes if r.g == g)
        assert all(x[2] < y[1] for x, y in zip(mine, mine[1:]))
    for r in K.cumulative_counts(df, "v", by=["g"], rows=rows).collect()[::41]:
        mine = vals[grp == r.g]
        assert (r.n, r.cum_n, r.tot_n) == ((mine == r.v).sum(), (mine <= r.v).sum(), len(mine))


def test_rank_of_values_that_were_not_seen(spark, skewed):
    df, vals, _ = skewed
    levels = K.rank_levels(df, "v")
    assert len(levels) <= 1001
    new = [(k, float(v)) for k, v in enumerate([-1e9, 41.99, 42.0, 42.01, 1e9, *np.random.default_rng(1).normal(100, 20, 200)])] + [(999, None)]
    new = spark.createDataFrame(new, "id long, v double")
    got = {r.id: r.r for r in new.select("id", K.rank_of(F.col("v"), levels).alias("r")).collect()}
    brute = {r.id: r.percentile_rank for r in K.percentile_rank(df, new, "v").collect()}
    assert got == brute and got[999] is None and got[0] == 0.0 and got[4] == 100.0
    assert all(got[r.id] == round(100.0 * float((vals <= r.v).mean()), 1) for r in new.collect() if r.v is not None)
    assert new.select(K.rank_of(F.col("v"), []).alias("r")).first().r is None


def test_percentile_rank_brute_force(spark, skewed):
    df, vals, _ = skewed
    ref = df.where(F.col("id") % 2 == 0)
    new = df.where(F.col("id") % 2 == 1)
    got = {r["id"]: r["percentile_rank"] for r in K.percentile_rank(ref, new, "v").collect()}
    rv = vals[0::2]
    for i in range(1, 3000, 98):   # odd ids are the scored half
        assert got[i] == round(100.0 * float((rv <= vals[i]).mean()), 1)


def test_ks_statistic(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0, 1, 800), 2), np.round(rng.normal(0.3, 1.2, 600), 2)
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    d = T.feature_drift(ref, cur, ["x"]).first()["ks_statistic"]
    grid = np.union1d(a, b)
    brute = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert d == pytest.approx(brute, abs=1e-12)


def test_auc_with_ties(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.9, 0.7, 0.4, 0.4, 0.1, 0.8, 0.3]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    got = T.auc(df, "y", "s").first()["roc_auc"]
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(brute)


def test_t_test_closed_form(spark):
    rng = np.random.default_rng(11)
    c, t = rng.normal(10, 2, 300), rng.normal(10.4, 2.5, 250)
    rows = [("c", float(x)) for x in c] + [("t", float(x)) for x in t]
    df = spark.createDataFrame(rows, "variant string, m double")
    r = T.ab_test(df, "variant", "m", "c", "t").first()
    sp2 = ((len(c) - 1) * c.var(ddof=1) + (len(t) - 1) * t.var(ddof=1)) / (len(c) + len(t) - 2)
    tt = (c.mean() - t.mean()) / math.sqrt(sp2 * (1 / len(c) + 1 / len(t)))
    assert r["t_stat"] == pytest.approx(tt, rel=1e-9)
    d = (t.mean() - c.mean()) / math.sqrt((c.var(ddof=1) + t.var(ddof=1)) / 2)
    assert r["effect_size"] == pytest.approx(d, rel=1e-9)


@pytest.mark.parametrize("t,dof,p", [(2.0, 10, 0.07338803), (1.0, 5, 0.36321748), (3.5, 100, 0.00069643)])  # values from numerical integration of the t density
def test_student_t_p_value(t, dof, p):
    assert T.t_two_sided_p(t, dof) == pytest.approx(p, rel=1e-5)


def test_kolmogorov_sf_monotone():
    vals = [T.kolmogorov_sf(d, 400.0) for d in (0.01, 0.05, 0.1, 0.2)]
    assert vals == sorted(vals, reverse=True) and 0.0 <= vals[-1] <= vals[0] <= 1.0
    # lambda = sqrt(400) * D = 1.3581 is the 5 % critical value of the Kolmogorov distribution
    assert T.kolmogorov_sf(1.3581 / 20.0, 400.0) == pytest.approx(0.05, abs=2e-4)


def test_min_sample_size(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (0.2,)], "d double")
    got = [r["n"] for r in df.select(T.min_sample_size(F.col("d")).alias("n")).collect()]
    z = 1.959963984540054 + 0.8416212335729143
    assert got == [math.ceil((z / 0.5) ** 2), 0, math.ceil((z / 0.2) ** 2)]


def test_class_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "y string, p string")
    rep = {r["cls"]: r for r in T.class_report(df, "y", "p").collect()}
    assert rep["a"]["precision"] == pytest.approx(0.5) and rep["a"]["recall"] == pytest.approx(0.5)
    assert rep["b"]["precision"] == pytest.approx(2 / 3) and rep["b"]["recall"] == pytest.approx(1.0)
    assert rep["c"]["f1"] == 0.0
    s = T.class_summary(T.class_report(df, "y", "p")).first()
    assert s["accuracy"] == pytest.approx(3 / 5)


def test_approx_quantiles_close(skewed):
    df, vals, _ = skewed
    got = K.quantiles(df, "v", [0.5, 0.9], exact=False).first()
    n = len(vals)
    for q, name in ((0.5, "q50"), (0.9, "q90")):
        rank = (vals <= got[name]).sum()
        assert abs(rank - q * n) <= 0.01 * n + 1000  # a third of the rows share one value


def test_percentile_rank_of_doubles_moves_no_scored_row(spark):
    ref = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 5.0, None, float("nan"))], "v double")
    new = spark.createDataFrame([(i, v) for i, v in enumerate((0.5, 1.0, 2.0, 3.0, 9.0, None, float("nan"), 2.0))], "id int, v double")
    got = K.percentile_rank(ref, new, "v")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.percentile_rank for r in got.collect()} == {0: 0.0, 1: 20.0, 2: 60.0, 3: 60.0, 4: 80.0, 5: None, 6: 100.0, 7: 60.0}
    empty = K.percentile_rank(ref.limit(0), new, "v")
    assert all(r.percentile_rank is None for r in empty.collect())


def test_cuts_of_one_range_are_a_constant(spark):
    counts = spark.range(3000).selectExpr("cast(id * 7 % 3000 AS double) AS v", "1L AS n")
    keyed, ranges = K.with_ranges(counts, "v", [], 100)
    sizes = {r._b: r for r in keyed.groupBy("_b").agg(K.F.count("*").alias("n"), K.F.min("v").alias("lo"), K.F.max("v").alias("hi")).collect()}
    assert len(sizes) <= ranges and max(r.n for r in sizes.values()) <= 100 and sum(r.n for r in sizes.values()) == 3000
    order = [sizes[b] for b in sorted(sizes)]
    assert all(a.hi < b.lo for a, b in zip(order, order[1:]))
