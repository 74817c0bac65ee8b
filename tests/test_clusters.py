"""All k-means fits by shared passes: equal to separate fits and to a plain Lloyd iteration."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from halcyon.operators import clusters as C


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 1.0, size=(90, 3)) for c in ((0, 0, 0), (6, 0, 1), (0, 7, -3))] + [np.full((30, 3), 2.0)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "claim_key long, a double, b double, c double")
    return VectorAssembler(inputCols=list("abc"), outputCol="features").transform(df).repartition(5), x


def lloyd(x, centres, limit, max_iter):
    passes = 0
    while True:
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        shift, centres, passes = ((new - centres) ** 2).sum(), new, passes + 1
        if shift <= limit or passes >= max_iter:
            return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), passes


def test_shared_passes_equal_separate_fits(spark, data):
    df, x = data
    jobs = [(2, 1), (3, 1), (3, 2), (5, 7), (1, 0)]
    together = C.fit_many(df, jobs)
    order = [r.claim_key for r in df.selectExpr("claim_key", "xxhash64(claim_key) AS h").orderBy("h", "claim_key").collect()]
    sample = x[order]
    for fit, (k, seed) in zip(together, jobs):
        alone = C.fit_many(df, [(k, seed)])[0]
        assert np.allclose(alone.centres, fit.centres) and alone.inertia == pytest.approx(fit.inertia) and alone.passes == fit.passes
        centres, inertia, passes = lloyd(x, C._plus_plus(sample, k, seed), C.TOLERANCE * x.var(0).mean(), C.MAX_ITER)
        assert np.allclose(centres, fit.centres) and inertia == pytest.approx(fit.inertia) and passes == fit.passes


def test_best_restart_and_assignment(data):
    df, x = data
    m = C.fit_kmeans(df, 3, n_init=4)
    assert m.inertia == min(f.inertia for f in C.fit_many(df, [(3, C.SEED + i) for i in range(4)]))
    rows = m.transform(df).collect()
    assert all(r.cluster_id == int(((m.centres - x[r.claim_key]) ** 2).sum(1).argmin()) for r in rows)
    sweep = {r.k: r for r in C.sweep_k(df, range(2, 5), n_init=3).collect()}
    assert sweep[3].inertia <= sweep[2].inertia and sum(r.is_optimal for r in sweep.values()) == 1


def test_more_clusters_than_rows_and_none(spark, data):
    df, _ = data
    assert C.fit_many(df.where("claim_key < 2"), [(4, 0)])[0].inertia == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        C.fit_many(df.limit(0), [(2, 0)])


def test_seed_rows_are_the_smallest_hashes_and_few_are_sent(spark):
    rows = spark.range(5000).selectExpr("id AS key", "array(cast(id AS double)) AS x").repartition(40).cache()
    want = [r.key for r in rows.selectExpr("key", "xxhash64(key) AS h").orderBy("h", "key").limit(50).collect()]
    got = C.seed_rows(rows, 5000, 50)
    assert [r.key for r in got.collect()] == want
    # not `most` rows from each of the 40 pieces: a task of the last step holds a part of about 100 rows that a bound leaves
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    # one key for all rows: its hash may be above the bound, and no row is lost
    same = rows.selectExpr("7L AS key", "x")
    assert C.seed_rows(same, 5000, 50).count() == 50
    assert C.seed_rows(same.limit(30), 30, 50).count() == 30
