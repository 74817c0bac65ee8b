import math

import numpy as np

from halcyon.llm import caps
from tests.llm.conftest import components_of


def test_recall_and_components(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24))
    rows = [(10 * k + j, (c + 0.1 * rng.standard_normal(24) * (j > 0)).tolist()) for k, c in enumerate(centres) for j in range(6)]
    rows += [(1000 + j, rows[0][1]) for j in range(40)]                      # copies
    rows += [(2000, (np.array(rows[0][1]) * 7.5).tolist()), (3000, None), (3001, [0.0] * 24), (3002, [math.inf] * 24), (3003, []), (3004, [1.0, 2.0]), (3005, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: r for r in caps.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if v and np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for i, v in good for j, w in good if i < j and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.9]
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = sum(r.n_links for r in got.values())
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    want = components_of(links, degree)
    assert sum(got[i].component_id != want[i] for i in want) <= 2
    assert all(got[i].kept == (i == got[i].component_id) for i in got)
    assert all(got[i].n_links == 0 for i in (3000, 3001, 3002, 3003)) and got[3005].component_id == 3004


def test_decode_finds_every_filter():
    c = caps.Code(8, 200, 0.9)
    x = np.random.default_rng(1).standard_normal((20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, name = c.decode(x, 0.3)
    turned = x @ c.turn
    want = set()
    for i in range(20):
        p = [turned[i, a:b] @ d for a, b, d in c.blocks]
        for j in range(c.size ** len(p)):
            digits = [j // c.size ** (len(p) - 1 - k) % c.size for k in range(len(p))]
            if sum(q[d] for q, d in zip(p, digits)) >= 0.3:
                want.add((i, j))
    assert set(zip(row.tolist(), name.tolist())) == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert caps.near_duplicates(df).count() == 0
