import fractions
import math
import random

from halcyon.llm import topk


def test_against_brute_force(spark):
    random.seed(1)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(3)]) for i in range(300)]
    rows += [(5, [1.0, 2.0, 3.0]), (300, None), (400, [None, 1.0, 2.0]), (500, [math.nan] * 3), (None, [1.0] * 3), (600, []), (601, []),
             (900, [1e306, -1e306, 0.1]), (901, [3e307, 1e300, 0.3]), (902, [-1.7e308, 5.0, 0.1]), (700, [1e30, 1.0, 2.0]), (701, [-1e30, 1.0, 2.0]), (800, [1.0, 2.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df.where("vec_id % 100 = 0"), df, query_rows=2, shard_rows=7, fan=2).collect()
    ok = [(i, [math.floor(1024 * fractions.Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in [x for x in ok if x[0] % 100 == 0]:
        best = sorted((-max(min(sum(a * b for a, b in zip(v, w)), 2 ** 63 - 1), -2 ** 63), j) for j, w in ok if j != q and len(w) == len(v))[:10]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
