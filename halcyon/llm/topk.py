"""Exact top-k search: tiled matrix products, partial selection, tree merging.

Vectors become integers ``floor(1024 * x)`` and a score is their integer inner
product.  Queries are dealt into blocks and candidates into shards by hash; a
tile is one block against one shard, a matrix product with a partial selection
of each query's ``k`` best.  A query's lists from all shards are merged as a
tree: ``FAN`` lists at a time, level by level, so no task sees more than
``FAN * k`` rows of a query at once, however many shards there are.

Blocks and shards hold about ``QUERY_ROWS`` and ``SHARD_ROWS`` rows at every
size; only their number grows.  The products are exact: doubles where every
partial sum stays below 2^53, else Python integers (scores beyond a long stop
at its ends).

Defined results for odd input: a null vector, a vector with null or non-finite
components and a null vec_id take no part; only vectors of the same length are
compared; an empty vector scores 0 against the empty ones; equal scores go to
the smaller vec_id; rows that repeat a vec_id are no candidates of each other,
and a repeated candidate is listed as often as it occurs; different vectors under
one query id are one query, whose list holds the best of all of them; a query with no
candidate has no row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from halcyon.llm.common import parts, table
from halcyon.plans.registry import register

K = 10
SCALE = 1024
QUERY_ROWS, SHARD_ROWS = 2048, 8192
#: lists merged at once
FAN = 32
_LIST = "query_id long, part long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), dim for the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(~F.coalesce(bad, F.lit(False))).withColumn("dim", F.size("v")))


def _matrix(column: pa.ChunkedArray, rows: int, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, dim)


def _whole(x: float) -> int:
    """floor(SCALE * x) of any finite double, also where the product is no double."""
    return int(x) * SCALE if abs(x) >= 2.0 ** 53 else math.floor(x * SCALE)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of floor(SCALE * x) of all rows of q with all rows of c."""
    with np.errstate(over="ignore"):
        a, b = np.floor(q * float(SCALE)), np.floor(c * float(SCALE))
        most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(q.shape[1], 1)
    if most < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[_whole(x) for x in r] for r in q.tolist()], dtype=object).reshape(q.shape)
    other = np.array([[_whole(x) for x in r] for r in c.tolist()], dtype=object).reshape(c.shape)
    info = np.iinfo(np.int64)
    return np.array([[min(max(x, info.min), info.max) for x in r] for r in (whole @ other.T)], dtype=np.int64).reshape(len(q), len(c))


def _tile(k: int):
    def run(key, queries: pa.Table, shard: pa.Table) -> pa.Table:
        out = {"query_id": [], "part": [], "vec_id": [], "score": []}
        if queries.num_rows and shard.num_rows:
            q_id, c_id = queries.column("vec_id").to_numpy(), shard.column("vec_id").to_numpy()
            dim = key[0].as_py()
            q, c = _matrix(queries.column("v"), len(q_id), dim), _matrix(shard.column("v"), len(c_id), dim)
            order = np.argsort(c_id, kind="stable")
            c, c_id = c[order], c_id[order]
            for a in range(0, len(q), 256):
                scores = _products(q[a:a + 256], c)
                for i, row in enumerate(scores):
                    mine = np.flatnonzero(c_id != q_id[a + i])
                    got = row[mine]
                    if len(mine) > k:
                        least = np.partition(got, len(got) - k)[len(got) - k]
                        above = got >= least
                        mine, got = mine[above], got[above]
                    best = mine[np.argsort(~got, kind="stable")[:k]]  # ~x orders as -x does and never overflows
                    out["query_id"].append(np.full(len(best), q_id[a + i]))
                    out["vec_id"].append(c_id[best])
                    out["score"].append(row[best])
                    out["part"].append(np.full(len(best), key[2].as_py()))
        flat = {n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for n, v in out.items()}
        return pa.table(flat)
    return run


def _best(lists: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS, fan: int = FAN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows of ``vectors`` for each distinct row of ``queries``."""
    queries, vectors = usable(queries).dropDuplicates(["vec_id", "v"]), usable(vectors)
    blocks, shards = parts(queries.count(), query_rows), parts(vectors.count(), shard_rows)
    deal = F.xxhash64("vec_id", "v")

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    tiles = (queries.withColumn("block", F.pmod(deal, F.lit(blocks))).withColumn("shard", every(shards)),
             vectors.withColumn("shard", F.pmod(deal, F.lit(shards))).withColumn("block", every(blocks)))
    keys = ["dim", "block", "shard"]
    lists = tiles[0].groupBy(*keys).cogroup(tiles[1].groupBy(*keys)).applyInArrow(_tile(k), _LIST)
    while shards > 1:
        shards = -(-shards // fan)
        # the window of a level is dealt by (query, part): each part merges at most `fan` lists of k rows
        lists = _best(lists.withColumn("part", F.floor(F.col("part") / fan).cast("long")), k).drop("rank")
    return _best(lists.withColumn("part", F.lit(0).cast("long")), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) e FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@register("op1_topk", ORACLE)
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)
