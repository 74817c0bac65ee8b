"""Connected components of an undirected link table, as joins and aggregates only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from halcyon.llm.common import staged


#: link tables of up to so many rows (16 bytes each) are solved by union-find in one task; larger ones by stars
TASK_LINKS = 200_000


def _union_find(rows: pa.Table) -> pa.Table:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in zip(rows.column("u").to_pylist(), rows.column("v").to_pylist()):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([root(x) for x in nodes], pa.int64())})


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], r[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node (long) of ``links``; component is the smallest node reachable.

    Beyond ``TASK_LINKS`` links: alternating large-star / small-star steps: each step hangs every node's
    neighbours onto its smallest one, and the link table (never longer than
    the input plus its nodes) is written to the shared checkpoint folder.  The
    smallest neighbour is a map-side combined aggregate and the join back to
    it can be split, so a node with a third of all links is no single task.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = staged(edges)
    state = _state(edges)
    if state[0] <= TASK_LINKS:
        return edges.groupBy(F.lit(0).alias("all")).applyInArrow(_union_find, "node long, component long")
    return _stars(edges, state)


def _stars(edges: DataFrame, state: tuple) -> DataFrame:
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small)
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    centres = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres.join(stars, "u", "left_anti")).withColumnRenamed("u", "node")
