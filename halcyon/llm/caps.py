"""Embedding near-duplicates with spherical-cap filters from a random product code.

Filters.  The space is rotated at random and cut into blocks, each with a
random code of ``B`` directions; the sums of one direction from each block are the
filter directions.  A vector belongs to every filter whose inner product with it
exceeds the cap height.  List decoding finds these without looking at all
filters: it goes through the blocks, keeps the sums that the best remaining
directions could still lift over the height, and drops the rest.

Height.  Pairs drawn at random exactly at the cosine threshold are decoded with
the same code, and the height is the largest at which all but ``MISS`` of them
share a filter.  It depends on the dimension and the number of filters only.
The number of filters follows the number of vectors, so that a filter holds a
few unrelated vectors at any size.

Links.  Vectors meet in filters; pairs whose 256 sign bits are too far apart for
the threshold (7 standard deviations) are dropped in the join itself, distinct
pairs are verified by their cosine in double precision.  Equal vectors are one
class with a weight, so copies are never paired.  Components come from joins.

Defined results for odd input: null, zero and empty vectors, vectors with null
or non-finite components and rows without vec_id link with nothing (0 links,
their own component, kept); only vectors of the same length link; rows that
repeat a vec_id are one vector (its versions' links added up, smallest
component); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from halcyon.llm.common import staged, table
from halcyon.llm.components import connected_components
from halcyon.llm.topk import usable
from halcyon.plans.registry import register

COSINE = 0.9
#: share of pairs at the threshold that may share no filter
MISS = 0.0005
#: filters per vector of the table
DENSITY = 16
SIGNS = 256
#: directions in a block at most; more filters make more blocks
MOST = 4096
#: pairs drawn to fit the height
FIT_PAIRS = 2000


class Code:
    """The filters for one dimension."""

    def __init__(self, dim: int, filters: int, cosine: float, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        m = 1 if dim < 4 else max(2, math.ceil(math.log(filters) / math.log(MOST)))
        self.size = max(2, math.ceil(filters ** (1 / m)))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks, at = [], 0
        for part in np.array_split(np.arange(dim), m):
            c = rng.standard_normal((self.size, len(part)))
            c *= math.sqrt(len(part) / dim) / np.linalg.norm(c, axis=1, keepdims=True)
            self.blocks.append((at, at + len(part), c.T.copy()))
            at += len(part)
        self.planes = rng.standard_normal((dim, SIGNS))
        self.height = self._fit(rng, dim, cosine)

    def decode(self, unit: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row of ``unit`` exceeds."""
        x = unit @ self.turn
        *first, last = [x[:, a:b] @ c for a, b, c in self.blocks]
        rest, rests = last.max(axis=1), []
        for p in reversed(first):
            rests.append(rest)
            rest = rest + p.max(axis=1)
        row, name, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for p, later in zip(first, reversed(rests)):
            sums = total[:, None] + p[row]
            r, c = np.nonzero(sums >= (height - later[row])[:, None])
            row, name, total = row[r], name[r] * self.size + c, sums[r, c]
        # the last block is sorted (rows apart by an offset), so each sum's partners are a run of it
        order = np.argsort(-last, axis=1)
        ladder = (np.take_along_axis(-last, order, axis=1) + 4.0 * np.arange(len(x))[:, None]).ravel()
        n = np.searchsorted(ladder, total - height + 4.0 * row, side="right") - row * self.size
        n = np.clip(n, 0, self.size)
        kth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, name = np.repeat(row, n), np.repeat(name, n)
        return row, name * self.size + order[row, kth]

    def _fit(self, rng, dim: int, cosine: float) -> float:
        if dim == 1:
            return 0.5
        x = rng.standard_normal((FIT_PAIRS, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((FIT_PAIRS, dim))
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(1 - cosine ** 2) * y
        # caps only grow as the height sinks, so pairs that have met are done with
        height = min(1.0, 7 / math.sqrt(dim))
        while len(x) > MISS * FIT_PAIRS and height > 0:
            height -= 0.05 / math.sqrt(dim)
            met = np.zeros(len(x), dtype=bool)
            for a in range(0, len(x), 100):
                (rx, fx), (ry, fy) = self.decode(x[a:a + 100], height), self.decode(y[a:a + 100], height)
                span = self.size ** len(self.blocks)
                met[a + np.intersect1d(rx * span + fx, ry * span + fy) // span] = True
            x, y = x[~met], y[~met]
        return height


@functools.lru_cache(maxsize=8)
def code(dim: int, filters: int, cosine: float) -> Code:
    return Code(dim, filters, cosine)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of extreme values stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


_SPOT = "dim int, filter long, node long, s0 long, s1 long, s2 long, s3 long"


def _spots(filters: int, cosine: float):
    def run(batches):
        names = [x.split()[0] for x in _SPOT.split(", ")]
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                c = code(int(dim), filters, cosine)
                mine = b.filter(pa.array(dims == dim))
                for a in range(0, mine.num_rows, 256):
                    rows = mine.slice(a, 256)
                    unit, node = _unit(rows.column(1), int(dim)), rows.column(0).to_numpy()
                    row, name = c.decode(unit, c.height)
                    bits = np.packbits(unit @ c.planes > 0, axis=1).view(np.int64)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim, np.int32)), pa.array(name), pa.array(node[row]),
                                                      *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]], names=names)
    return run


def _verify(cosine: float):
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x, y = b.column(2), b.column(3)
            dims = np.diff(x.offsets.to_numpy())
            ok = np.zeros(b.num_rows, dtype=bool)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                u, v = _unit(x.take(pa.array(mine)), int(dim)), _unit(y.take(pa.array(mine)), int(dim))
                ok[mine] = np.einsum("ij,ij->i", u, v) >= cosine
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))
    return run


def cap_links(classes: DataFrame, cosine: float = COSINE, density: int = DENSITY) -> DataFrame:
    """The pairs (a, b) of the distinct vectors ``classes`` (node, v, dim) found with at least that cosine."""
    filters = max(4096, density * 2 ** math.ceil(math.log2(max(1, classes.count()))))
    spots = staged(classes.select("node", "v", "dim").mapInArrow(_spots(filters, cosine), _SPOT))
    turn = math.acos(min(1.0, cosine)) / math.pi
    far = math.ceil(SIGNS * turn + 7 * math.sqrt(SIGNS * turn * (1 - turn)))
    x, y = spots.alias("x"), spots.alias("y")
    differ = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(1, 4)),
                 F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    met = (F.col("x.filter") == F.col("y.filter")) & (F.col("x.dim") == F.col("y.dim"))
    pairs = (x.join(y, met & (F.col("x.node") < F.col("y.node")) & (differ <= far))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    both = (pairs.join(classes.select(F.col("node").alias("a"), F.col("v").alias("x")), "a")
            .join(classes.select(F.col("node").alias("b"), F.col("v").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(_verify(cosine), "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, density: int = DENSITY) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])
    classes = staged(rows.groupBy("v", "dim").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")))
    links = staged(cap_links(classes, cosine, density))
    found = connected_components(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("node").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("near")).withColumnRenamed("a", "node")
    classes = (classes.join(near, "node", "left").join(found, "node", "left")
               .select("v", (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c")))
    ids = rows.join(classes, "v").groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(ids, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


@register("op8_embedding_caps")
def op8_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
