"""Risk segmentation by k-means.

* ``fit_many``: any number of fits (all restarts, all K) share every pass over the rows.  A pass assigns
  each row to its nearest centre in every fit that still moves, by one matrix product with all centres, and
  adds up counts, sums and squared distances per (fit, cluster), first within the task; fits x K rows come back.
  Starting centres are k-means++ draws on a bounded sample of rows (``SEED_ROWS`` with the smallest key hashes;
  the passes read all rows).
* ``fit_kmeans``: one K with ``n_init`` restarts, the lowest squared distance wins (ties: the first).
* ``silhouette``: mean Euclidean silhouette on a deterministic 500-row sample
  (hash-ordered top-k), computed in one bounded pandas group; the full-data
  squared-Euclidean silhouette of ``ClusteringEvaluator`` is reported too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halcyon.operators import segments as S
from halcyon.operators.modeling import SEED
from halcyon.session import cut_lineage

SILHOUETTE_SAMPLE = 500
#: rows from which starting centres are drawn, at most
SEED_ROWS = 10_000
#: rows that one task takes in a pass, about; beyond PASS_PIECES such tasks each takes LARGE_PASS_ROWS more, so that
#: what the driver notes about the tasks of all passes stays small
PASS_ROWS = 16_000
PASS_PIECES, LARGE_PASS_ROWS = 96, 250_000
#: tasks that send their rows with the smallest hashes to the driver
SEED_PIECES = 8
#: a fit ends when its centres move less than this share of the mean variance (sum of squared moves)
TOLERANCE, MAX_ITER = 1e-4, 300


@dataclass
class KMeansFit:
    centres: np.ndarray         # (k, features)
    inertia: float
    passes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.centres).argmin(1)

    def transform(self, df: DataFrame, features: str = "features", out: str = "cluster_id") -> DataFrame:
        """``df`` with the number of the nearest centre; works in batches and in streams."""
        fit = self

        @F.pandas_udf("int")
        def nearest(xs: pd.Series) -> pd.Series:
            return pd.Series(fit.nearest(np.vstack(xs.to_numpy()).astype(float)) if len(xs) else [], dtype="int32")
        return df.withColumn(out, nearest(vector_to_array(features)))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0.0)


def _plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each further centre is drawn in proportion to the squared distance from those before it."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = _distances(x, x[chosen[0]][None])[:, 0]
    while len(chosen) < k:
        total = near.sum()
        chosen.append(int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else int(rng.integers(len(x))))
        chosen[-1] = min(chosen[-1], len(x) - 1)
        near = np.minimum(near, _distances(x, x[chosen[-1]][None])[:, 0])
    return x[chosen]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def seed_rows(rows: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """The ``most`` rows (key, x) with the smallest key hashes of the ``n`` staged ``rows``.

    A hash bound leaves about twice as many first (all rows, if these are too few), so neither the tasks nor the driver hold ``most`` rows
    per piece of the table."""
    most = SEED_ROWS if most is None else most
    h, near = F.xxhash64("key"), rows
    if n > 4 * most:
        bound = int(-(1 << 63) + (1 << 64) * (2 * most / n))
        few = rows.where(h <= F.lit(bound).cast("long"))
        near = few if few.count() >= most else rows
    return near.repartition(SEED_PIECES).orderBy(h, "key").limit(most)


def fit_many(data: DataFrame, jobs: Sequence[tuple[int, int]], features: str = "features", key: str = "claim_key",
             max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> list[KMeansFit]:
    """One fit per (k, seed) in ``jobs``, all by the same passes."""
    # passes are short: few, larger pieces, whose number follows the rows only
    n = data.count()
    pieces = max(8, min(n // PASS_ROWS, PASS_PIECES + n // LARGE_PASS_ROWS))
    rows = cut_lineage(data.select(F.col(key).alias("key"), vector_to_array(features).alias("x")).coalesce(pieces))
    sample = seed_rows(rows, n).select("x").toPandas()["x"]      # bounded
    if not len(sample):
        raise ValueError("k-means needs at least one row")
    seeds = np.vstack(sample.to_numpy()).astype(float)
    width = seeds.shape[1]
    limit = tolerance * float(seeds.var(axis=0).mean())
    centres = [_plus_plus(seeds, k, seed) for k, seed in jobs]
    inertia, passes, moving = [0.0] * len(jobs), [0] * len(jobs), set(range(len(jobs)))
    schema = "job int, cluster int, n long, cost double, " + ", ".join(f"s{i} double" for i in range(width))

    def one_pass(active: list[int]) -> dict:
        now = [(j, centres[j]) for j in active]
        stacked = np.vstack([c for _, c in now])

        def add_up(batches):
            totals = [(np.zeros(len(c), dtype=np.int64), np.zeros(len(c)), np.zeros((len(c), width))) for _, c in now]
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b)
                d, at = _distances(x, stacked), 0
                for (n, cost, s), (_, c) in zip(totals, now):
                    mine = d[:, at:at + len(c)]
                    at += len(c)
                    near = mine.argmin(1)
                    n += np.bincount(near, minlength=len(c))
                    cost += np.bincount(near, mine[np.arange(len(x)), near], len(c))
                    member = np.zeros((len(x), len(c)))
                    member[np.arange(len(x)), near] = 1.0
                    s += member.T @ x
            for (n, cost, s), (j, c) in zip(totals, now):
                cols = [pa.array(np.full(len(c), j, dtype=np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n), pa.array(cost)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(s[:, i]) for i in range(width))], names=[f.split()[0] for f in schema.split(", ")])

        sums = rows.select("x").mapInArrow(add_up, schema).groupBy("job", "cluster").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect()
        return {(r["job"], r["cluster"]): r for r in sums}

    while moving:
        got = one_pass(sorted(moving))
        for j in sorted(moving):
            # a cluster without rows keeps its centre
            new = np.array([[got[j, c][f"s{i}"] / got[j, c]["n"] for i in range(width)] if got[j, c]["n"] else old for c, old in enumerate(centres[j])])
            shift, centres[j] = float(((new - centres[j]) ** 2).sum()), new
            passes[j] += 1
            if shift <= limit or passes[j] >= max_iter:
                moving.discard(j)
    for (j, _), r in one_pass(list(range(len(jobs)))).items():          # distances to the final centres
        inertia[j] += r["cost"]
    return [KMeansFit(c, i, p) for c, i, p in zip(centres, inertia, passes)]


def fit_kmeans(data: DataFrame, k: int = 4, n_init: int = 10, features: str = "features", seed: int = SEED, key: str = "claim_key") -> KMeansFit:
    """The best of ``n_init`` fits (seeds seed..seed+n_init-1)."""
    return min(fit_many(data, [(k, seed + i) for i in range(n_init)], features, key), key=lambda m: m.inertia)


def _silhouette_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.vstack(pdf["x"].to_numpy())
    lab = pdf["cluster_id"].to_numpy()
    if len(np.unique(lab)) < 2:
        return pd.DataFrame({"silhouette": [float("nan")], "n": [len(lab)]})
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0.0))
    s = np.zeros(len(lab))
    for i in range(len(lab)):
        same = lab == lab[i]
        n_same = same.sum() - 1
        if n_same == 0:
            continue
        a = d[i, same].sum() / n_same
        b = min(d[i, lab == c].mean() for c in np.unique(lab) if c != lab[i])
        s[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return pd.DataFrame({"silhouette": [float(s.mean())], "n": [len(lab)]})


def silhouette(assigned: DataFrame, key: str = "claim_key", features: str = "features",
               sample: int = SILHOUETTE_SAMPLE, seed: int = SEED) -> DataFrame:
    """Mean Euclidean silhouette over a hash-ordered ``sample``-row sample
    (M14).  The sample is a distributed top-k, so only ``sample`` rows move;
    the quadratic part runs on that bounded group alone."""
    h = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    smp = assigned.select(h.alias("_h"), F.col("cluster_id"), vector_to_array(features).alias("x")) \
        .orderBy("_h").limit(sample).withColumn("_g", F.lit(0))
    return smp.groupBy("_g").applyInPandas(lambda p: _silhouette_pdf(p), "silhouette double, n long")


def silhouette_sq(assigned: DataFrame, features: str = "features") -> float:
    """Full-data silhouette with squared Euclidean distance (ClusteringEvaluator)."""
    return ClusteringEvaluator(featuresCol=features, predictionCol="cluster_id").evaluate(assigned)


def sweep_k(data: DataFrame, ks=range(2, 9), n_init: int = 10, key: str = "claim_key") -> DataFrame:
    """inertia and sampled silhouette per K (M13); all restarts of all K are fitted together."""
    ks = list(ks)
    jobs = [(k, SEED + i) for k in ks for i in range(n_init)]
    fits = fit_many(data, jobs, key=key)
    best = {k: min((f for f, (kk, _) in zip(fits, jobs) if kk == k), key=lambda m: m.inertia) for k in ks}
    rows = [(int(k), m.inertia, float(silhouette(m.transform(data.select(key, "features")), key).first()["silhouette"])) for k, m in best.items()]
    out = data.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
    top = max(rows, key=lambda r: r[2])[0]
    return out.withColumn("is_optimal", F.col("k") == F.lit(top))


@dataclass
class Segmentation:
    """Fitted k-means plus the fit-time cluster table (K rows: profile rank,
    label, size), so scoring new rows joins a bounded static table and also
    works inside a stream."""
    model: KMeansFit
    k: int
    clusters: list  # (cluster_id, charge_rank, risk_label, similar_members_count)

    def cluster_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.clusters, "cluster_id int, charge_rank int, risk_label string, "
                                                    "similar_members_count long")

    def to_state(self) -> dict:
        return {"centres": self.model.centres.tolist(), "inertia": self.model.inertia, "passes": self.model.passes, "k": self.k, "clusters": self.clusters}

    @classmethod
    def from_state(cls, s: dict) -> "Segmentation":
        return cls(KMeansFit(np.array(s["centres"]), s["inertia"], s["passes"]), s["k"], [tuple(c) for c in s["clusters"]])

    def assign(self, df: DataFrame) -> DataFrame:
        """cluster id, label, score = rank / (K - 1) * 10 (1 dp), size."""
        seg = self.model.transform(df)
        tbl = F.broadcast(self.cluster_table(df.sparkSession))
        out = seg.join(tbl, "cluster_id", "left")
        return out.withColumn("segment_risk_score",
                              F.round(F.col("charge_rank").cast("double") / F.lit(float(max(self.k - 1, 1)))
                                      * F.lit(10.0), 1))


def fit_segments(data: DataFrame, k: int = 4, n_init: int = 10) -> Segmentation:
    model = fit_kmeans(data, k, n_init)
    seg = model.transform(data)
    lab = S.labels(S.profiles(seg), S.RISK_LABELS if k <= len(S.RISK_LABELS) else
                   [f"Segment {i}" for i in range(k)])
    sizes = seg.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("similar_members_count"))
    rows = lab.join(sizes, "cluster_id").collect()   # K rows
    clusters = [(int(r["cluster_id"]), int(r["charge_rank"]), r["risk_label"], int(r["similar_members_count"]))
                for r in rows]
    return Segmentation(model=model, k=k, clusters=clusters)
