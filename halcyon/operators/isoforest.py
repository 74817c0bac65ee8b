"""Isolation forest (M9-M11, W1, A8-A10): not in MLlib, so built from Spark
pieces with every step bounded independently of the table size.

Fit
  1. one hash per row keeps ~c*T*m candidate rows (c = 2, T trees, m = 256);
  2. only those candidates are exploded over the T trees and kept with a
     second per-(row, tree) hash, ~c*m rows per tree, overlapping across trees
     like independent sub-samples;
  3. per tree the m rows with the smallest hash are kept (a window over at
     most ~c*m rows) and ``groupBy(tree).applyInPandas`` grows one isolation
     tree per group (random feature, uniform split, height limit ceil(log2 m));
  4. the node table has at most T * (2m - 1) rows — a proven bound — and is
     collected once as the fitted model.
Score
  an Arrow ``pandas_udf`` walks every tree for a batch of rows at once
  (numpy, one level per step); anomaly score s = 2^(-E[h]/c(m)); the
  decision value is -s minus its ``contamination`` training quantile
  (computed with the distributed exact quantiles), anomaly when < 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halcyon.operators.modeling import SEED, hash_unit
from halcyon.operators.ranks import global_quantiles, percentile_rank
from halcyon.session import cut_lineage

# ---- fixed values: flag texts -------------------------------------------------
REASON_NORMAL = "Normal claim pattern"
REASON_UNUSUAL = "Unusual claim pattern — review recommended"
REASON_SEVERE = "Severely anomalous — multiple KPIs far from population norm"
# -----------------------------------------------------------------------------

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, leaf_value double"


def avg_path_length(n: float) -> float:
    """c(n): mean path length of an unsuccessful BST search (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    feat, thr, left, right, leaf = [], [], [], [], []

    def new_node():
        for a in (feat, thr, left, right, leaf):
            a.append(0)
        return len(feat) - 1

    root = new_node()
    stack = [(root, np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        sub = x[idx]
        split_feat = -1
        if depth < limit and len(idx) > 1:
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            movable = np.flatnonzero(hi > lo)
            if len(movable):
                split_feat = int(rng.choice(movable))
        if split_feat < 0:
            feat[node], thr[node], left[node], right[node] = -1, 0.0, -1, -1
            leaf[node] = depth + avg_path_length(len(idx))
            continue
        t = float(rng.uniform(sub[:, split_feat].min(), sub[:, split_feat].max()))
        go_left = sub[:, split_feat] < t
        ln, rn = new_node(), new_node()
        feat[node], thr[node], left[node], right[node], leaf[node] = split_feat, t, ln, rn, 0.0
        stack.append((rn, idx[~go_left], depth + 1))
        stack.append((ln, idx[go_left], depth + 1))
    return feat, thr, left, right, leaf


def _build_tree(pdf: pd.DataFrame, seed: int, m: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = np.vstack(pdf["x"].to_numpy()).astype("float64")
    limit = int(math.ceil(math.log2(max(min(m, len(x)), 2))))
    rng = np.random.default_rng(seed * 1_000_003 + tree)
    feat, thr, left, right, leaf = _grow(x, rng, limit)
    n = len(feat)
    return pd.DataFrame({"tree": np.full(n, tree, dtype="int32"), "node": np.arange(n, dtype="int32"),
                         "feature": np.asarray(feat, dtype="int32"), "threshold": np.asarray(thr, dtype="float64"),
                         "left": np.asarray(left, dtype="int32"), "right": np.asarray(right, dtype="int32"),
                         "leaf_value": np.asarray(leaf, dtype="float64")})


def flag_reason(decision: Column, is_anomaly: Column, severe: float) -> Column:
    """The text that goes with a decision value (M11): severe below the 2 % quantile of the training values."""
    return F.when(~is_anomaly, F.lit(REASON_NORMAL)).when(decision < F.lit(severe), F.lit(REASON_SEVERE)).otherwise(F.lit(REASON_UNUSUAL))


def severe_limit(train: DataFrame, decision: str = "decision") -> float:
    return float(global_quantiles(train, decision, [0.02], names=["q"])["q"])


def train_statistics(train: DataFrame, decision: str = "decision", flag: str = "is_anomaly") -> DataFrame:
    """Rows, anomalies, their rate % and the mean and population std of the decision values (A10)."""
    n = F.count(F.lit(1))
    hits = F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0).cast("long"))
    return train.agg(n.alias("n"), hits.alias("n_anomalies"), F.coalesce(F.try_divide(F.lit(100.0) * hits, n), F.lit(0.0)).alias("anomaly_rate_pct"),
                     F.avg(decision).alias("score_mean"), F.stddev_pop(decision).alias("score_std"))


def _as_array(col: str) -> Column:
    return vector_to_array(col)


@dataclass
class IsolationForest:
    forest: dict                    # tree -> dict of numpy arrays
    sample_size: int
    contamination: float
    offset: float = 0.0             # contamination quantile of -s on training rows
    severe: float = 0.0             # 2 % quantile of training decision values
    train_stats: dict = field(default_factory=dict)

    def to_state(self) -> dict:
        """All fitted numbers (at most trees x (2 sample - 1) nodes)."""
        return {"trees": {str(t): {k: v.tolist() for k, v in a.items()} for t, a in self.forest.items()}, "sample_size": self.sample_size,
                "contamination": self.contamination, "offset": self.offset, "severe": self.severe, "train_stats": self.train_stats}

    @classmethod
    def from_state(cls, s: dict) -> "IsolationForest":
        return cls({int(t): {k: np.array(v) for k, v in a.items()} for t, a in s["trees"].items()}, s["sample_size"], s["contamination"],
                   s["offset"], s["severe"], s["train_stats"])

    def _path_udf(self):
        trees = [self.forest[t] for t in sorted(self.forest)]
        c_m = avg_path_length(self.sample_size)

        @F.pandas_udf("double")
        def score(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype="float64")
            x = np.vstack(xs.to_numpy()).astype("float64")
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for t in trees:
                node = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = t["feature"][node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    fi = np.where(inner, f, 0)
                    go_left = x[rows, fi] < t["threshold"][node]
                    nxt = np.where(go_left, t["left"][node], t["right"][node])
                    node = np.where(inner, nxt, node)
                total += t["leaf_value"][node]
            mean_h = total / len(trees)
            return pd.Series(np.power(2.0, -mean_h / c_m) if c_m > 0 else np.full(len(x), 0.5))
        return score

    def raw_score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """anomaly score s in (0, 1]; higher = more isolated."""
        return df.withColumn("_s", self._path_udf()(_as_array(features)))

    def decision(self, df: DataFrame, features: str = "features") -> DataFrame:
        """decision value (-s - offset) and the anomaly flag."""
        s = self.raw_score(df, features)
        return s.withColumn("decision", -F.col("_s") - F.lit(self.offset)).drop("_s") \
            .withColumn("is_anomaly", F.col("decision") < 0)

    def predict(self, df: DataFrame, train_scores: DataFrame, features: str = "features") -> DataFrame:
        """is_anomaly, anomaly_score (4 dp), percentile_rank against the
        training decision values, flag_reason (M10, M11, W1)."""
        d = self.decision(df, features)
        d = d.withColumn("flag_reason", flag_reason(F.col("decision"), F.col("is_anomaly"), self.severe)).withColumn("anomaly_score", F.round("decision", 4))
        return percentile_rank(train_scores, d, "decision")


def sample_for_trees(df: DataFrame, key: list[str], features: str, n: int, n_trees: int, m: int,
                     seed: int, oversample: float = 2.0) -> DataFrame:
    """(tree, x) rows: at most m per tree, chosen by hashes of the key."""
    q = min(1.0, oversample * m * n_trees / max(n, 1))
    r = min(1.0, oversample * m / max(q * n, 1.0))
    cand = df.where(hash_unit(key, seed, salt=1) < q).select(*key, _as_array(features).alias("x"))
    ex = cand.select(*key, "x", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    ex = ex.withColumn("_u", F.xxhash64(*[F.col(k) for k in key], F.col("tree"), F.lit(seed))) \
        .where(F.pmod(F.col("_u"), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30)) < F.lit(r))
    w = Window.partitionBy("tree").orderBy("_u", *key)
    return ex.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= m).select("tree", "x")


def fit_isolation_forest(df: DataFrame, key: list[str], features: str = "features", n_trees: int = 100,
                         max_samples: int = 256, contamination: float = 0.05,
                         seed: int = SEED) -> tuple[IsolationForest, DataFrame]:
    """Fit on ``df`` (M9).  Returns the model and the training rows with their
    decision values (the reference distribution for percentile ranks)."""
    n = df.count()
    m = min(max_samples, n)
    smp = sample_for_trees(df, key, features, n, n_trees, m, seed)
    nodes = smp.groupBy("tree").applyInPandas(lambda p: _build_tree(p, seed, m), NODE_SCHEMA)
    pdf = nodes.toPandas()   # bounded: n_trees * (2m - 1) rows
    forest = {}
    for t, g in pdf.groupby("tree"):
        g = g.sort_values("node")
        forest[int(t)] = {c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "leaf_value")}
    model = IsolationForest(forest=forest, sample_size=m, contamination=contamination)
    raw = cut_lineage(model.raw_score(df.select(*key, features), features).drop(features))
    model.offset = float(global_quantiles(raw.withColumn("_neg", -F.col("_s")), "_neg", [contamination],
                                          names=["q"])["q"])
    train = raw.withColumn("decision", -F.col("_s") - F.lit(model.offset)).drop("_s") \
        .withColumn("is_anomaly", F.col("decision") < 0)
    model.severe = severe_limit(train)
    model.train_stats = train_statistics(train).first().asDict()
    return model, train
