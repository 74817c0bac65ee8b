"""Trees of any depth over binned rows: forests and boosted models.

Rows are binned once (``bin_rows``: at most 256 bins a feature, 1 byte each).  A forest then grows in
two ways that choose the same splits:

* **Upper levels** of trees with more than ``local_rows`` rows: every pass over the rows adds up one histogram
  (rows, weight, label per feature and bin) for each of at most ``NODES_PER_PASS`` open nodes of all
  trees of all fits; the best split of a node is found where its histograms meet.  Only splits reach the driver.
* **Subtrees**: as soon as a node holds ``local_rows`` rows or fewer, these go to one group, keyed by (fit, tree,
  node), and the subtree is finished there, level by level, without a limit on its depth.

Labels and weights are fixed-point integers, so sums do not depend on the order of rows, and draws (bootstrap
counts, feature subsets) are hashes of the row, tree and node: the same trees come out of any partitioning
and any ``local_rows``.

All fits of a cross-validation grow at once.  A fit's held-out rows travel with the rows of its trees,
with weight 0, and come back with each tree's prediction, so no model of a fold leaves its group.  A tree
cut at a depth is the upper part of the deeper tree and a smaller forest is the beginning of
the larger one, so one fit serves all these grid points.

Boosting works on whole fits, which go to one group each up to ``BOOST_ROWS`` rows (see ``cost`` for the way beyond).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halcyon.session import cut_lineage

MAX_BINS = 256
LOCAL_ROWS = 1_000_000
#: rows of a node whose subtree a task grows by sorted rows, in the processor's caches; larger nodes split by histograms
GROW_ROWS = 40_000
#: open nodes whose histograms a task holds at once (about 135 KB each with 22 features)
NODES_PER_PASS = 400
#: rows whose boosted model one group fits
BOOST_ROWS = 1_000_000
#: rows of all trees that one task grows, about
ROWS_PER_TASK = 100_000
#: nodes broadcast together when a model is applied (about 15 bytes each)
NODES_PER_CHUNK = 5_000_000
#: weight 1 in fixed point, for rows with weights
WEIGHT_ONE = 1 << 12

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seeded(*parts: int) -> np.uint64:
    x = np.zeros(1, dtype=np.uint64)
    for p in parts:
        x = _mix(x * _U(3) + _U(p % (1 << 64)) + _U(0x9E3779B97F4A7C15))
    return x[0]


#: P(X <= k) of a Poisson variable with mean 1
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def bootstrap_counts(row: np.ndarray, tree_id: np.uint64) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1), from a hash of the row and the tree."""
    u = (_mix(row.view(np.uint64) ^ tree_id) >> _U(11)).astype(np.float64) / 2.0 ** 53
    return np.searchsorted(_POISSON, u, side="right").astype(np.int64)


def child_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return _mix(ids * _U(2) + _U(1)), _mix(ids * _U(2) + _U(2))


# ----------------------------------------------------------------------------- binned rows

@dataclass
class Binned:
    """``rows``: h (hash of the key), fold, y (fixed point), cw (class weight, fixed point), bins (one byte a feature)."""
    rows: DataFrame
    cuts: list
    n: int
    mean: float
    step: float          # a label is mean + y * step

    @property
    def width(self) -> int:
        return len(self.cuts)


def feature_cuts(df: DataFrame, features: str = "features", bins: int = MAX_BINS) -> list[list[float]]:
    """Per feature the increasing upper ends of all bins but the last, from mergeable quantile sketches (one pass)."""
    width = df.select(F.max(F.size(vector_to_array(features)))).first()[0] or 0

    def doubles(batches):                  # one column per feature, unpacked once
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width) if b.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(width)], names=[f"x{i}" for i in range(width)])

    if not width:
        return []
    rows = df.select(vector_to_array(features).alias("x")).mapInArrow(doubles, ", ".join(f"x{i} double" for i in range(width)))
    shares = [i / bins for i in range(1, bins)]
    row = rows.agg(*[F.percentile_approx(f"x{i}", shares, 10_000).alias(f"c{i}") for i in range(width)],
                   *[F.max(f"x{i}").alias(f"m{i}") for i in range(width)]).first()
    return [sorted({c for c in (row[f"c{i}"] or []) if c < row[f"m{i}"]}) for i in range(width)]


def to_bins(x: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """(rows, features) doubles -> bins: the number of cuts below the value."""
    out = np.empty(x.shape, dtype=np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(np.asarray(c, dtype=np.float64), x[:, i], side="left")
    return out


def bin_rows(df: DataFrame, key: Sequence[str], label: str, features: str = "features", weight: str | None = None,
             fold: str | None = None, cuts: list | None = None) -> Binned:
    """Stage ``df`` as compact binned rows.  Rows with a null label take no part."""
    df = df.where(F.col(label).isNotNull())
    st = df.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"),
                F.max(F.col(weight) if weight else F.lit(1.0)).alias("w")).first()
    # labels are measured from the middle of their range, which does not depend on the order of a sum
    n, mean = int(st["n"]), (float(st["lo"] or 0.0) + float(st["hi"] or 0.0)) / 2
    cuts = cuts if cuts is not None else feature_cuts(df, features)
    spread = max(float(st["hi"] or 0) - mean, mean - float(st["lo"] or 0), 1e-300)
    # sums of weight x label stay below 2^52, so they are exact in doubles too (a row is drawn about once)
    one = WEIGHT_ONE if weight else 1
    steps = max(1024, int(2 ** 52 / (4 * max(n, 1) * one * max(float(st["w"] or 1.0), 1.0))))
    step = spread / min(steps, 1 << 30)

    def run(batches):
        for b in batches:
            x = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            codes = to_bins(np.asarray(x, dtype=np.float64), cuts) if b.num_rows else x
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in codes], pa.binary())], names=["h", "fold", "y", "cw", "bins"])

    rows = df.select(F.xxhash64(*key).alias("h"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
                     F.round((F.col(label).cast("double") - F.lit(mean)) / F.lit(step)).cast("long").alias("y"),
                     F.round((F.col(weight) if weight else F.lit(1.0)) * one).cast("long").alias("cw"), vector_to_array(features).alias("x"))
    rows = rows.mapInArrow(run, "h long, fold int, y long, cw long, bins binary")
    return Binned(cut_lineage(rows), cuts, n, mean, step)


def _columns(b: pa.RecordBatch, width: int):
    h, fold, y, cw = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    bins = np.frombuffer(b"".join(b.column(4).to_pylist()), dtype=np.uint8).reshape(b.num_rows, width)
    return h, fold, y, cw, bins


# ----------------------------------------------------------------------------- splits

@dataclass(frozen=True)
class Spec:
    """A forest: ``features`` are tried at a node (None: all), nodes under ``min_split`` rows are leaves."""
    n_trees: int
    min_split: int = 2
    features: int | None = None
    seed: int = 42

    def root(self, tree: int) -> np.uint64:
        return _seeded(self.seed, tree)


def _choose(score: np.ndarray, ids: np.ndarray, spec: Spec) -> np.ndarray:
    """The feature of each node: the best score (ties: the first) of the first ``spec.features`` features, in a
    random order of the node's own, that split it at all; -1 if none does."""
    ok = score > -np.inf
    return np.where(ok.any(1), np.where(_allowed(ok, ids, spec), score, -np.inf).argmax(1), -1)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec, root: np.uint64) -> dict:
    """A whole subtree over rows with weight (w > 0); all rows are routed down.  Nodes of more than ``GROW_ROWS`` rows are split
    by histograms, the parts below them grow one by one.

    Returns feature (-1: leaf), bin (left if <=), left (right is left + 1), n, total weight and label sum, gain,
    depth of each node in level order, and the leaf of every row."""
    train = np.flatnonzero(w > 0)
    if len(train) <= GROW_ROWS:
        return _grow_levels(bins, y, w, spec, root)
    columns = np.ascontiguousarray(bins.T)
    most = columns.max(1).astype(np.int64)
    s = w * y
    tree = {k: [] for k in ("feature", "bin", "left", "n", "w", "s", "gain", "depth")}
    ids: list = []

    def add(i, depth):
        ids.append(i)
        for k, v in zip(tree, (-1, 0, -1, 0, 0.0, 0.0, 0.0, depth)):
            tree[k].append(v)

    add(root, 0)
    node, wide, small = np.zeros(len(y), dtype=np.int64), [0], []
    while wide:
        a = len(wide)
        number = np.full(len(ids), -1)
        number[wide] = np.arange(a)
        at = number[node]
        rows = train[at[train] >= 0]
        rows = rows[np.argsort(at[rows].astype(np.uint16), kind="stable")]
        of, starts = at[rows], np.searchsorted(at[rows], np.arange(a))
        mixed = np.minimum.reduceat(y[rows], starts) < np.maximum.reduceat(y[rows], starts)
        node_ids, weights = np.array([ids[i] for i in wide], dtype=np.uint64), (None, w[rows].astype(np.float64), s[rows].astype(np.float64))
        hist = _wide_histograms(columns, most, rows, of, weights, node_ids, mixed, spec)
        found = split_histograms(*hist, node_ids, mixed, spec)
        wide_now, wide = wide, []
        for i, r in zip(wide_now, found):
            tree["n"][i], tree["w"][i], tree["s"][i] = r["n"], r["w"], r["s"]
            if r["feature"] < 0:
                continue
            left = len(ids)
            tree["feature"][i], tree["bin"][i], tree["left"][i], tree["gain"][i] = r["feature"], r["bin"], left, r["gain"]
            for side, child in enumerate(x[0] for x in child_ids(np.array([ids[i]], dtype=np.uint64))):
                add(child, tree["depth"][i] + 1)
                n = r["n"] - r["n_left"] if side else r["n_left"]
                (wide if n > GROW_ROWS else small).append(left + side)
        feature, cut, first = (np.array(tree[k]) for k in ("feature", "bin", "left"))
        moving = np.flatnonzero(at >= 0)
        moving = moving[feature[node[moving]] >= 0]
        m = node[moving]
        node[moving] = first[m] + (bins[moving, feature[m]] > cut[m])
    parts = {k: [np.array(v)] for k, v in tree.items()}
    size, leaf = len(ids), node.copy()
    order = np.argsort(node, kind="stable")
    edge = np.searchsorted(node[order], np.arange(size + 1))
    for i in small:
        rows = order[edge[i]:edge[i + 1]]
        sub = _grow_levels(bins[rows], y[rows], w[rows], spec, ids[i])
        sub["left"] = np.where(sub["left"] >= 0, sub["left"] - 1 + size, -1)
        sub["depth"] = sub["depth"] + parts["depth"][0][i]
        leaf[rows] = np.where(sub["leaf"] > 0, sub["leaf"] - 1 + size, i)       # the subtree's root takes the node's place
        for k, v in parts.items():
            v[0][i] = sub[k][0]
            v.append(sub[k][1:])
        size += len(sub["feature"]) - 1
    whole = {k: np.concatenate(v) for k, v in parts.items()}
    # numbers in level order
    levels, now = [], np.array([0])
    while len(now):
        levels.append(now)
        first = whole["left"][now[whole["left"][now] >= 0]]
        now = np.stack([first, first + 1], axis=1).ravel()
    order = np.concatenate(levels)
    number = np.empty(size, dtype=np.int64)
    number[order] = np.arange(size)
    whole["left"] = np.where(whole["left"] >= 0, number[whole["left"]], -1)
    return {k: v[order] for k, v in whole.items()} | {"leaf": number[leaf]}


def _wide_histograms(columns, most, rows, of, weights, ids, mixed, spec: Spec) -> np.ndarray:
    """Rows, weight and label sum by node, feature and bin, of the ``rows`` in nodes ``of``; everything in bin 0 where a node may not split."""
    a, width = len(ids), len(columns)
    totals = np.stack([np.bincount(of, x, a).astype(np.float64) for x in weights])
    hist = np.zeros((3, a, width, MAX_BINS))
    hist[..., 0] = totals[:, :, None]
    for f in range(width):                                            # of two bins only the upper one is added up
        b = columns[f][rows]
        if most[f] == 1:
            hist[0, :, f, 1] = np.bincount(of[b == 1], minlength=a)
            hist[0, :, f, 0] -= hist[0, :, f, 1]
        elif most[f]:
            hist[0, :, f, :most[f] + 1] = np.bincount(of * (most[f] + 1) + b, minlength=a * (most[f] + 1)).reshape(a, -1)
    ok = ((hist[0] > 0) & (hist[0] < totals[0][:, None, None])).any(2)
    allowed = _allowed(ok, ids, spec) & mixed[:, None]
    for f in range(width):
        if not allowed[:, f].any():
            continue
        b, some = columns[f][rows], slice(None)
        if most[f] == 1:
            some = np.flatnonzero(allowed[of, f] & (b == 1))
        elif not allowed[:, f].all():
            some = np.flatnonzero(allowed[of, f])
        mine = np.flatnonzero(allowed[:, f])
        for h, x, total in zip(hist[1:], weights[1:], totals[1:]):
            if most[f] == 1:
                h[mine, f, 1] = np.bincount(of[some], x[some], a)[mine]
                h[mine, f, 0] = total[mine] - h[mine, f, 1]
            else:
                size = most[f] + 1
                h[mine, f, :size] = np.bincount(of[some] * size + b[some], x[some], a * size).reshape(a, size)[mine]
    closed = np.stack(np.nonzero(~allowed))
    hist[0, closed[0], closed[1]] = 0
    hist[0, closed[0], closed[1], 0] = totals[0][closed[0]]
    return hist


def node_at(tree: dict, node: np.ndarray, depth: int) -> np.ndarray:
    """The nodes themselves, or those above them at which a tree (in level order) cut at ``depth`` ends."""
    inner = np.flatnonzero(tree["left"] >= 0)
    parent = np.zeros(len(tree["left"]), dtype=np.int64)
    parent[tree["left"][inner]] = parent[tree["left"][inner] + 1] = inner
    node = node.copy()
    while len(deep := np.flatnonzero(tree["depth"][node] > depth)):
        node[deep] = parent[node[deep]]
    return node


def _allowed(ok: np.ndarray, ids: np.ndarray, spec: Spec) -> np.ndarray:
    """Of the features that split a node at all (``ok``), the first ``spec.features`` in a random order of the node's own."""
    if spec.features is None or spec.features >= ok.shape[1]:
        return ok
    draw = _mix(ids[:, None] ^ _mix(np.arange(1, ok.shape[1] + 1, dtype=np.uint64))[None, :])
    order = np.argsort(draw, axis=1, kind="stable")
    among = np.cumsum(np.take_along_axis(ok, order, 1), axis=1) <= spec.features
    allowed = np.zeros_like(ok)
    np.put_along_axis(allowed, order, among, 1)
    return allowed & ok


def _grow_levels(bins: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec, root: np.uint64) -> dict:
    """``grow`` level by level: features of two bins by the rows in the upper one, the others in the order of their bins.
    Only what a node may split by is scored."""
    width = bins.shape[1]
    columns = np.ascontiguousarray(bins.T)
    train = np.flatnonzero(w > 0)
    w, s = w.astype(np.float64), (w * y).astype(np.float64)          # whole numbers under 2^53
    node, live = np.zeros(len(y), dtype=np.int64), np.arange(len(y))
    most = columns[:, train].max(1) if len(train) else np.zeros(width, dtype=np.uint8)
    two = {f: train[columns[f][train] == 1] for f in range(width) if most[f] == 1}
    orders = {f: train[np.argsort(columns[f][train], kind="stable")] for f in range(width) if most[f] > 1}
    out = {k: [] for k in ("feature", "bin", "left", "n", "w", "s", "gain", "depth")}
    ids, first, depth, made, rows = np.array([root], dtype=np.uint64), 0, 0, 1, train
    while len(ids):
        a = len(ids)
        of = node[rows] - first                                       # compact number of the open node; rows come in its order
        n = np.bincount(of, minlength=a)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        total_w, total_s = np.bincount(of, w[rows], a), np.bincount(of, s[rows], a)
        some = np.flatnonzero(n)
        active = np.zeros(a, dtype=bool)
        if len(some):
            yo = y[rows]
            active[some] = np.minimum.reduceat(yo, starts[some]) < np.maximum.reduceat(yo, starts[some])
        active &= n >= spec.min_split
        ok = np.zeros((a, width), dtype=bool)
        for f, o in two.items():
            upper = np.bincount(node[o] - first, minlength=a)
            ok[:, f] = (upper > 0) & (upper < n)
        for f, o in orders.items():
            ok[some, f] = columns[f][o[starts[some]]] != columns[f][o[starts[some] + n[some] - 1]]
        allowed = _allowed(ok, ids, spec) & active[:, None]
        score, where = np.full((a, width), -np.inf), np.zeros((a, width), dtype=np.uint8)
        for f, o in two.items():
            mine = np.flatnonzero(allowed[:, f])
            if not len(mine):
                continue
            at = node[o] - first
            if len(mine) < a:
                keep = allowed[at, f]
                o, at = o[keep], at[keep]
            rw, rs = np.bincount(at, w[o], a)[mine], np.bincount(at, s[o], a)[mine]
            lw, ls = total_w[mine] - rw, total_s[mine] - rs
            score[mine, f] = ls * ls / lw + (total_s[mine] - ls) ** 2 / (total_w[mine] - lw)
        for f, o in orders.items():
            mine = np.flatnonzero(allowed[:, f])
            if not len(mine):
                continue
            if len(mine) < a:
                o = o[np.repeat(allowed[:, f], n)]
            b = columns[f][o]
            change = b[1:] != b[:-1]
            edge = np.cumsum(n[mine])
            change[edge[:-1] - 1] = False
            i = np.flatnonzero(change)
            lo = np.searchsorted(i, edge - n[mine])                   # every one of these nodes has a change of bins
            size = np.diff(np.append(lo, len(i)))
            cw, cs = np.concatenate([[0.0], np.cumsum(w[o])]), np.concatenate([[0.0], np.cumsum(s[o])])
            lw, ls = cw[i + 1] - np.repeat(cw[edge - n[mine]], size), cs[i + 1] - np.repeat(cs[edge - n[mine]], size)
            tw, ts = np.repeat(total_w[mine], size), np.repeat(total_s[mine], size)
            gain = ls * ls / lw + (ts - ls) ** 2 / (tw - lw)
            best = np.maximum.reduceat(gain, lo)
            hit = np.flatnonzero(gain == np.repeat(best, size))
            k = hit[np.searchsorted(hit, lo)]                         # the first bin with the best score
            score[mine, f], where[mine, f] = best, b[i[k]]
        chosen = np.where((score > -np.inf).any(1), score.argmax(1), -1) if width else np.full(a, -1)
        split = np.flatnonzero(chosen >= 0)
        left = np.full(a, -1, dtype=np.int64)
        left[split] = made + 2 * np.arange(len(split))
        gain = np.zeros(a)
        gain[split] = np.maximum(score[split, chosen[split]] - total_s[split] ** 2 / total_w[split], 0.0)
        cut = np.where(chosen >= 0, where[np.arange(a), chosen], 0) if width else np.zeros(a, dtype=np.uint8)
        for name, v in zip(out, (chosen, cut, left, n, total_w, total_s, gain, np.full(a, depth))):
            out[name].append(v)
        # every row of a split node goes to a child; rows in leaves stay where they are
        at = node[live] - first
        goes = chosen[at] >= 0
        live, m = live[goes], at[goes]
        node[live] = left[m] + (columns[chosen[m], live] > cut[m])
        again = np.repeat(chosen >= 0, n)
        two = {f: o[node[o] >= made] for f, o in two.items()}
        first, made, depth = made, made + 2 * len(split), depth + 1
        lids, rids = child_ids(ids[split])
        ids = np.stack([lids, rids], axis=1).ravel()

        def sorted_by_node(o):
            o = o[again]
            k = node[o] - first
            return o[np.argsort(k.astype(np.uint16) if len(ids) < 1 << 16 else k, kind="stable")]

        orders = {f: sorted_by_node(o) for f, o in orders.items()}
        rows = next(iter(orders.values())) if orders else sorted_by_node(rows)
    tree = {k: np.concatenate(v) for k, v in out.items()}
    return tree | {"leaf": node}


def split_histograms(n: np.ndarray, w: np.ndarray, s: np.ndarray, ids: np.ndarray, mixed: np.ndarray, spec: Spec) -> list[dict]:
    """The same choice from histograms (nodes, features, bins); feature -1 for a node that no split divides."""
    cn, cw, cs = (np.cumsum(x, axis=2).astype(np.float64) for x in (n, w, s))
    tn, tw, ts = (x[:, :1, -1:] for x in (cn, cw, cs))
    valid = (n > 0) & (cn < tn)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(valid, cs * cs / cw + (ts - cs) ** 2 / (tw - cw), -np.inf)
    where = score.argmax(2)
    best = np.take_along_axis(score, where[:, :, None], 2)[:, :, 0]
    chosen = np.where(mixed & (tn[:, 0, 0] >= spec.min_split), _choose(best, ids, spec), -1)
    out = []
    for i, f in enumerate(chosen):
        found = {"feature": int(f), "w": float(tw[i, 0, 0]), "s": float(ts[i, 0, 0]), "n": int(tn[i, 0, 0])}
        if f >= 0:
            b = int(where[i, f])
            found |= {"bin": b, "n_left": int(cn[i, f, b]), "w_left": float(cw[i, f, b]), "s_left": float(cs[i, f, b]),
                      "gain": max(float(best[i, f] - ts[i, 0, 0] ** 2 / tw[i, 0, 0]), 0.0)}
        out.append(found)
    return out


# ----------------------------------------------------------------------------- upper levels

def _new_tree(root: np.uint64) -> dict:
    return {"feature": [-1], "bin": [0], "left": [-1], "id": [root], "depth": [0], "n": [None], "w": [0.0], "s": [0.0], "gain": [0.0], "closed": set()}


def _route(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The upper node that each row reaches."""
    feature, cut, left = (np.asarray(tree[k]) for k in ("feature", "bin", "left"))
    node = np.zeros(len(bins), dtype=np.int64)
    while True:
        f = feature[node]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            return node
        m = node[go]
        node[go] = left[m] + (bins[go, f[go]] > cut[m])


def _upper_levels(data: Binned, folds: Sequence[int], spec: Spec, local_rows: int) -> dict:
    """{(fold, tree): upper tree}; its leaves are open for subtrees, but for the ``closed`` ones, which nothing divides."""
    trees = {(f, t): _new_tree(spec.root(t)) for f in folds for t in range(spec.n_trees)}
    if data.n <= local_rows:
        return trees
    sc, width = data.rows.sparkSession.sparkContext, data.width
    waiting = [(key, 0) for key in trees]
    while waiting:
        now, waiting = waiting[:NODES_PER_PASS], waiting[NODES_PER_PASS:]
        by_tree: dict = {}
        for g, (key, node) in enumerate(now):
            by_tree.setdefault(key, {})[node] = g
        held = sc.broadcast({key: (trees[key], nodes) for key, nodes in by_tree.items()})
        ids = {g: trees[key]["id"][node] for g, (key, node) in enumerate(now)}

        def add_up(batches):
            hist: dict = {}
            for b in batches:
                h, fold, y, cw, bins = _columns(b, width)
                for (f, t), (tree, nodes) in held.value.items():
                    w = np.where(fold == f, 0, bootstrap_counts(h, spec.root(t)) * cw)
                    at = _route(tree, bins)
                    for node, g in nodes.items():
                        rows = np.flatnonzero((at == node) & (w > 0))
                        if not len(rows):
                            continue
                        cell = (bins[rows] + np.arange(width) * MAX_BINS).ravel()
                        wr, size = w[rows], width * MAX_BINS
                        part = np.stack([np.bincount(cell, minlength=size), np.bincount(cell, np.repeat(wr, width), size),
                                         np.bincount(cell, np.repeat(wr * y[rows], width), size)])
                        lo, hi = y[rows].min(), y[rows].max()
                        old = hist.get(g)
                        hist[g] = (part, lo, hi) if old is None else (old[0] + part, min(old[1], lo), max(old[2], hi))
            for g, (part, lo, hi) in hist.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([lo], pa.int64()), pa.array([hi], pa.int64()),
                                                  pa.array([part.tobytes()], pa.binary())], names=["g", "lo", "hi", "hist"])

        def choose(batches):
            hist: dict = {}
            for b in batches:
                for g, lo, hi, part in zip(*(c.to_pylist() for c in b.columns)):
                    part = np.frombuffer(part, dtype=np.float64).reshape(3, width, MAX_BINS)
                    old = hist.get(g)
                    hist[g] = (part, lo, hi) if old is None else (old[0] + part, min(old[1], lo), max(old[2], hi))
            for g, (part, lo, hi) in hist.items():
                found = split_histograms(part[0][None], part[1][None], part[2][None], np.array([ids[g]]), np.array([lo < hi]), spec)[0]
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([json.dumps(found)])], names=["g", "split"])

        met = data.rows.mapInArrow(add_up, "g int, lo long, hi long, hist binary").repartition(-(-len(now) // 32), "g")
        found = {r["g"]: json.loads(r["split"]) for r in met.mapInArrow(choose, "g int, split string").collect()}
        for g, (key, node) in enumerate(now):
            r, tree = found.get(g, {"feature": -1, "n": 0, "w": 0.0, "s": 0.0}), trees[key]
            if r["feature"] < 0:
                tree["n"][node], tree["w"][node], tree["s"][node] = r["n"], r["w"], r["s"]
                tree["closed"].add(node)
                continue
            left = len(tree["feature"])
            tree["feature"][node], tree["bin"][node], tree["left"][node] = r["feature"], r["bin"], left
            tree["n"][node], tree["w"][node], tree["s"][node], tree["gain"][node] = r["n"], r["w"], r["s"], r["gain"]
            for i, side in zip(child_ids(np.array([tree["id"][node]])), ("left", "right")):
                n = r["n_left"] if side == "left" else r["n"] - r["n_left"]
                w = r["w_left"] if side == "left" else r["w"] - r["w_left"]
                s = r["s_left"] if side == "left" else r["s"] - r["s_left"]
                for k, v in zip(("feature", "bin", "left", "id", "depth", "n", "w", "s", "gain"),
                                (-1, 0, -1, i[0], tree["depth"][node] + 1, n, w, s, 0.0)):
                    tree[k].append(v)
                if n > local_rows:
                    waiting.append((key, len(tree["feature"]) - 1))
        held.unpersist()
    return trees


# ----------------------------------------------------------------------------- subtrees

_SHIPPED = "fold int, tree int, node int, part long, h binary, held binary, y binary, w binary, bins binary"
_SUBTREE = pa.schema([("fold", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("size", pa.int32()), ("arrays", pa.binary()),
                      ("row", pa.binary()), ("label", pa.binary()), ("prediction", pa.binary())])
_ARRAYS = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "depth": np.int16, "w": np.float64, "s": np.float64, "gain": np.float64}


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in four bytes each, or in eight if some need more."""
    return (x.astype(np.int32) if len(x) and -2 ** 31 <= x.min() and x.max() < 2 ** 31 else x.astype(np.int64)).tobytes()


def _widened(cells: list[bytes], counts: list[int]) -> np.ndarray:
    """``_narrow`` undone for cells of so many numbers each."""
    return np.concatenate([np.frombuffer(c, dtype=np.int32 if len(c) == 4 * n else np.int64).astype(np.int64) for c, n in zip(cells, counts)])


def _ship(data: Binned, trees: dict, spec: Spec, with_held: bool) -> DataFrame:
    """The rows of every open node, packed: one row per (fit, tree, node) and batch.  Held-out rows (weight 0) go along."""
    sc, width = data.rows.sparkSession.sparkContext, data.width
    held_trees = sc.broadcast({k: {x: t[x] for x in ("feature", "bin", "left", "closed")} for k, t in trees.items()})

    def run(batches):
        for number, b in enumerate(batches):
            # held-out rows in a closed node need no company: each batch of them is a group of its own
            part = (TaskContext.get().partitionId() << 32) + number + 1
            h, fold, y, cw, bins = _columns(b, width)
            for (f, t), tree in held_trees.value.items():
                out = fold == f
                w = np.where(out, 0, bootstrap_counts(h, spec.root(t)) * cw)
                rows = np.flatnonzero((w > 0) | out) if with_held else np.flatnonzero(w > 0)
                at = _route(tree, bins[rows])
                for node in map(int, np.unique(at)) if len(tree["feature"]) > 1 else [0]:
                    closed = node in tree["closed"]
                    r = rows[(at == node) & (out[rows] | (not closed))]
                    if not len(r):
                        continue
                    # a hash tells held-out rows apart only
                    cells = [h[r][out[r]].tobytes(), out[r].tobytes(), _narrow(y[r]), _narrow(w[r]), bins[r].tobytes()]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (f, t, node)), pa.array([part if closed else 0], pa.int64()),
                                                      *(pa.array([c], pa.binary()) for c in cells)],
                                                     names=["fold", "tree", "node", "part", "h", "held", "y", "w", "bins"])

    packed = data.rows.mapInArrow(run, _SHIPPED)
    tasks = max(1, -(-data.n * len(trees) // ROWS_PER_TASK))
    if not any(t["closed"] for t in trees.values()):       # each open node is one group: more tasks would only be empty
        tasks = min(tasks, 2 * sum(f < 0 for t in trees.values() for f in t["feature"]))
    return packed.repartition(tasks, "fold", "tree", "node", "part")


def _ancestors(tree: dict, depth: int | None) -> list[int]:
    """Per upper node the deepest node above it, or itself, that a tree cut at ``depth`` still has."""
    up = list(range(len(tree["feature"])))
    if depth is not None:
        for node, left in enumerate(tree["left"]):
            if left >= 0:                               # children stand behind their parent
                for c in (left, left + 1):
                    up[c] = c if tree["depth"][c] <= depth else up[node]
    return up


def _finish(data: Binned, trees: dict, spec: Spec, depths: Sequence[int | None] | None) -> DataFrame:
    """One row per subtree: its arrays, and for the held-out rows the prediction of the tree cut at each of ``depths``."""
    width, step, mean = data.width, data.step, data.mean
    depths = list(depths or [])
    roots = data.rows.sparkSession.sparkContext.broadcast(
        {k: (t["id"], t["depth"], t["closed"], [_ancestors(t, d) for d in depths], t["w"], t["s"]) for k, t in trees.items()})

    def run(table: pa.Table) -> pa.Table:
        fold, tree, node = (table.column(i)[0].as_py() for i in range(3))
        h, out, bins = (np.frombuffer(b"".join(table.column(i).to_pylist()), dtype=t) for i, t in ((4, np.int64), (5, np.bool_), (8, np.uint8)))
        counts = [len(x) for x in table.column(5).to_pylist()]
        y, w = (_widened(table.column(i).to_pylist(), counts) for i in (6, 7))
        ids, depth0, closed, above, uw, us = roots.value[fold, tree]
        rows = np.flatnonzero(out)
        predicted = np.zeros((len(depths), len(rows)))
        if node in closed:
            got = {k: np.zeros(0) for k in _ARRAYS}
        else:
            got = grow(bins.reshape(len(out), width), y, w, spec, ids[node])
            got["depth"] = got["depth"] + depth0[node]
            leaves = got["leaf"][rows]
            value = mean + step * got["s"] / np.maximum(got["w"], 1)
        for i, d in enumerate(depths):
            top = above[i][node]                 # the node itself, or the one above it at which the cut tree ends
            if top != node or node in closed:
                predicted[i] = mean + step * us[top] / max(uw[top], 1)
            else:
                predicted[i] = value[leaves if d is None else node_at(got, leaves, d)]
        arrays = b"".join(got[k].astype(t).tobytes() for k, t in _ARRAYS.items())
        row = [fold, tree, node, len(got["feature"]), arrays, h.tobytes(), (mean + step * y[rows]).tobytes(), predicted.tobytes()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SUBTREE)], schema=_SUBTREE)

    names = {"int32": "int", "binary": "binary"}
    schema = ", ".join(f"{f.name} {names[str(f.type)]}" for f in _SUBTREE)
    return _ship(data, trees, spec, bool(depths)).groupBy("fold", "tree", "node", "part").applyInArrow(run, schema)


def cv_forest(data: Binned, folds: int, spec: Spec, sizes: Sequence[int] | None = None,
              depths: Sequence[int | None] = (None,), local_rows: int = LOCAL_ROWS) -> dict:
    """{(size, depth): R^2 on each fold} of the forests of the first ``size`` trees, cut at ``depth`` (None: whole trees)."""
    sizes = sorted(sizes or [spec.n_trees])
    trees = _upper_levels(data, range(folds), spec, local_rows)
    done = _finish(data, trees, spec, depths)

    def unpack(batches):
        for b in batches:
            for fold, tree, row, label, p in zip(*(b.column(i).to_pylist() for i in range(5))):
                row = np.frombuffer(row, dtype=np.int64)
                p = np.frombuffer(p).reshape(len(depths), len(row))
                if not len(row):
                    continue
                n = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, fold, dtype=np.int32)), pa.array(np.full(n, tree, dtype=np.int32)), pa.array(row),
                     pa.array(np.frombuffer(label)), *(pa.array(x) for x in p)], names=["fold", "tree", "row", "label", *(f"p{i}" for i in range(len(depths)))])

    cols = ", ".join(f"p{i} double" for i in range(len(depths)))
    rows = done.select("fold", "tree", "row", "label", "prediction").mapInArrow(unpack, f"fold int, tree int, row long, label double, {cols}")
    grid = [(n, i) for n in sizes for i in range(len(depths))]
    # rows that repeat a key share a hash and a label sum; both are averaged alike
    each = rows.groupBy("fold", "row").agg(F.avg("label").alias("label"), F.count(F.lit(1)).alias("m"),
                                           *[F.avg(F.when(F.col("tree") < n, F.col(f"p{i}"))).alias(f"g{k}") for k, (n, i) in enumerate(grid)])
    copies = F.col("m") / F.lit(spec.n_trees)
    sums = each.groupBy("fold").agg(F.sum(copies).alias("n"), F.sum(copies * F.col("label")).alias("s"), F.sum(copies * F.col("label") ** 2).alias("q"),
                                    *[F.sum(copies * (F.col("label") - F.col(f"g{k}")) ** 2).alias(f"e{k}") for k in range(len(grid))]).collect()
    out: dict = {(n, depths[i]): [0.0] * folds for n, i in grid}
    for r in sums:
        spread = r["q"] - r["s"] ** 2 / r["n"]
        for k, (n, i) in enumerate(grid):
            out[n, depths[i]][r["fold"]] = 1 - r[f"e{k}"] / spread if spread > 0 else 0.0
    return out


# ----------------------------------------------------------------------------- models

@dataclass
class TreeEnsemble:
    """Trees as arrays (right child = left + 1), applied by an Arrow UDF; ``share`` weighs each tree, ``start`` is added."""
    cuts: list
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    importances: np.ndarray
    share: float
    start: float = 0.0
    _shared: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_shared": {}}

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return self._walk(to_bins(x, self.cuts), 0, len(self.roots)) + self.start

    def _walk(self, bins: np.ndarray, a: int, b: int) -> np.ndarray:
        total = np.zeros(len(bins))
        for r in self.roots[a:b]:
            node = np.full(len(bins), r, dtype=np.int64)
            rows = np.arange(len(bins))
            while len(rows):
                f = self.feature[node[rows]]
                rows = rows[f >= 0]
                m = node[rows]
                node[rows] = self.left[m] + (bins[rows, f[f >= 0]] > self.bin[m])
            total += self.value[node]
        return total * self.share

    def _chunks(self) -> list["TreeEnsemble"]:
        """Pieces of whole trees with about ``NODES_PER_CHUNK`` nodes, so that what is broadcast at once is bounded."""
        ends = np.append(self.roots[1:], len(self.feature))
        out, a = [], 0
        while a < len(self.roots):
            b = max(a + 1, int(np.searchsorted(ends, self.roots[a] + NODES_PER_CHUNK, side="right")))
            lo, hi = int(self.roots[a]), int(ends[b - 1])
            out.append(TreeEnsemble(self.cuts, self.feature[lo:hi], self.bin[lo:hi], self.left[lo:hi] - lo, self.value[lo:hi],
                                    self.roots[a:b] - lo, self.importances, self.share, self.start if a == 0 else 0.0))
            a = b
        return out

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """``df`` with the model's value; works in batches and in streams."""
        sc = df.sparkSession.sparkContext
        if self._shared.get("app") != sc.applicationId:
            self._shared.update(app=sc.applicationId, held=[sc.broadcast(c) for c in self._chunks()])
        total = None
        for held in self._shared["held"]:
            total = _applied(held)(vector_to_array(features)) if total is None else total + _applied(held)(vector_to_array(features))
        return df.withColumn(out, total if total is not None else F.lit(self.start))

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"cuts": self.cuts, "importances": list(map(float, self.importances)), "share": self.share, "start": self.start}
        spark.createDataFrame([(json.dumps(meta),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        nodes = pd.DataFrame({"tree": tree, "node": np.arange(len(self.feature)), "feature": self.feature.astype(np.int64), "bin": self.bin.astype(np.int64),
                              "left": self.left.astype(np.int64), "value": self.value})
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TreeEnsemble":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["state"])
        t = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")       # a model is held by the driver
        roots = np.flatnonzero(np.diff(t["tree"].to_numpy(), prepend=-1))
        return cls(meta["cuts"], t["feature"].to_numpy(np.int16), t["bin"].to_numpy(np.uint8), t["left"].to_numpy(np.int64), t["value"].to_numpy(),
                   roots, np.array(meta["importances"]), meta["share"], meta["start"])


def _applied(held):
    @F.pandas_udf("double")
    def walk(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype="float64")
        return pd.Series(held.value.predict_array(np.vstack(xs.to_numpy()).astype("float64")))
    return walk


def _ensemble(cuts: list, trees: list[dict], share: float, start: float) -> TreeEnsemble:
    """Trees (feature, bin, left, value, gain) behind each other; importances as mean shares of each tree's gain."""
    sizes = np.array([len(t["feature"]) for t in trees], dtype=np.int64)
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(trees) else np.zeros(0, dtype=np.int64)
    importances = np.zeros(len(cuts))
    for t in trees:
        inner = t["feature"] >= 0
        mine = np.bincount(t["feature"][inner], weights=t["gain"][inner], minlength=len(cuts))
        importances += mine / mine.sum() if mine.sum() > 0 else 0
    total = importances.sum()
    return TreeEnsemble(cuts, *(np.concatenate([t[k] for t in trees]) if trees else np.zeros(0, dtype=d) for k, d in (("feature", np.int16), ("bin", np.uint8))),
                        np.concatenate([np.where(t["left"] >= 0, t["left"].astype(np.int64) + r, -1) for t, r in zip(trees, roots)]) if trees else np.zeros(0, dtype=np.int64),
                        np.concatenate([t["value"] for t in trees]) if trees else np.zeros(0), roots, importances / total if total > 0 else importances, share, start)


def _cut_at(tree: dict, depth: int | None) -> dict:
    if depth is None:
        return tree
    stop = tree["depth"] >= depth
    keep = tree["depth"] <= depth
    number = np.cumsum(keep) - 1
    out = {k: v[keep] for k, v in tree.items()}
    out["feature"] = np.where(stop[keep], -1, out["feature"]).astype(np.int16)
    out["left"] = np.where(out["feature"] >= 0, number[np.maximum(out["left"], 0)], -1)
    return out


def fit_forest(data: Binned, spec: Spec, depth: int | None = None, local_rows: int = LOCAL_ROWS) -> TreeEnsemble:
    """The forest of ``spec`` on all rows, trees cut at ``depth`` (None: whole)."""
    trees = _upper_levels(data, [-2], spec, local_rows)
    subtrees: dict = {}
    grown = cut_lineage(_finish(data, trees, spec, None).select("tree", "node", "size", "arrays"))
    # a partition is fetched by a job of its own: few, of about eight trees each
    for r in grown.coalesce(max(1, spec.n_trees // 8)).toLocalIterator():
        at, arrays = 0, {}
        for k, t in _ARRAYS.items():
            size = r["size"] * np.dtype(t).itemsize
            arrays[k] = np.frombuffer(r["arrays"], dtype=t, count=r["size"], offset=at)
            at += size
        subtrees[r["tree"], r["node"]] = arrays
    whole = []
    for t in range(spec.n_trees):
        upper = trees[-2, t]
        parts = {k: [np.asarray(upper[k], dtype=d)] for k, d in _ARRAYS.items()}
        size = len(upper["feature"])
        for node in range(size):
            sub = subtrees.get((t, node))
            if upper["feature"][node] >= 0 or sub is None:
                continue
            for k, d in _ARRAYS.items():                    # the subtree's root takes the place of the open node
                parts[k][0][node] = sub[k][0]
            moved = np.where(sub["left"] >= 0, sub["left"].astype(np.int64) - 1 + size, -1)
            parts["left"][0][node] = moved[0]
            for k in _ARRAYS:
                parts[k].append((moved if k == "left" else sub[k])[1:])
            size += len(sub["feature"]) - 1
        tree = {k: np.concatenate(v) for k, v in parts.items()}
        tree["value"] = data.mean + data.step * tree["s"] / np.maximum(tree["w"], 1)
        whole.append(_cut_at(tree, depth))
    return _ensemble(data.cuts, whole, 1.0 / max(spec.n_trees, 1), 0.0)


# ----------------------------------------------------------------------------- boosting

def boost(bins: np.ndarray, y: np.ndarray, train: np.ndarray, n_trees: int, depth: int, rate: float, sizes: Sequence[int] = ()):
    """Least-squares boosting of ``n_trees`` trees of ``depth`` on the rows of ``train``: (start, trees, {size: value of every row})."""
    n, width = bins.shape
    size = width * MAX_BINS
    columns = np.ascontiguousarray(bins.T)
    start = float(y[train].mean()) if train.any() else 0.0
    value, trees, snapshots = np.full(n, start), [], {}
    for k in range(1, n_trees + 1):
        rest = np.where(train, y - value, 0.0)
        node = np.zeros(n, dtype=np.int64)
        tree = {x: [] for x in ("feature", "bin", "left", "value", "gain")}
        first, made = 0, 1
        for level in range(depth + 1):
            a = made - first
            at = node - first
            inside = at >= 0
            mine = np.flatnonzero(inside & train)
            total_n = np.bincount(at[mine], minlength=a).astype(float)
            total_s = np.bincount(at[mine], rest[mine], a)
            mean = total_s / np.maximum(total_n, 1)
            chosen, cut, gain = np.full(a, -1), np.zeros(a, dtype=np.int64), np.zeros(a)
            if level < depth and len(mine):
                base, mine_rest = at[mine] * MAX_BINS, rest[mine]
                hn, hs = np.empty((a, width, MAX_BINS), dtype=np.int64), np.empty((a, width, MAX_BINS))
                for f in range(width):
                    key = base + columns[f][mine]
                    hn[:, f] = np.bincount(key, minlength=a * MAX_BINS).reshape(a, MAX_BINS)
                    hs[:, f] = np.bincount(key, mine_rest, a * MAX_BINS).reshape(a, MAX_BINS)
                cn, cs = np.cumsum(hn, 2).astype(float), np.cumsum(hs, 2)
                tn, ts = total_n[:, None, None], total_s[:, None, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where((hn > 0) & (cn < tn), cs * cs / cn + (ts - cs) ** 2 / (tn - cn), -np.inf).reshape(a, size)
                best = score.argmax(1)
                top = score[np.arange(a), best] - total_s ** 2 / np.maximum(total_n, 1)
                ok = top > 1e-12
                chosen, cut, gain = np.where(ok, best // MAX_BINS, -1), np.where(ok, best % MAX_BINS, 0), np.where(ok, top, 0.0)
            split = np.flatnonzero(chosen >= 0)
            left = np.full(a, -1, dtype=np.int64)
            left[split] = made + 2 * np.arange(len(split))
            for name, v in zip(tree, (chosen, cut, left, mean, gain)):
                tree[name].append(v)
            moving = np.flatnonzero(inside)
            moving = moving[chosen[at[moving]] >= 0]
            m = at[moving]
            node[moving] = left[m] + (bins[moving, chosen[m]] > cut[m])
            first, made = made, made + 2 * len(split)
            if not len(split):
                break
        tree = {name: np.concatenate(v) for name, v in tree.items()}
        value = value + rate * tree["value"][node]
        trees.append({**tree, "feature": tree["feature"].astype(np.int16), "bin": tree["bin"].astype(np.uint8)})
        if k in sizes:
            snapshots[k] = value.copy()
    return start, trees, snapshots


def _whole_fits(data: Binned, jobs: list[tuple]) -> DataFrame:
    """All rows once for each job, packed: (job, fold, y, bins)."""
    width = data.width

    def run(batches):
        for b in batches:
            _, fold, y, _, bins = _columns(b, width)
            for j in range(len(jobs)):
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (fold, y, bins))], names=["job", "fold", "y", "bins"])

    return data.rows.mapInArrow(run, "job int, fold binary, y binary, bins binary").repartition(len(jobs), "job")


def _job_rows(table: pa.Table, data_width: int, mean: float, step: float):
    j = table.column(0)[0].as_py()
    fold, y, bins = (np.frombuffer(b"".join(table.column(i).to_pylist()), dtype=t) for i, t in zip((1, 2, 3), (np.int32, np.int64, np.uint8)))
    return j, fold, mean + step * y, bins.reshape(len(fold), data_width)


def cv_boost(data: Binned, folds: int, shapes: Sequence[tuple], sizes: Sequence[int]) -> dict:
    """{(shape, size): R^2 on each fold}; a shape is (depth, rate).  A model of ``size`` trees is the beginning of the longest."""
    jobs = [(s, f) for s in range(len(shapes)) for f in range(folds)]
    width, mean, step, most = data.width, data.mean, data.step, max(sizes)

    def run(table: pa.Table) -> pa.Table:
        j, fold, y, bins = _job_rows(table, width, mean, step)
        s, f = jobs[j]
        depth, rate = shapes[s]
        valid = fold == f
        _, _, values = boost(bins, y, ~valid, most, depth, rate, sizes)
        spread = float(((y[valid] - y[valid].mean()) ** 2).sum()) if valid.any() else 0.0
        r2 = [1 - float(((y[valid] - values[k][valid]) ** 2).sum()) / spread if spread > 0 else 0.0 for k in sizes]
        return pa.table({"shape": pa.array([s] * len(sizes), pa.int32()), "fold": pa.array([f] * len(sizes), pa.int32()),
                         "size": pa.array(list(sizes), pa.int32()), "r2": pa.array(r2)})

    rows = _whole_fits(data, jobs).groupBy("job").applyInArrow(run, "shape int, fold int, size int, r2 double").collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["fold"]):
        out.setdefault((r["shape"], r["size"]), []).append(r["r2"])
    return out


def fit_boost(data: Binned, n_trees: int, depth: int, rate: float) -> TreeEnsemble:
    width, mean, step = data.width, data.mean, data.step

    def run(table: pa.Table) -> pa.Table:
        _, _, y, bins = _job_rows(table, width, mean, step)
        start, trees, _ = boost(bins, y, np.ones(len(y), dtype=bool), n_trees, depth, rate)
        text = json.dumps([{k: v.tolist() for k, v in t.items()} for t in trees])
        return pa.table({"start": pa.array([start]), "trees": pa.array([text])})

    row = _whole_fits(data, [(0, -2)]).groupBy("job").applyInArrow(run, "start double, trees string").first()
    kinds = {"feature": np.int16, "bin": np.uint8, "left": np.int64, "value": np.float64, "gain": np.float64}
    trees = [{k: np.array(t[k], dtype=d) for k, d in kinds.items()} for t in json.loads(row["trees"])] if row else []
    return _ensemble(data.cuts, trees, rate, row["start"] if row else mean)
