"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's words (runs of letters, digits and non-ASCII bytes, A-Z
lower-cased) and their first 4, 5 and 6 bytes, hashed into ``SPACE`` slots; a
text has a term or not.  The score is

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the terms that a text has: the factors v let two terms mean more together
(an insult next to a group) than the sum of their weights.

The model is fitted on a bounded sample: the ``SAMPLE`` labelled documents with
the smallest id hashes among those whose crc32(doc_id) mod 5 is not 0, on the
``FEATURES`` slots that tell the classes apart best in it (chi-square, in at
least ``LEAST`` texts).  It is one Spark group of that bounded size; the model
(about 10 numbers for each feature) is broadcast and scores every whole text in
a single pass without any shuffle.  Ids, labels, languages and sources are no
input of a score.

Defined results for odd input: null and empty texts have no terms and get
sigmoid(w0); a null doc_id counts as held out; null labels are ignored and a
document labelled twice is toxic if any label says so; with labels of one class
or none the score is the Laplace-smoothed share of toxic labels; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from halcyon.llm.common import lean, table
from halcyon.llm.words import groups, hashed
from halcyon.plans.registry import register

SPACE = 1 << 20
SAMPLE = 8000
FEATURES = 2048
LEAST = 4
FACTORS = 8
EPOCHS = 30
PREFIXES = (4, 5, 6)

_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(column: pa.Array):
    """(index of the first document, document of each term, slot of each term) of consecutive documents."""
    for first, docs in groups(column):
        h, at = hashed(docs, apart=_APART, prefixes=PREFIXES)
        kind = np.arange(h.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slots = ((h ^ kind) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64)
        yield first, len(docs), np.repeat(np.arange(len(docs)), np.diff(at)), slots


def _sampled(batches):
    """doc_id, toxic, distinct slots of each labelled text."""
    for b in batches:
        for first, n, owner, slots in _terms(b.column(2)):
            keys = np.unique((owner[:, None] * SPACE + slots).ravel())
            ends = np.searchsorted(keys, np.arange(n + 1) * SPACE)
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), (keys % SPACE).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), lists], names=["doc_id", "toxic", "slots"])


def _logit(present: np.ndarray, rows: np.ndarray, n: int, model: dict):
    """Scores before the sigmoid and the factor sums of ``n`` texts, given (text, feature) pairs sorted by text."""
    linear = np.bincount(rows, weights=model["w"][present], minlength=n)
    v = model["v"][present]
    sums = np.stack([np.bincount(rows, weights=v[:, f], minlength=n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(rows, weights=(v * v).sum(axis=1), minlength=n)
    return model["w0"] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(lists: list[np.ndarray], labels: np.ndarray, features: int = FEATURES, least: int = LEAST, factors: int = FACTORS, epochs: int = EPOCHS) -> dict:
    """The machine for texts given as slot lists: log loss, Adam on mini-batches, weight decay; fixed seed."""
    n, positive = len(labels), float(labels.sum())
    smooth = np.log((positive + 1) / (n - positive + 1))
    rows, slots = np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    df = np.bincount(slots, minlength=SPACE).astype(float)
    df_toxic = np.bincount(slots, weights=labels[rows], minlength=SPACE)
    expected = df * positive / max(n, 1)
    chi = np.where(df >= least, (df_toxic - expected) ** 2 / np.maximum(expected, 1e-9), 0.0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:features])
    chosen = chosen[chi[chosen] > 0]
    rng = np.random.default_rng(11)
    model = {"w0": smooth, "w": np.zeros(len(chosen)), "v": rng.normal(0, 0.05, (len(chosen), factors)), "slots": chosen}
    if not 0 < positive < n or not len(chosen):
        return model
    index = np.full(SPACE, -1, dtype=np.int64)
    index[chosen] = np.arange(len(chosen))
    keep = index[slots] >= 0
    rows, present = rows[keep], index[slots[keep]]
    starts = np.searchsorted(rows, np.arange(n + 1))
    state = {k: [np.zeros_like(np.asarray(model[k], float)) for _ in range(2)] for k in ("w0", "w", "v")}
    step = 0
    for epoch in range(epochs):
        rate = 0.03 * (1 - epoch / epochs) + 0.001
        for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
            count = starts[batch + 1] - starts[batch]
            r = np.repeat(np.arange(len(batch)), count)
            p = present[np.repeat(starts[batch] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            z, sums = _logit(p, r, len(batch), model)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]
            e = error[r] / len(batch)
            grad_v = np.zeros_like(model["v"])
            np.add.at(grad_v, p, e[:, None] * (sums[r] - model["v"][p]))
            grads = {"w0": error.mean(), "w": np.bincount(p, weights=e, minlength=len(chosen)) + 1e-4 * model["w"], "v": grad_v + 1e-3 * model["v"]}
            step += 1
            for k, g in grads.items():
                m, s = state[k]
                m[...] = 0.9 * m + 0.1 * g
                s[...] = 0.999 * s + 0.001 * g * g
                model[k] = model[k] - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return model


def _fit_group(options: dict):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        lists = [np.asarray(x.values, dtype=np.int64) for x in rows.column("slots")]
        model = fit(lists, rows.column("toxic").to_numpy().astype(float), **options)
        return pa.table({"w0": pa.array([float(model["w0"])]), "slots": pa.array([model["slots"].tolist()], pa.list_(pa.int64())),
                         "w": pa.array([model["w"].tolist()], pa.list_(pa.float64())), "v": pa.array([model["v"].ravel().tolist()], pa.list_(pa.float64()))})
    return run


def held_out(doc_id) -> "F.Column":
    """Whether a row's labels are kept from the model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> dict:
    """The model, fitted on at most ``sample`` labelled documents that are not held out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # `sample` rows of two numbers: a bounded broadcast
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(known), "doc_id"))
    # of a doc_id with several texts the one with the smallest hash teaches, whatever the partitioning
    text = F.coalesce("text", F.lit(""))
    rows = (rows.groupBy("doc_id", "toxic").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
            .mapInArrow(_sampled, "doc_id long, toxic int, slots array<int>"))
    got = (rows.groupBy(F.lit(0).alias("one")).applyInArrow(_fit_group(options), "w0 double, slots array<long>, w array<double>, v array<double>")).collect()
    if not got:
        return {"w0": 0.0, "slots": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, 1))}
    w = np.array(got[0]["w"])
    return {"w0": got[0]["w0"], "slots": np.array(got[0]["slots"], np.int64), "w": w, "v": np.array(got[0]["v"]).reshape(len(w), -1) if len(w) else np.zeros((0, 1))}


def _scorer(shared):
    def run(batches):
        model = shared.value
        index = np.full(SPACE, -1, dtype=np.int32)
        index[model["slots"]] = np.arange(len(model["slots"]))
        width = max(1, len(model["slots"]))
        for b in batches:
            for first, n, owner, slots in _terms(b.column(1)):
                found = index[slots]
                row, col = np.nonzero(found >= 0)
                keys = np.unique(owner[row] * width + found[row, col])
                z, _ = _logit(keys % width, keys // width, n, model)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_scorer(shared)), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    rows = score(docs, train(docs, labels, **options))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _passing(shared):
    def run(batches):
        for b in batches:
            scores = list(_scorer(shared)([b.select(["doc_id", "text"])]))
            keep = np.concatenate([s.column(1).to_numpy() for s in scores]) < 0.5 if scores else np.zeros(0, bool)
            yield b.filter(pa.array(keep))
    return run


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows predicted toxic, decided in one pass over the rows as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    return docs.mapInArrow(lean(_passing(shared)), docs.schema)


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
