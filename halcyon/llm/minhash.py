"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

Sketch (``T`` = 256 coordinates).  In round i < T every shingle throws one
hashed value into one hashed bin; in round T + b every shingle throws into bin
b.  A coordinate keeps the smallest (round, value), so rounds stop when every
bin is filled and all are after 2T rounds at the latest.  Coordinates agree with
probability equal to the sets' Jaccard similarity, with concentration bounds.

Links: documents with the same shingle set are one class with a representative
(aggregates only).  Representatives meet where all ``ROWS`` coordinates of a
band agree (32 bands of 4: a pair at 0.75 is missed with probability 5e-6).
Pairs are dropped whose sizes rule out 0.75, or whose sketches agree in fewer
than ``AGREE`` of the 256 coordinates (4.5 deviations under what 0.75 gives); the
others are confirmed on their full shingle sets.

No bucket is expanded into all its pairs.  First each member is paired with its
bucket's most central member (the one with most bucket mates overall), and
confirmed links are joined into components.  Then, in buckets that still hold
several components, the members outside the bucket's largest component are
compared with all members of other components.  Pairs within a component need
no check, and the Jaccard distance is a metric, so neither do pairs whose exact
distances to their bucket's central member differ by more than the limit; the
components are those of all the links among bucket mates.  Buckets of up to
``SMALL`` members do this as a join of pairs.  Larger ones are cut into tiles of
two chunks of ``CHUNK`` members, which travel with their sets: a tile checks its
pairs by itself (each pair in the first bucket it shares) and returns links only.

Defined results for odd input: no words or null text: size 0, linked with
nothing; a null doc_id: no component, kept; rows that repeat a doc_id are the
same document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from halcyon.llm.common import BROADCAST_IDS, DOCUMENT_ROWS, lean, rows_per_batch, small, staged, table
from halcyon.llm.components import connected_components
from halcyon.llm.words import groups, hashed, mix, shingle_set
from halcyon.plans.registry import register

T, ROWS, BANDS = 256, 4, 32
#: link if 100 * intersection >= SHARE * union
SHARE = 75
#: of the 256 coordinates (4 bits of each are kept) a pair at 0.75 agrees in 196, with a deviation of 6.8
AGREE = 165
#: members of a bucket whose pairs are joined; members in a chunk of a larger bucket
SMALL, CHUNK = 64, 512
TRAITS = [f"s{k}" for k in range(T // 16)]

_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOW = _U((1 << 55) - 1)


def sketch(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets x T) coordinates of the non-empty sets ``items[starts[k]:starts[k + 1]]``."""
    n = len(starts) - 1
    out = np.full(n * T, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    active = items
    for i in range(2 * T):
        h = mix(active ^ _SEEDS[i])
        value = (_U(i) << _U(55)) | (h & _LOW)
        bins = (h >> _U(56)).astype(np.int64) if i < T else i - T
        np.minimum.at(out, owner * T + bins, value)
        if i % 4 == 3 or i < 4:
            open_sets = (out.reshape(n, T) == np.iinfo(np.uint64).max).any(axis=1)
            if not open_sets.any():
                break
            more = open_sets[owner]
            if not more.all():
                active, owner = active[more], owner[more]
    # the round is part of a coordinate; mixing makes any of its bits usable
    return mix(out.reshape(n, T))


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                     ("bands", pa.list_(pa.int64())), *[(c, pa.int64()) for c in TRAITS]])
_SKETCH_DDL = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{c} long" for c in TRAITS)
_ROLE = mix(np.arange(1, T + 1, dtype=np.uint64)) | _U(1)


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, docs in groups(column):
        words, at = hashed(docs)
        yield first, [shingle_set(words[at[k]:at[k + 1]]) for k in range(len(docs))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch.column(1)):
            size = np.array([len(s) for s in sets], dtype=np.int64)
            sums = np.array([[s.sum(dtype=np.uint64), mix(s ^ _SEEDS[0]).sum(dtype=np.uint64)] for s in sets], dtype=np.uint64)
            full = np.flatnonzero(size)
            bands, bits = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(TRAITS), len(sets)), np.int64)
            if len(full):
                s = sketch(np.concatenate([sets[k] for k in full]), np.concatenate([[0], np.cumsum(size[full])]))
                banded = (s * _ROLE)[:, :BANDS * ROWS].reshape(len(full), BANDS, ROWS)
                bands[full] = mix(banded.sum(axis=2, dtype=np.uint64)).view(np.int64)
                nibbles = (s & _U(15)).astype(np.uint8)
                bits[:, full] = (nibbles[:, ::2] | nibbles[:, 1::2] << 4).view(np.int64).T
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, bands.ravel())
            sums = sums.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(size), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                                              lists, *map(pa.array, bits)], schema=_SKETCH)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])


def _similarity(batches):
    for b in batches:
        common, union = np.zeros(b.num_rows, dtype=np.int64), np.ones(b.num_rows, dtype=np.int64)
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common[i] = (both[1:] == both[:-1]).sum()
            union[i] = len(both) - common[i]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common), pa.array(union)], names=["a", "b", "common", "either"])


def _close(x: str, y: str, share: int):
    """What sizes and sketches allow for a linked pair."""
    nibble = 0x1111111111111111
    differ = F.lit(0)
    for c in TRAITS:
        z = F.col(f"{x}_{c}").bitwiseXOR(F.col(f"{y}_{c}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(nibble)))
    small, large = F.least(f"{x}_n_shingles", f"{y}_n_shingles"), F.greatest(f"{x}_n_shingles", f"{y}_n_shingles")
    return (100 * small >= share * large) & (differ <= T - AGREE)


def _of(traits: DataFrame, side: str) -> DataFrame:
    return traits.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n_shingles", *TRAITS)])


def _tile_links(share: int):
    """The links between different components among the members of one tile, at most a spanning forest of them."""
    def run(key, rows):
        chunk, node, c = (rows.column(n).to_numpy() for n in ("chunk", "node", "c"))
        size, band = rows.column("n_shingles").to_numpy(), rows.column("band")[0].as_py()
        far = rows.column("far").to_numpy(zero_copy_only=False)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        sketches = np.stack([rows.column(t).to_numpy() for t in TRAITS], axis=1).view(np.uint64)
        i, j = key[1].as_py(), key[2].as_py()
        left, right = (np.flatnonzero(chunk == k) for k in (i, j))
        found_a, found_b = [], []
        parent = list(range(len(node)))

        def root(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        first: dict = {}
        for k, comp in enumerate(c.tolist()):
            parent[k] = first.setdefault(comp, k)
        sets = rows.column("shingles")
        cache: dict = {}

        def shingles(k):
            if k not in cache:
                cache[k] = np.frombuffer(sets[int(k)].as_buffer(), np.uint64)
            return cache[k]

        for a in range(0, len(left), 128):
            x, y = (g.ravel() for g in np.meshgrid(left[a:a + 128], right, indexing="ij"))
            ok = (c[x] != c[y]) & (100 * np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y]))
            ok &= ~(np.abs(far[x] - far[y]) > 1 - share / 100 + 1e-9)
            if i == j:
                ok &= x < y
            x, y = x[ok], y[ok]
            for b in range(band):  # a pair is checked in the first bucket that it shares
                other = bands[x, b] != bands[y, b]
                x, y = x[other], y[other]
            differ = np.zeros(len(x), dtype=np.int64)
            for t in range(len(TRAITS)):
                z = sketches[x, t] ^ sketches[y, t]
                z |= z >> _U(1)
                z |= z >> _U(2)
                differ += np.bitwise_count(z & _U(0x1111111111111111))
            near = differ <= T - AGREE
            for p, q in zip(x[near].tolist(), y[near].tolist()):
                if root(p) == root(q):
                    continue
                both = np.concatenate([shingles(p), shingles(q)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= share * (len(both) - common):
                    parent[root(p)] = root(q)
                    found_a.append(max(node[p], node[q]))
                    found_b.append(min(node[p], node[q]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})
    return run


def _sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, shingles for the documents named in ``nodes``."""
    nodes = small(nodes.withColumnRenamed("node", "wanted"))
    texts = docs.join(nodes, docs["doc_id"] == nodes["wanted"], "left_semi")
    return staged(texts.select("doc_id", "text").mapInArrow(lean(_full_sets), "node long, shingles binary"))


def _measured(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of the intersection and union of their full shingle sets."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    with rows_per_batch(docs.sparkSession, 512):
        return staged(both.select("a", "b", "x", "y").mapInArrow(lean(_similarity), "a long, b long, common long, either long"))


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    with rows_per_batch(docs.sparkSession, DOCUMENT_ROWS):
        return _near_duplicates(docs, share)


def _near_duplicates(docs: DataFrame, share: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_docs = staged(docs.mapInArrow(lean(_sketches), _SKETCH_DDL))
    full = all_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    traits = ["bands", *TRAITS]
    classes = staged(full.groupBy(*same).agg(F.min("doc_id").alias("node"), *[F.any_value(c).alias(c) for c in traits]))
    members = staged(full.select("doc_id", *same).join(classes.select("node", *same), same).select("doc_id", "node"))
    # a bucket's members against its most central one
    spots = classes.select(F.posexplode("bands").alias("band", "bucket"), "node")
    heads = spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spots = staged(spots.join(heads, "bucket"))
    mates = spots.groupBy("node").agg(F.sum("n").alias("mates"))
    heads = (spots.join(mates, "node").groupBy("bucket").agg(F.max(F.struct("mates", "node")).alias("head"))
             .select("bucket", F.col("head.node").alias("head")))
    high, low = F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")
    spots = staged(spots.join(heads, "bucket").select("bucket", "band", "node", "head"))
    pairs = spots.where("node <> head").select(high, low).distinct()
    pairs = staged(pairs.join(_of(classes, "a"), "a").join(_of(classes, "b"), "b").where(_close("a", "b", share)).select("a", "b"))
    measured = _measured(pairs, docs)
    linked = 100 * F.col("common") >= share * F.col("either")
    links = measured.where(linked).select("a", "b")
    found = staged(connected_components(links))
    # buckets that hold several components: what is outside the largest one against all others
    far = F.when(F.col("node") == F.col("head"), 0.0).otherwise(1 - F.col("common") / F.col("either"))
    spots = (spots.select("*", high, low).join(measured, ["a", "b"], "left").join(found, "node", "left")
             .select("bucket", "band", "node", F.coalesce("component", "node").alias("c"), far.alias("far")))
    sizes = spots.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = (sizes.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("most"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where("k > 1")
             .select("bucket", F.col("most.c").alias("main"), "n"))
    spots = staged(spots.join(mixed, "bucket"))
    few, large = spots.where(F.col("n") <= SMALL), spots.where(F.col("n") > SMALL)
    minor = few.where("c <> main").select("bucket", F.col("node").alias("x"), "c", F.col("far").alias("x_far")).join(_of(classes, "x"), "x")
    other = few.select("bucket", F.col("node").alias("y"), F.col("c").alias("d"), "main", F.col("far").alias("y_far")).join(_of(classes, "y"), "y")
    fresh = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("main")) | (F.col("x") < F.col("y")))
    apart = F.coalesce(F.abs(F.col("x_far") - F.col("y_far")) > 1 - share / 100 + 1e-9, F.lit(False))
    rest = (minor.alias("p").join(other.alias("q"), (F.col("p.bucket") == F.col("q.bucket")) & fresh & ~apart & _close("x", "y", share))
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    rest = staged(rest.join(pairs, ["a", "b"], "left_anti"))
    more = _measured(rest, docs).where(linked).select("a", "b")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    large = large.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = large.select("bucket", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk", "band", "node", "c", "far")
    sets = _sets_of(large.select("node").distinct(), docs)
    large = large.join(classes.select("node", "n_shingles", "bands", *TRAITS), "node").join(sets, "node")
    tiles = large.groupBy("bucket", "i", "j").applyInArrow(_tile_links(share), "a long, b long")
    more = staged(more.unionByName(tiles))
    if not more.isEmpty():
        # links between components found before: join these only
        for end in ("a", "b"):
            of = found.select(F.col("node").alias(end), F.col("component").alias("c"))
            more = more.join(of, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        # one row a component, two ids each: a component may hold most rows of the other side
        joined = small(connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("whole")), BROADCAST_IDS // 2)
        singles = joined.join(found.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
        found = found.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(singles)
    component = (members.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
                 .groupBy("doc_id").agg(F.min("component").alias("component")))
    out = all_docs.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """``docs`` without the near copies: of each group one document stays, that with the smallest id.

    Rows without id take part under a number made of their text's hash, above all ids, so a copy that has an id stays
    rather than they.  Of rows that repeat id and text one stays (that with the smallest hash of all columns);
    rows that repeat an id with other texts are one document and stay or go together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    near = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), share)
    gone = small(near.where("NOT kept").select(F.col("doc_id").alias("_key")).distinct())
    again = small(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"))
    rows = keyed.join(gone, "_key", "left_anti")
    repeated = rows.join(again, "_key", "left_semi").groupBy("_key", F.sha2(text, 256).alias("_text")).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return rows.join(again, "_key", "left_anti").select(*docs.columns).unionByName(repeated)


@register("op9_minhash")
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
