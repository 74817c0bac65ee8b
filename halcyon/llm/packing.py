"""Token-id matrices: best-fit-decreasing packing of documents into rows of fixed width.

A document's tokens are the ids that the public byte-level BPE gives its whole
text plus an end-of-document id.  Documents are dealt by hash into buckets of
bounded token count; a bucket is one matrix:

- a document longer than ``WIDTH`` is split losslessly into full rows and a rest;
- all rests, longest first, go to the open row whose free space fits best.  A
  segment tree over free-space sizes counts the rows that have each size and
  finds the smallest one that is large enough in log(WIDTH) steps;
- the row's free tail is padding.

Every row comes with its ids, the cumulative segment lengths (from 0), position
ids that restart at each segment, and which part of which document a segment
is, so the documents can be put together again.

Defined results for odd input: null text is empty; an empty document is one
segment with the end id alone; equal and null doc_ids are documents of their
own (a segment also names its place among the bucket's documents); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from halcyon.llm.common import parts, table
from halcyon.plans.registry import register

#: Fixed value: how the vocabulary's byte-level BPE splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDTH = 2048
END, PAD = 50256, 50256
#: bytes of text in a bucket, about
BUCKET = 2 << 20
_ENCODINGS: dict = {}


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(shared):
    key = hash(shared.value)
    if key not in _ENCODINGS:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


class FreeSpace:
    """Open rows by free space 0..width: a segment tree of counts finds the best fit."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, space: int, n: int) -> None:
        i = space + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, row: int, space: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free space >= need, and that space (the row leaves the tree)."""
        i = need + self.leaves
        if not self.count[i]:
            # up to the first right neighbour that holds a row, then down its left edge
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        space = i - self.leaves
        self._add(space, -1)
        return self.rows[space].pop(), space


def pack(lengths: list[int], width: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (document, from, to) for documents of so many tokens; every token is in one row."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(lengths):
        full = n // width if n % width else n // width - 1
        rows += [[(d, k * width, (k + 1) * width)] for k in range(full)]
        if n > full * width:
            rests.append((n - full * width, d, full * width))
    rests.sort(key=lambda x: (-x[0], x[1]))
    free = FreeSpace(width)
    for n, d, start in rests:
        row, space = free.take(n) or (len(rows), width)
        if row == len(rows):
            rows.append([])
        rows[row].append((d, start, start + n))
        if space > n:
            free.put(row, space - n)
    return rows


_PACKED = ("bucket long, row int, ids array<int>, cu_seqlens array<int>, positions array<int>, "
           "docs array<struct<doc_id:bigint,place:int,first:bigint>>")


def _matrix(shared, width: int, end: int, pad: int):
    def run(rows: pa.Table) -> pa.Table:
        encoding = _encoding(shared)
        keys = list(zip(rows.column("doc_id").to_pylist(), rows.column("h").to_pylist()))
        rows = rows.take(pa.array(sorted(range(len(keys)), key=lambda k: (keys[k][0] is None, keys[k][0] or 0, keys[k][1])), pa.int64()))
        doc_ids = rows.column("doc_id").to_pylist()
        tokens = [np.array([*encoding.encode_ordinary(t.as_py() or ""), end], dtype=np.int32) for t in rows.column("text")]
        packed = pack([len(t) for t in tokens], width)
        ids = np.full((len(packed), width), pad, dtype=np.int32)
        positions = np.zeros((len(packed), width), dtype=np.int32)
        ends, docs = [], []
        for r, segments in enumerate(packed):
            at = [0]
            for d, a, b in segments:
                ids[r, at[-1]:at[-1] + b - a] = tokens[d][a:b]
                positions[r, at[-1]:at[-1] + b - a] = np.arange(b - a)
                at.append(at[-1] + b - a)
            ends.append(at)
            docs.append([{"doc_id": doc_ids[d], "place": d, "first": a} for d, a, _ in segments])
        n = len(packed)
        starts = np.arange(n + 1, dtype=np.int32) * width
        item = pa.struct([("doc_id", pa.int64()), ("place", pa.int32()), ("first", pa.int64())])
        return pa.table({"bucket": pa.array([rows.column("bucket")[0].as_py()] * n, pa.int64()), "row": pa.array(range(n), pa.int32()),
                         "ids": pa.ListArray.from_arrays(starts, ids.ravel()), "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                         "positions": pa.ListArray.from_arrays(starts, positions.ravel()), "docs": pa.array(docs, pa.list_(item))})
    return run


def packed_matrices(docs: DataFrame, width: int = WIDTH, ranks: str | None = None, end: int = END, pad: int = PAD, bucket_bytes: int = BUCKET) -> DataFrame:
    """bucket, row, ids (``width`` of them), cu_seqlens, positions, docs (doc_id, place and first token of each segment)."""
    with open(ranks or default_ranks(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    buckets = parts(docs.agg(F.sum(F.octet_length("text"))).first()[0], bucket_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    # every bucket a partition of its own, about: a matrix is packed in one task
    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_matrix(shared, width, end, pad), _PACKED)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Writes the matrices as Parquet, ids and positions as little-endian int32 binary of a row each."""
    packed = packed_matrices(docs, **options)

    def binary(batches):
        for b in batches:
            cols = []
            for n, c in zip(b.schema.names, b.columns):
                if n in ("ids", "positions"):
                    ends, flat = c.offsets.to_numpy(), c.values.to_numpy()
                    c = pa.array([flat[ends[i]:ends[i + 1]].astype("<i4").tobytes() for i in range(len(c))], pa.binary())
                cols.append(c)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    ddl = _PACKED.replace("ids array<int>, cu", "ids binary, cu").replace("positions array<int>", "positions binary")
    packed.mapInArrow(binary, ddl).write.mode("overwrite").parquet(path)


@register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(table(spark, sf_dir, "documents"))
