"""BPE encoding and decoding through a distinct-word table.

1. Spark splits every whole text into pre-tokens (the byte-level pattern, after
   the special token's string has been cut out).  A task turns a batch of
   documents into a *block*: its distinct words and, for every position of
   every document, the number of the word that stands there.
2. The blocks' distinct words are dealt by a hash of the word, so all mentions
   of a word meet in one bucket; each distinct word is encoded once and its
   ids go back to the blocks that hold it.
3. A block joins the ids to its positions and has its documents' id sequences.
   Decoding joins each id to its piece (a table as long as the vocabulary) and
   puts the pieces together in the same order.

Blocks are named by the task and batch they come from, so ``docs`` must come in
the same partitions when read again: a table does, and so does ``staged``.

Texts never travel: a shuffle carries word numbers (compressed), each block's
distinct words and their ids.  Blocks and buckets have bounded size (``BLOCK``,
``BUCKET``) and their number follows the input.

Defined results for odd input: null text is empty; an empty text has no ids and
decodes to the empty text; rows that repeat and null doc_ids are rows like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from halcyon.llm.common import parts, table
from halcyon.llm.words import mix
from halcyon.plans.registry import register

#: Fixed value: how byte-level BPE splits text before its merges, with Unicode white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: bytes of text in a block and of distinct words in a bucket, about
BLOCK, BUCKET = 16 << 20, 2 << 20
#: positions worked on at once
AT_ONCE = 200_000
_ROW = "block string, bucket int, blob binary"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_TOKENIZER: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def words_of(text: Column) -> Column:
    """The pre-tokens of a text, in order; the special token's string is one of its own."""
    def split(x):
        return F.regexp_extract_all(x, F.lit(PATTERN), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    segments = F.transform(F.split(text, r"<\|endoftext\|>", -1), lambda x: F.concat(F.array(F.lit(SPECIAL)), split(x)))
    cut = F.flatten(segments)
    return F.when(F.contains(text, F.lit(SPECIAL)), F.slice(cut, 2, F.size(cut))).otherwise(split(text))


_ZSTD = pa.Codec("zstd", compression_level=6)


def _dump(value) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _load(blob: bytes):
    blob = memoryview(blob)
    return pickle.loads(_ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little")))


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """Non-negative numbers as byte streams that compress well: a byte for those under 255,
    the mark 255 and two bytes for those under 65,280 more, the mark twice and eight bytes for the rest."""
    big = x[x >= 255].astype(np.int64) - 255
    high = np.minimum(big >> 8, 255)
    return [np.minimum(x, 255).astype(np.uint8), high.astype(np.uint8), (big[high < 255] & 255).astype(np.uint8), big[high == 255]]


def _unplanes(planes: list[np.ndarray]) -> np.ndarray:
    small, high, low, rest = planes
    big = high.astype(np.int64) << 8
    big[high < 255] |= low
    big[high == 255] = rest
    out = small.astype(np.int64)
    out[small == 255] = big + 255
    return out


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of the words."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A hash of each word's bytes (a sum of mixed (byte, place) values) as its bucket."""
    out = np.zeros(len(words), dtype=np.int64)
    # a byte takes many times its size here: some words at a time
    for a in range(0, len(words), AT_ONCE // 16):
        offsets, data = _bytes_of(words.slice(a, AT_ONCE // 16))
        place = np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix((place << np.uint64(8)) | data), dtype=np.uint64)])
        out[a:a + AT_ONCE // 16] = mix(total[offsets[1:]] - total[offsets[:-1]]) % np.uint64(buckets)
    return out


def _block(name: str, docs: list[pa.RecordBatch], buckets: int, words_only: bool) -> Iterator[dict]:
    """A block's positions as one row (bucket -1), or its distinct words as a row for each bucket."""
    ids = pa.concat_arrays([b.column(0) for b in docs])
    lengths = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in docs])
    # the words of a block are as large as its batches: only their numbers are put together, and worked through in pieces
    coded = pa.chunked_array([b.column(1).flatten() for b in docs]).dictionary_encode()
    dictionary = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
    places = [c.indices.slice(a, AT_ONCE).to_numpy(zero_copy_only=False) for c in coded.chunks for a in range(0, len(c), AT_ONCE)]
    del docs, coded
    # number the words by frequency, then the common numbers are small
    often = np.zeros(len(dictionary), dtype=np.int64)
    for at in places:
        often += np.bincount(at, minlength=len(often))
    order = np.argsort(-often, kind="stable")
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order))
    known = dictionary.take(pa.array(order))
    # positions and words come from two scans: the name tells whether both have cut the same block
    seen = hashlib.blake2b(repr(ids.to_pylist()).encode(), digest_size=12)
    for part in (lengths, *_bytes_of(known)):
        seen.update(np.ascontiguousarray(part).tobytes())
    name = f"{name}-{seen.hexdigest()}"
    if not words_only:
        planes = [np.concatenate(x) for x in zip(_planes(number[:0]), *(_planes(number[at]) for at in places))]
        yield {"block": name, "bucket": -1, "blob": _dump((ids.to_pylist(), lengths, planes))}
        return
    bucket = _bucket_of(known, buckets) if len(known) else np.zeros(0, np.int64)
    # in alphabetical order within a bucket: words and ids compress better
    by = np.lexsort((pc.rank(known).to_numpy(), bucket)) if len(known) else bucket
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    for mine in np.split(by, cuts) if len(by) else []:
        yield {"block": name, "bucket": int(bucket[mine[0]]), "blob": _dump((mine.astype(np.int32), *_bytes_of(known.take(pa.array(mine)))))}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary())]))


def _to_blocks(buckets: int, size: int, words_only: bool):
    def run(batches):
        task, held, total, n = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            # a batch of long texts is taken apart, so that blocks stay near their size
            starts = np.concatenate([[0], np.cumsum(b.column(2).to_numpy(zero_copy_only=False))])
            a = 0
            while a < b.num_rows:
                c = max(a + 1, int(np.searchsorted(starts, starts[a] + size - total, side="right")) - 1)
                held.append(b.slice(a, c - a))
                total += int(starts[c] - starts[a])
                a = c
                if total >= size or a < b.num_rows:
                    for row in _block(f"{task}-{n}", held, buckets, words_only):
                        yield _batch([row])
                    held, total, n = [], 0, n + 1
                    pa.default_memory_pool().release_unused()
        if held:
            for row in _block(f"{task}-{n}", held, buckets, words_only):
                yield _batch([row])
    return run


def _tokenizer(shared):
    key = shared.value[0]
    if key not in _TOKENIZER:
        import os
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(shared.value[1])
        t.no_truncation()
        t.no_padding()
        _TOKENIZER.clear()
        pieces = _pieces(shared.value[1])
        _TOKENIZER[key] = (t, Spelling(pieces), Spelling([b"%d," % i for i in range(len(pieces))]))
    return _TOKENIZER[key]


def _pieces(spec: str) -> list[bytes]:
    """The bytes of each id: the vocabulary writes byte b as a printable character, by the rule
    that printable Latin-1 stands for itself and the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    spec = json.loads(spec)
    vocab = dict(spec["model"]["vocab"])
    out = [b""] * (1 + max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]))
    for piece, i in vocab.items():
        out[i] = bytes(byte[c] for c in piece)
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def _encode_bucket(shared):
    """All blocks' mentions of one bucket's words: each distinct word is encoded once."""
    def run(rows: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(shared)[0]
        blobs = [_load(x.as_buffer()) for x in rows.column("blob")]
        mentions = [pa.StringArray.from_buffers(len(mine), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())) for mine, offsets, data in blobs]
        coded = pa.concat_arrays(mentions).dictionary_encode()
        ids, distinct = [], coded.dictionary.to_pylist()
        for a in range(0, len(distinct), 4096):
            ids += [e.ids for e in tokenizer.encode_batch_fast(distinct[a:a + 4096], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat, start = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=count.sum()), np.cumsum(count) - count
        at, done, out = coded.indices.to_numpy(), 0, []
        for block, (mine, _, _) in zip(rows.column("block").to_pylist(), blobs):
            mentioned = at[done:done + len(mine)]
            done += len(mine)
            n = count[mentioned]
            where = np.repeat(start[mentioned] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append({"block": block, "bucket": 0, "blob": _dump((mine, n.astype(np.uint32), _planes(flat[where])))})
        return pa.Table.from_batches([_batch(out)])
    return run


class Spelling:
    """A table from ids to byte strings, and what sequences of ids spell (no loop over ids)."""

    def __init__(self, strings: list[bytes]):
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ``ids`` one after the other, and where those of each begin (and the last end)."""
        n = self.ends[ids + 1] - self.ends[ids]
        begin = np.concatenate([[0], np.cumsum(n)])
        return self.data[np.repeat(self.ends[ids] - begin[:-1], n) + np.arange(begin[-1])], begin


def _documents(rows: pa.Table) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """A block's ids joined back to its positions: (doc_ids, all their ids, where each document's begin) of some documents at a time."""
    docs, marks, flats, counts = None, [], [], []
    for bucket, blob in zip(rows.column("bucket").to_pylist(), rows.column("blob")):
        got = _load(blob.as_buffer())
        if bucket < 0:
            docs = got
        else:
            marks.append(got[0])
            counts.append(got[1].astype(np.int64))
            flats.append(_unplanes(got[2]))
    none = np.zeros(0, dtype=np.int64)
    mark, count, flat = (np.concatenate([none, *x]).astype(np.int64) for x in (marks, counts, flats))
    start = np.cumsum(count) - count
    by = np.argsort(mark)  # word numbers are 0, 1, ...
    start, count = start[by], count[by]
    if docs is None:
        raise ValueError("the documents came in two different orders: write them out before they are encoded")
    doc_ids, lengths, planes = docs
    at = _unplanes(planes)
    if len(mark) != (at.max() + 1 if len(at) else 0):
        raise ValueError("words of a block are missing: write the documents out before they are encoded")
    ends = np.concatenate([[0], np.cumsum(lengths)])
    a = 0
    while a < len(doc_ids):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE, side="right")) - 1)
        here = at[ends[a]:ends[b]]
        n = count[here]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[here] - total[:-1], n) + np.arange(total[-1])]
        yield doc_ids[a:b], ids, total[ends[a:b + 1] - ends[a]]
        a = b


def _digests(shared, with_ids: bool):
    def run(rows: pa.Table) -> pa.Table:
        pieces, numbers = _tokenizer(shared)[1:]
        out: list = [[], [], [], [], []]
        for doc_ids, ids, begin in _documents(rows):
            raw, raw_at = pieces(ids)
            text, text_at = numbers(ids)
            out[0] += doc_ids
            out[1] += np.diff(begin).tolist()
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                decoded = raw[raw_at[a]:raw_at[b]].tobytes().decode("utf-8", "replace")
                out[2].append(hashlib.sha256(text[text_at[a]:max(text_at[a], text_at[b] - 1)]).hexdigest())
                out[3].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                out[4].append(pa.ListArray.from_arrays(begin.astype(np.int32), ids.astype(np.int32)))
        got = {k: pa.array(v, t) for k, v, t in zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), out, (pa.int64(), pa.int64(), pa.string(), pa.string()))}
        return pa.table(got | ({"ids": pa.chunked_array(out[4], pa.list_(pa.int32()))} if with_ids else {}))
    return run


def _sequences(shared):
    def run(rows: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        for doc_ids, ids, begin in _documents(rows):
            raw, raw_at = _tokenizer(shared)[1](ids)
            out[0] += doc_ids
            out[1].append(pa.ListArray.from_arrays(begin.astype(np.int32), ids.astype(np.int32)))
            out[2] += [raw[raw_at[a]:raw_at[b]].tobytes().decode("utf-8", "replace") for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "ids": pa.chunked_array(out[1], pa.list_(pa.int32())), "decoded": pa.array(out[2], pa.string())})
    return run


def _blocks(docs: DataFrame, tokenizer: str | None, block_bytes: int, bucket_bytes: int):
    """Each block's positions and its words with their ids, grouped by block, and the shared tokenizer."""
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((hashlib.sha256(spec.encode()).hexdigest(), spec))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    # a block's distinct words are about an eighth of its text
    buckets = parts((total or 0) / 8, bucket_bytes)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"),
                        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    # the texts are split twice, for the words and for the positions: keeping the split would cost half the input in disk
    positions, words = (split.mapInArrow(_to_blocks(buckets, block_bytes, only), _ROW) for only in (False, True))
    ids = words.groupBy("bucket").applyInArrow(_encode_bucket(shared), _ROW)
    return positions.unionAll(ids).groupBy("block"), shared


def encode_digests(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text; the ids too if asked for."""
    blocks, shared = _blocks(docs, tokenizer, block_bytes, bucket_bytes)
    return blocks.applyInArrow(_digests(shared, with_ids), _DIGEST + (", ids array<int>" if with_ids else ""))


def encode(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row of ``docs``."""
    blocks, shared = _blocks(docs, tokenizer, block_bytes, bucket_bytes)
    return blocks.applyInArrow(_sequences(shared), "doc_id long, ids array<int>, decoded string")


@register("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
