import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from halcyon.llm import bpe

ODD = [None, "", " ", "  \n\n x", "a<|endoftext|>b <|endoftext|><|endoftext|>", "I'll we've it's DON'T 'S", "  x\u0085y 12٣٤½",
       "\U0001f600\U0001f469‍\U0001f469 é", "\x1c\x1d a\x00b", "<|endoftext|>", "日本語 text", "x" * 5000, " \t \r\n end ", "same text", "same text"]


def test_as_the_library(frame):
    t = Tokenizer.from_file(bpe.default_tokenizer())
    rows = [(i, x) for i, x in enumerate(ODD)] + [(None, "no id"), (0, "again")]
    want = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids)))
    docs = frame(rows)
    for size in (20, 1 << 20):
        got = [(*tuple(r)[:4], tuple(r.ids)) for r in bpe.encode_digests(docs, block_bytes=size, bucket_bytes=size, with_ids=True).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_decoding_and_empty(frame):
    docs = frame(list(enumerate(ODD)))
    assert {r.doc_id: r.decoded for r in bpe.encode(docs).collect()} == {i: x or "" for i, x in enumerate(ODD)}
    assert bpe.encode_digests(docs.limit(0)).count() == 0


def test_blocks_cut_differently_in_both_scans_are_refused():
    def rows(ids, words):
        docs = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "words"])]
        return [next(bpe._block("0-0", docs, 4, only)) for only in (False, True)]

    same = rows([1, 2], [["a", "b"], ["a"]]), rows([1, 2], [["a", "b"], ["a"]])
    assert len({r["block"] for pair in same for r in pair}) == 1
    for other in (rows([2, 1], [["a", "b"], ["a"]]), rows([1, 2], [["a", "c"], ["a"]]), rows([1, 2], [["a"], ["a", "b"]])):
        assert other[0]["block"] != same[0][0]["block"]
    positions, words = same[0]
    for alone in (positions, words):
        with pytest.raises(ValueError):
            list(bpe._documents(pa.Table.from_batches([bpe._batch([alone])])))


def test_a_block_does_not_copy_its_words():
    rng = np.random.default_rng(2)
    batches = [pa.RecordBatch.from_arrays([pa.array([2 * k, 2 * k + 1]), pa.array([[f"word {i}" for i in rng.integers(0, 900, 50_000)] for _ in range(2)]), pa.array([1, 1])],
                                          names=["doc_id", "words", "bytes"]) for k in range(4)]
    plain, counted = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    for words_only in (False, True):
        pa.set_memory_pool(counted)
        try:
            rows = list(bpe._block("0-0", list(batches), 3, words_only))
        finally:
            pa.set_memory_pool(plain)
        assert [r["bucket"] for r in rows] == ([0, 1, 2] if words_only else [-1])
    assert counted.max_memory() < 0.6 * sum(b.column(1).nbytes for b in batches)


def test_a_block_takes_little_more_than_its_words():
    rng = np.random.default_rng(3)
    words = [f"word {i}" for i in rng.integers(0, 200_000, 1_000_000)]
    docs = [pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([words[:400_000], words[400_000:]])], names=["doc_id", "words"])]
    for words_only in (False, True):
        tracemalloc.start()
        try:
            rows = list(bpe._block("0-0", list(docs), 3, words_only))
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert [r["bucket"] for r in rows] == ([0, 1, 2] if words_only else [-1])
        assert most < 24_000_000


def test_a_word_has_one_bucket_in_all_blocks():
    rng = np.random.default_rng(6)
    words = [f"word {i}" for i in range(3000)]
    mixed = rng.permutation(words).tolist()
    a, b = (dict(zip(x, bpe._bucket_of(pa.array(x), 64).tolist())) for x in (words, mixed))
    assert a == b and len(set(a.values())) == 64
