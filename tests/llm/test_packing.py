import random

from tokenizers import Tokenizer

from halcyon.llm import bpe, packing


def brute(lengths, width):
    rows, used, rests = [], [], []
    for d, n in enumerate(lengths):
        a = 0
        while n - a > width:
            rows.append([(d, a, a + width)])
            used.append(width)
            a += width
        rests.append((n - a, d, a))
    for n, d, a in sorted(rests, key=lambda x: (-x[0], x[1])):
        fits = [(width - u, r) for r, u in enumerate(used) if width - u >= n]
        r = min(fits)[1] if fits else len(rows)
        if r == len(rows):
            rows.append([])
            used.append(0)
        used[r] += n
        rows[r].append((d, a, a + n))
    return rows


def test_best_fit_decreasing():
    random.seed(1)
    for _ in range(300):
        width, lengths = random.randint(1, 40), [random.randint(1, 100) for _ in range(random.randint(0, 40))]
        got, want = packing.pack(lengths, width), brute(lengths, width)
        fill = lambda rows: sorted(sum(b - a for _, a, b in r) for r in rows)
        assert fill(got) == fill(want) and max(fill(got), default=0) <= width
        assert sorted((d, x) for r in got for d, a, b in r for x in range(a, b)) == [(d, x) for d, n in enumerate(lengths) for x in range(n)]


def test_round_trip(frame, tmp_path):
    rows = [(i, "some words " * (i % 9) + "é<|endoftext|>") for i in range(60)] + [(70, None), (71, ""), (72, "long text " * 900), (5, "again"), (None, "no id")]
    docs = frame(rows)
    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.encode_special_tokens = True
    want = sorted((d or -1, tuple(t.encode(x or "", add_special_tokens=False).ids + [packing.END])) for d, x in rows)
    out = packing.packed_matrices(docs, width=64, bucket_bytes=3000).collect()
    parts = {}
    for r in out:
        assert len(r.ids) == len(r.positions) == 64 and r.cu_seqlens[0] == 0
        for k, d in enumerate(r.docs):
            a, b = r.cu_seqlens[k:k + 2]
            parts.setdefault((r.bucket, d.place, d.doc_id), []).append((d.first, r.ids[a:b]))
            assert r.positions[a:b] == list(range(b - a))
        assert set(r.ids[r.cu_seqlens[-1]:]) <= {packing.PAD}
    assert sorted((k[2] or -1, tuple(i for _, ids in sorted(v) for i in ids)) for k, v in parts.items()) == want
    packing.write_packed(docs, str(tmp_path / "out"), width=64)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert {len(r.ids) for r in back.collect()} == {256}
    assert packing.packed_matrices(docs.limit(0)).count() == 0
