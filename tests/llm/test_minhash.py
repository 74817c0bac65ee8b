import random

import numpy as np
import pytest

from halcyon.llm import minhash
from tests.llm.conftest import components_of, shingles_of


def corpus():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6)))
    rows = [(i, " ".join(word() for _ in range(random.randint(1, 120)))) for i in range(80)]
    base = [word() for _ in range(90)]
    for k in range(140):                                             # a group of near copies at all distances
        w = list(base)
        for _ in range(random.randint(0, 7)):
            w[random.randrange(len(w))] = word()
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, rows[3][1].upper() if k % 2 else rows[3][1]) for k in range(50)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "One\tTWO "), (3005, "two one"), (None, rows[5][1]), (7, rows[7][1]),
             (3006, "word " * 4000), (3007, "word " * 4100)]
    return rows


@pytest.mark.parametrize("small, chunk", [(64, 512), (4, 16)])
def test_against_brute_force(frame, monkeypatch, small, chunk):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = corpus()
    got = minhash.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    sets = {d: shingles_of(t) for d, t in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components_of(links, ids)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 3000):
        s = minhash.sketch(rng.integers(0, 2 ** 63, n).astype(np.uint64), np.array([0, n]))
        assert s.shape == (1, minhash.T) and len(np.unique(s)) == minhash.T
    a = rng.integers(0, 2 ** 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:750], rng.integers(0, 2 ** 63, 250).astype(np.uint64)])
    s = minhash.sketch(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.13


def test_one_of_each_keeps_columns(frame):
    docs = frame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y"), (None, "a b c d e f")])
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [1, 3]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_of_repeated_rows_and_rows_without_id(frame):
    rows = [(1, "a b c d e f")] * 3 + [(7, "one two three four five")] * 2 + [(7, "another text under this id stays too")]
    rows += [(None, "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"), (None, "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"), (None, "p q r s t u v w x y z 1 2 3 4 5 6 7 8 0"),
             (None, None), (None, ""), (None, None), (9, None), (9, None), (10, "")]
    got = sorted((str(r.doc_id), r.text or "") for r in minhash.one_of_each(frame(rows)).collect())
    want = [("1", "a b c d e f"), ("7", "one two three four five"), ("7", "another text under this id stays too"), ("9", ""), ("10", ""), ("None", "")]
    near = [x for x in got if x[1].startswith("p q")]
    assert len(near) == 1 and sorted(x for x in got if x not in near) == sorted(want)
