import random
import re
from collections import Counter, defaultdict

import pytest

from halcyon.llm import phrases

from .conftest import LOWER


def brute(docs, min_count, top, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= min_count}
        drop = {g[i:i + k] for g, a in cand.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= share * c[g[i:i + k]]}
        rows = []
        for g, a in cand.items():
            if g not in drop:
                score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    common = ["the cat sat on the mat and then it went away to sleep", "terms of use apply", "a b a b a b a b a b", "one ring to rule"]
    vocab = [f"w{k}" for k in range(30)] + ["É", "ÉA", "the", "cat"]
    docs = []
    for k in range(160):
        parts = [rng.choice(common) if rng.random() < .5 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        docs.append((rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", ". ", ",", "\n", "\t"]).join(parts)))
    docs += [("en", None), ("en", ""), (None, " .,! "), ("en", "The CAT Sat on the mat"), ("fr", "x " * 3000), ("fr", "nbsp\xa0stays one word. " * 5)]
    return docs + docs[:20]


@pytest.mark.parametrize("min_count, top, cell_bits", [(3, 2000, None), (5, 7, 20), (2, 50, 22), (1, 4000, None)])
def test_against_brute_force(frame, min_count, top, cell_bits):
    docs = corpus()
    rows = phrases.collocations(frame([(k, t, lang) for k, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string"),
                                min_count, top, cell_bits=cell_bits).collect()
    assert sorted(map(tuple, rows)) == brute(docs, min_count, top)


def test_small_flushes_and_shared_counters(frame, monkeypatch):
    # every pair in one of few counters: nothing is cut, results stay the same
    docs = corpus()
    rows = frame([(k, t, lang) for k, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "WORDS", 50)
    monkeypatch.setattr(phrases, "frequent_pairs", lambda texts, least, bits: b"\xff" * ((1 << bits) // 8))
    assert sorted(map(tuple, phrases.collocations(rows, 3).collect())) == brute(docs, 3, 2000)


def test_paths(spark):
    """Chains of equal weight become one path; branches, ends and rings stay apart."""
    text = "a b c d e f g h. " * 5 + "x y z q. x y z r. " * 3 + "x y z q s. " * 2
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    grams = phrases.gram_counts(docs, 2)
    three = phrases._flow(grams, 3).where("f >= 2")
    four = grams.where("w4 <> 0 AND c >= 2").selectExpr("lang", "w1", "w2", "w3", "w4", "c AS f")
    word = {r.w1: r.word for r in grams.where("word IS NOT NULL").collect()}
    old, phrases.BREAK = phrases.BREAK, 1 << 40
    try:
        paths, inside = phrases.compact_paths(four, three)
        got = sorted((" ".join(word[w] for w in r.words), r.f) for r in paths.collect())
    finally:
        phrases.BREAK = old
    assert got == [("a b c d e f g h", 5), ("x y z q", 5), ("x y z r", 3), ("y z q s", 2)]
    assert sorted(" ".join(word[w] for w in r[1:4]) for r in inside.collect()) == ["b c d", "c d e", "d e f", "e f g"]


def test_empty(frame):
    assert phrases.collocations(frame([(1, "a b", "en")], "doc_id long, text string, lang string").limit(0)).count() == 0
