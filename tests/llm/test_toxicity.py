import random
from zlib import crc32

import numpy as np

from halcyon.llm import toxicity


def corpus():
    """Toxic if a term of each of two families meets: neither family alone says anything."""
    random.seed(6)
    word = lambda: "".join(random.choice("aeioubcd") for _ in range(6))
    filler = [word() for _ in range(60)]
    rows, labels = [], []
    for i in range(1600):
        a, b = random.random() < 0.5, random.random() < 0.5
        w = random.choices(filler, k=random.randint(5, 40)) + ["zzinsult"] * a + ["qqgroup"] * b
        random.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a and b)))
    return rows, labels


def test_learns_pairs_of_terms(spark, frame):
    rows, labels = corpus()
    truth = dict(labels)
    got = toxicity.toxicity(frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark, frame):
    rows, labels = corpus()
    rows, labels = rows[:300], labels[:300]
    flipped = [(i, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(frame(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_input(spark, frame):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 50000), (3, "word"), (4, "bad stuff"), (5, "good stuff")]
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (5, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(rows), labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert next(r for r in got if r.doc_id is None).held_out
    assert {r.score for r in toxicity.toxicity(frame(rows), labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(frame(rows).limit(0), labels).count() == 0


def test_pairwise_term_equals_the_double_sum():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=6), "v": rng.normal(size=(6, 3))}
    have = [0, 2, 5]
    want = 0.3 + model["w"][have].sum() + sum(model["v"][a] @ model["v"][b] for i, a in enumerate(have) for b in have[i + 1:])
    z, _ = toxicity._logit(np.array(have), np.zeros(3, int), 1, model)
    assert abs(z[0] - want) < 1e-9
