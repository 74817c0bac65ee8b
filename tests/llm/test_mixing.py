import heapq
from collections import defaultdict

import pytest

from halcyon.llm import mixing


def fill(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by repeated sharing: whoever is above its cap is set to it and the rest is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= epochs * sizes[s]]
        if not over:
            return out | share
        out |= {s: epochs * sizes[s] for s in over}
        if len(over) == len(open_):
            return out


def seats(votes, caps, n):
    got = {k: 0 for k in votes}
    heap = [(-v, k) for k, v in votes.items() if caps[k] > 0 and v > 0]
    heapq.heapify(heap)
    while n and heap:
        _, k = heapq.heappop(heap)
        got[k], n = got[k] + 1, n - 1
        if got[k] < caps[k]:
            heapq.heappush(heap, (-votes[k] / (2 * got[k] + 1), k))
    return got


ROWS = [(i, " ".join(["w"] * (i % 13 * 7)), s) for i, s in enumerate(["b"] * 300 + ["a"] * 40 + [None] * 30 + ["é"] * 120 + ["c"] * 2)]
ODD = [(1, None, "x"), (1, None, "x"), (None, "one two", None), (2, "", "x"), (3, "long " * 3000, "y")]


@pytest.mark.parametrize("rows", [ROWS, ODD, ROWS[:300]])
def test_targets_quotas_and_limits(frame, rows):
    got = mixing.mix(frame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    sizes, texts = defaultdict(int), defaultdict(list)
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
        texts[d, len((t or "").split())].append(s)
    want = fill(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        source = texts[r.doc_id, r["size"]].pop()
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK


def test_apportionment_is_highest_quotients(spark):
    votes = {1: 5000.0, 2: 1200.0, 3: 1200.0, 4: 3.0, 5: 0.0, 6: 777.7}
    caps = {1: 51, 2: 99, 3: 13, 4: 99, 5: 99, 6: 8}
    rows = spark.createDataFrame([(k, v, caps[k], 83) for k, v in votes.items()], "k long, v double, cap long, n long")
    got = {r.k: r.won for r in mixing.apportion(rows, [], "k", "v", "cap", "n").collect()}
    assert got == seats(votes, caps, 83)


def test_reruns_agree_and_texts_follow(frame):
    docs = frame(ROWS, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (2, 5))
    assert a == b
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r["size"] == "extra"
    assert {r[0]: r[4] for r in a if r[4]} == dict(words)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_parts_keep_their_white_space(spark):
    text = "\n a\n\nb\tc  d\r\n e é " * 40
    docs = spark.createDataFrame([(i, text, f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    got = [r.text for r in mixing.mixed_texts(docs, block=7).collect()]
    assert all(t in text for t in got) and any(t != text for t in got)
    assert all(t == text or t[0] not in " \n" and t[-1] not in " \n" for t in got)
