import re

import pytest

WORDS = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_of(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, in several partitions, with a clashing extra column."""
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame([(*r, "extra") for r in rows], schema + ", size string").repartition(3)
    return make
