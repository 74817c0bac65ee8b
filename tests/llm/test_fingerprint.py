import hashlib
from collections import Counter

import pytest
from hypothesis import given, strategies as st

from halcyon.llm import fingerprint as fp


def brute(text):
    """The digest by its definition, one triplet at a time."""
    b = text.encode()
    c = Counter(((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * fp.FACTOR % 2 ** 32) >> fp.SHIFT for i in range(len(b) - 2))
    all_counts = sorted(c[k] for k in range(512))
    q = [all_counts[k] for k in (127, 255, 383)]
    codes = [sum(c[k] > x for x in q) for k in range(512)]
    octave = len(b).bit_length()
    first = f"{len(b):b}00"[1:3]
    return codes, 4 * octave + int(first, 2) if b else 0


def brute_text(text):
    codes, n = brute(text)
    return f"{n:02x}" + "".join(f"{4 * a + b:x}" for a, b in zip(codes[::2], codes[1::2]))


def brute_likeness(a, b):
    (x, n), (y, m) = brute(a), brute(b)
    return 1 - min(1024, sum({3: 6}.get(abs(i - j), abs(i - j)) for i, j in zip(x, y)) + 40 * min(12, abs(n - m))) / 1024


def brute_rows(docs):
    """Expected rows of documents with distinct ids, given in the order of their ids."""
    out = []
    for k, (doc_id, text) in enumerate(docs):
        text, nxt = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        e = text[:len(text) - half] + nxt[:half]
        out.append((doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), brute_text(text), brute_text(e),
                    brute_likeness(text, e), brute_likeness(text, nxt)))
    return out


DOCS = [(None, "no id"), (1, "one fish two fish"), (2, None), (3, ""), (4, "ab"), (5, "über " * 300), (7, "one fish two fish"),
        (9, "long words " * 9000), (12, "über " * 310), (40, "z")]


@given(st.text(max_size=60))
def test_digest(text):
    d = fp.digest(text.encode())
    codes, n = brute(text)
    assert list(d) == [*codes, n]
    assert fp.as_text(d) == brute_text(text) and list(fp.from_text(fp.as_text(d))) == list(d)


@given(st.text(max_size=60), st.text(max_size=60))
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = fp.digest(a.encode()), fp.digest(b.encode())
    assert fp.likeness(x, y) == fp.likeness(y, x) == brute_likeness(a, b) and 0 <= fp.likeness(x, y) <= 1
    assert fp.likeness(x, x) == 1


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("some words " * 500).encode()
    whole = fp.counts(text)
    monkeypatch.setattr(fp, "PIECE", 37)
    assert (fp.counts(text) == whole).all() and whole.sum() == len(text) - 2


@pytest.mark.parametrize("range_bytes", [20, 2_000, 1 << 25])
def test_neighbours_within_and_across_ranges(frame, monkeypatch, range_bytes):
    monkeypatch.setattr(fp, "RANGE_BYTES", range_bytes)
    got = sorted(map(tuple, fp.compared(frame(DOCS)).collect()), key=str)
    assert got == sorted(brute_rows(DOCS), key=str)


def test_repeated_rows_and_ids(frame, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 50)
    rows = [(5, "same text")] * 40 + [(5, "other text"), (6, "last")]
    got = fp.compared(frame(rows)).collect()
    assert Counter(r.fingerprint for r in got) == Counter(brute_text(t) for _, t in rows)
    # copies follow each other, so all but one of them see themselves next
    assert sum(r.near_next == 1 for r in got if r.n_chars == 9) == 39


def test_one_row_and_none(frame):
    got = fp.compared(frame([(8, "alone here")])).collect()
    assert [tuple(r) for r in got] == brute_rows([(8, "alone here")])
    assert fp.compared(frame(DOCS).limit(0)).count() == 0


def test_fingerprints_keeps_columns(frame):
    got = fp.fingerprints(frame(DOCS)).collect()
    assert {(r.doc_id, r.fingerprint, r["size"]) for r in got} == {(d, brute_text(t or ""), "extra") for d, t in DOCS}
