import hashlib
import re

from hypothesis import given, settings, strategies as st

from halcyon.llm import infill

ODD = [(1, "one\ntwo\nthree\n"), (2, "no end"), (3, "\n\n\n"), (4, ""), (5, None), (None, "x\ny"), (6, "has <S> inside\nline"),
       (7, "é\nüö\r\nß"), (1, "one\ntwo\nthree\n"), (1, "other text\nsame id"), (8, "a\n" * 100_000), (9, "ß" * 300_000 + "\nend")]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows_and_round_trip(frame):
    rows = infill.restore(infill.fill_in_middle(frame(ODD))).collect()
    got = sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored) for r in rows)
    assert got == sorted((str(d), *map(str, brute(d, t)), t or "") for d, t in ODD)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n\réß<PSM>", max_size=40), st.integers(-5, 10 ** 12))
def test_any_text(text, doc_id):
    n, form, p, m, out = infill.rearranged(text.encode(), doc_id)
    assert (n, form, p, m, bytes(out).decode()) == brute(doc_id, text)
    assert infill.original(bytes(out), form).decode() == text


@given(st.binary(max_size=50), st.integers(0, 50), st.integers(0, 50), st.integers(0, 50), st.integers(1, 5))
def test_rotation(data, a, m, b, step):
    a, m, b = sorted(min(x, len(data)) for x in (a, m, b))
    block, infill.STEP = bytearray(data), step
    try:
        infill.rotate(block, a, m, b)
    finally:
        infill.STEP = 1 << 16
    assert block == data[:a] + data[m:b] + data[a:m] + data[b:]


def test_rate_and_empty_table(frame):
    rows = infill.fill_in_middle(frame([(k, "a\nb\n") for k in range(400)]), rate=40, spm=0).collect()
    assert 110 < sum(r.form == "psm" for r in rows) < 210 and not any(r.form == "spm" for r in rows)
    assert infill.restore(infill.fill_in_middle(frame(ODD).limit(0))).count() == 0
