"""Fill-in-middle transformation by in-place block rotation.

A text is cut at line ends into prefix, middle and suffix.  Its bytes go into a
bytearray in their own order with the three sentinels before their blocks;
two neighbouring blocks then change places by three reversals (each block, then
both together), which needs no second copy of the text:

    psm   <P>prefix [<M>middle] [<S>suffix]    ->  <P>prefix<S>suffix<M>middle
    spm   [<P>prefix<M>middle] [<S>suffix]     ->  <S>suffix<P>prefix<M>middle

``restore`` finds the sentinels, rotates back and takes them out.

The cuts come from ``sha256("{seed}:{doc_id}")`` alone, so a retried task or
another cluster gives the same output.  Every row is worked on by itself:
nothing is shuffled, and a text that holds a sentinel stays plain, so the
output always says where its blocks are.

Defined results for odd input: a null or empty text is plain with empty output
and 0 lines; a null doc_id is the word ``null`` in the hash; a text of one line
without an end is one unit (so two of its blocks are empty); repeated rows are
all kept, with equal results; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from halcyon.llm.common import lean, table
from halcyon.plans.registry import register

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: percent of the texts that are transformed, and of those the percent in suffix-prefix-middle order
RATE, SPM = 100, 50
#: bytes exchanged at once by a reversal
STEP = 1 << 16


def reverse(v: np.ndarray, a: int, b: int) -> None:
    """Reverse v[a:b] in place, exchanging ``STEP`` bytes of both ends at a time."""
    while b - a > 1:
        k = min(STEP, (b - a) // 2)
        left = v[a:a + k].copy()
        v[a:a + k] = v[b - k:b][::-1]
        v[b - k:b] = left[::-1]
        a, b = a + k, b - k


def rotate(block: bytearray, a: int, m: int, b: int) -> None:
    """Exchange the neighbours block[a:m] and block[m:b] in place by three reversals."""
    v = np.frombuffer(block, dtype=np.uint8)
    reverse(v, a, m)
    reverse(v, m, b)
    reverse(v, a, b)


def line_ends(text: bytes) -> np.ndarray:
    """Where each line (up to and with its line feed; the rest behind the last one) ends, in bytes."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers from the hash of the document's id."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: bytes, doc_id, rate: int = RATE, spm: int = SPM, seed: int = SEED):
    """(lines, form, code points of prefix and of middle, output bytes) of one document."""
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    bounds = np.concatenate([[0], ends])
    i, j = (int(bounds[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    block = bytearray(text)
    for at, sentinel in ((j, SUFFIX), (i, MIDDLE), (0, PREFIX)):       # from the end, so that the cuts stay where they are
        block[at:at] = sentinel
    middle, suffix = i + len(PREFIX), j + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < spm else "psm"
    rotate(block, 0 if form == "spm" else middle, suffix, len(block))
    return n, form, points(text[:i]), points(text[i:j]), block


def original(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    block = bytearray(output)
    p, s, m = (block.index(x) for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "spm":
        rotate(block, s, p, len(block))       # [suffix][prefix middle] -> [prefix middle][suffix]
    else:
        rotate(block, s, m, len(block))       # prefix [suffix][middle] -> prefix [middle][suffix]
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = block.index(sentinel)
        del block[at:at + len(sentinel)]
    return bytes(block)


def points(text: bytes) -> int:
    """Code points of UTF-8 bytes: all but the continuation bytes."""
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def _texts(column: pa.Array):
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output for every row of ``docs``."""
    def run(batches):
        for b in batches:
            rows = [rearranged(t, d, rate, spm, seed) for d, t in zip(b.column(0).to_pylist(), _texts(b.column(1)))]
            n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(map(bytes, out), pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _OUT)


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` (with form and output) and a column ``restored``: the text rebuilt from these two alone."""
    at = {c: i for i, c in enumerate(rows.columns)}
    schema = rows.select("*", F.lit("").alias("restored")).schema

    def run(batches):
        for b in batches:
            texts = [original(t, f) for t, f in zip(_texts(b.column(at["output"])), b.column(at["form"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*b.schema.names, "restored"])

    return rows.mapInArrow(lean(run), schema)


ORACLE = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS line,
           sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
ends AS (
    SELECT *, len(line) - CASE WHEN t = '' OR suffix(t, chr(10)) THEN 1 ELSE 0 END AS n,
           ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
chosen AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM ends),
sized AS (
    SELECT *, least(length(t), coalesce(list_sum(list_transform(line[1:i], lambda x: length(x) + 1)), 0)) AS a,
           least(length(t), coalesce(list_sum(list_transform(line[1:j], lambda x: length(x) + 1)), 0)) AS b FROM chosen),
blocks AS (
    SELECT *, substr(t, 1, a::BIGINT) AS p, substr(t, a::BIGINT + 1, (b - a)::BIGINT) AS m, substr(t, b::BIGINT + 1) AS s FROM sized)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM blocks"""


@register("op11_infill", ORACLE)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))
