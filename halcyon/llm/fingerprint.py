"""Document fingerprints: a quartile bucket digest and a bounded difference score.

The byte triplets of a text are hashed into ``BUCKETS`` buckets.  Each bucket's
count is written as two bits: which quarter of all bucket counts it lies in (the
three quartiles are order statistics, so they are whole numbers).  With the length
in quarter octaves that is the digest: equal texts have equal digests, and an edit
moves only the buckets of the triplets it touches.

Two digests differ by the sum of their bucket distances (0, 1, 2; 6 for opposite
quarters) plus ``LENGTH`` for each quarter octave between the lengths, bounded by
``LIMIT``; likeness is 1 - difference / LIMIT, from 0 to 1.

``compared`` sets every document beside its edited text and the next document.
The order by doc_id needs no single sort: rows are dealt by ranges of doc_id,
each range is walked once in order, and only the first and last row of a range
(two rows for each ``RANGE_BYTES`` of text) meet their neighbours through a join.
Texts are shuffled once and leave no task otherwise.

Defined results for odd input: a null text is the empty text; texts of fewer than
three bytes have all buckets empty; rows without doc_id come first; rows of one
doc_id follow each other in the order of a 64-bit hash of their texts (rows equal in both
are interchangeable, so copies spread over many ranges); a table of one row is its
own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from halcyon.llm.common import parts, staged, table
from halcyon.plans.registry import register

BUCKETS = 512
#: difference for each quarter octave between the lengths, counted up to ``LENGTH_STEPS`` of them
LENGTH, LENGTH_STEPS = 40, 12
LIMIT = 2 * BUCKETS
#: bucket = (triplet * FACTOR mod 2^32) >> SHIFT
FACTOR, SHIFT = 2654435769, 23
#: bytes counted at once, bytes of text in a range
PIECE, RANGE_BYTES = 1 << 20, 32 << 20

_DISTANCE = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)


def counts(text: bytes) -> np.ndarray:
    """How many of the text's byte triplets fall into each bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(text) - 2), PIECE):
        b = np.frombuffer(text, dtype=np.uint8, offset=at, count=min(PIECE + 2, len(text) - at)).astype(np.uint32)
        triplet = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        total += np.bincount((triplet * np.uint32(FACTOR)) >> np.uint32(SHIFT), minlength=BUCKETS)
    return total


def length_code(n: int) -> int:
    """The length in quarter octaves: four times the number of bits, and the two bits after the first."""
    bits = n.bit_length()
    return 4 * bits + ((n << 3 >> bits) & 3) if n else 0


def digest(text: bytes) -> np.ndarray:
    """The bucket codes (0 to 3) and, last, the length code."""
    c = counts(text)
    quartiles = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return np.append((c[:, None] > quartiles).sum(1), length_code(len(text)))


def as_text(d: np.ndarray) -> str:
    """Two hex digits of length code and one for every two buckets."""
    return f"{d[-1]:02x}" + "".join(map("{:x}".format, 4 * d[:-1:2] + d[1:-1:2]))


def from_text(s: str) -> np.ndarray:
    pairs = np.array([int(x, 16) for x in s[2:]])
    return np.append(np.stack([pairs >> 2, pairs & 3], axis=1).ravel(), int(s[:2], 16))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for a difference of ``LIMIT`` or more."""
    steps = min(abs(int(a[-1]) - int(b[-1])), LENGTH_STEPS)
    return 1 - min(int(_DISTANCE[a[:-1], b[:-1]].sum()) + LENGTH * steps, LIMIT) / LIMIT


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` of the text column (null: empty text)."""
    rows = docs.withColumn("fingerprint", F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    schema = rows.withColumn("fingerprint", F.lit("")).schema

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("fingerprint")
            out = pa.array([as_text(digest(t.as_py())) for t in b.column(i)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:i], out, *b.columns[i + 1:]], names=b.schema.names)

    return rows.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down, in code points) replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(doc_id, text: str, code: np.ndarray, following: str, next_code: np.ndarray) -> tuple:
    new = edited(text, following).encode()
    new_code = digest(new)
    return (doc_id, len(text), hashlib.sha256(new).hexdigest(), as_text(code), as_text(new_code),
            likeness(code, new_code), likeness(code, next_code))


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                    ("end", pa.int32()), ("h", pa.int64()), ("row", pa.int64()), ("text", pa.string())])
_FIRST, _LAST = 1, 2


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _walk(batches):
    """One range in order: a finished row for every document but the last, and the two end rows with their texts."""
    held = None
    for b in batches:
        out = []
        for doc_id, h, row, text in zip(*(c.to_pylist() for c in b.columns)):
            code = digest(text.encode())
            if held is None:
                out.append((doc_id, *[None] * 6, _FIRST, h, row, text))
            else:
                out.append((*_compare(held[0], held[3], held[4], text, code), 0, None, None, None))
            held = (doc_id, h, row, text, code)
        yield _batch(out, _KINDS)
    if held is not None:
        yield _batch([(held[0], *[None] * 6, _LAST, held[1], held[2], held[3])], _KINDS)


def _finish(batches):
    schema = pa.schema(list(_KINDS)[:7])
    for b in batches:
        yield _batch([_compare(d, t, digest(t.encode()), n, digest(n.encode())) for d, t, n in zip(*(c.to_pylist() for c in b.columns))], schema)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("row"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    keys = ["doc_id", "h", "row"]
    walked = rows.repartitionByRange(parts(total, RANGE_BYTES), *keys).sortWithinPartitions(*keys)
    walked = staged(walked.mapInArrow(_walk, f"{_PAIR}, end int, h long, row long, text string"))
    ends = walked.where("end > 0").select(*keys, "end", "text")
    # the ends alone, without their texts: after the last row of a range comes the first one of the next range
    line = Window.orderBy(*keys, "end")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = ends.select("row", "end", F.coalesce(F.lead("row").over(line), F.first("row").over(whole)).alias("next_row"))
    following = following.where(F.col("end") == _LAST).select("row", "next_row")
    lasts = ends.where(F.col("end") == _LAST).select("row", "doc_id", "text")
    firsts = ends.where(F.col("end") == _FIRST).select(F.col("row").alias("next_row"), F.col("text").alias("next_text"))
    met = lasts.join(following, "row").join(firsts, "next_row").select("doc_id", "text", "next_text")
    done = walked.where("end = 0").select(*[c.split()[0] for c in _PAIR.split(", ")])
    return done.unionByName(met.mapInArrow(_finish, _PAIR))


ORACLE = f"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents),
pairs AS (
    SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM docs WINDOW w AS (ORDER BY doc_id)),
eds AS (
    SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS e FROM pairs),
texts AS (
    SELECT x, row_number() OVER () AS k FROM (SELECT t AS x FROM eds UNION SELECT e FROM eds)),
bytes AS (
    SELECT k, generate_subscripts(b, 1) AS i, unnest(b) AS v
    FROM (SELECT k, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda y: ('0x' || y)::BIGINT) AS b FROM texts)),
triplets AS (
    SELECT k, v * 65536 + lead(v) OVER w * 256 + lead(v, 2) OVER w AS tr FROM bytes WINDOW w AS (PARTITION BY k ORDER BY i)),
hits AS (
    SELECT k, ((tr * {FACTOR}) & 4294967295) >> {SHIFT} AS b, count(*) AS c FROM triplets WHERE tr IS NOT NULL GROUP BY ALL),
filled AS (
    SELECT k, b, coalesce(c, 0) AS c FROM (SELECT k, b FROM texts, range({BUCKETS}) r(b)) LEFT JOIN hits USING (k, b)),
cuts AS (
    SELECT k, list_sort(list(c)) AS s FROM filled GROUP BY k),
codes AS (
    SELECT k, list((c > s[{BUCKETS // 4}])::INT + (c > s[{BUCKETS // 2}])::INT + (c > s[{3 * BUCKETS // 4}])::INT ORDER BY b) AS d
    FROM filled JOIN cuts USING (k) GROUP BY k),
prints AS (
    SELECT x, d, CASE WHEN n = 0 THEN 0 ELSE 4 * length(bin(n)) + (((n << 3) >> length(bin(n))) & 3) END AS len,
           printf('%02x', CASE WHEN n = 0 THEN 0 ELSE 4 * length(bin(n)) + (((n << 3) >> length(bin(n))) & 3) END)
           || list_aggregate(list_transform(range(1, {BUCKETS}, 2), lambda i: printf('%x', 4 * d[i] + d[i + 1])), 'string_agg', '') AS f
    FROM (SELECT x, d, strlen(x) AS n FROM texts JOIN codes USING (k)))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(e) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
       1 - least({LIMIT}, list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: CASE abs(a.d[i] - b.d[i]) WHEN 3 THEN 6 ELSE abs(a.d[i] - b.d[i]) END))
           + {LENGTH} * least({LENGTH_STEPS}, abs(a.len - b.len))) / {LIMIT}.0::DOUBLE AS near_edited,
       1 - least({LIMIT}, list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: CASE abs(a.d[i] - c.d[i]) WHEN 3 THEN 6 ELSE abs(a.d[i] - c.d[i]) END))
           + {LENGTH} * least({LENGTH_STEPS}, abs(a.len - c.len))) / {LIMIT}.0::DOUBLE AS near_next
FROM eds JOIN prints a ON a.x = eds.t JOIN prints b ON b.x = eds.e JOIN prints c ON c.x = eds.nt"""


@register("op13_fingerprint", ORACLE)
def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
