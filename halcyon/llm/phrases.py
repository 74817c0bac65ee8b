"""Phrase collocations from a weighted de Bruijn graph.

Nodes of the graph are three words in a row, edges four; an edge joins the node
of its first three words to that of its last three.  Only the longest grams are
counted, one for each word of a piece: the four words that start there, or at the
end of a piece the one to three that are left.  Every other count is derived:

    f(3 words) = flow out of the node (its edges) + pieces that end with them
    f(2 words) = flow of the nodes that begin with them + pieces that end with them
    f(1 word)  = the same of the pairs that begin with it

Before that, pieces are cut between two words whose pair cannot be frequent.  The
pairs are counted in a hashed table of ``cells`` counters; a counter is the sum of
all pairs that share it, so one below ``min_count`` proves its pairs rare, and a
cut between rare pairs takes nothing from any phrase that reaches ``min_count``
(nor from the counts of its parts).  This only keeps grams that no phrase needs out
of the shuffle: results do not depend on the table's size.

A node through which everything flows from one edge into one edge (both weigh as much
as the node) is unary.  Chains of edges over unary nodes are compacted into
paths by pointer doubling: one row of words with one weight, from which the
counts of all edges and of the nodes inside are read.  Nodes inside are never results: the edge around
them is as frequent as they are.

Words are compared by 64-bit fingerprints; the table of words is checked for two
words with one fingerprint (an error), and rows carry fingerprints only until the last step.

Defined results for odd input: a null text has no words; a null lang is ``und``; an empty
lang is a language of its own; repeated rows and doc_ids count as often as they stand; texts of any
length are whole (worked on in pieces of about a megabyte); ties are broken by the phrase;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from halcyon.llm.common import rows_per_batch, small, staged, table
from halcyon.llm.words import groups, mix, word_hashes
from halcyon.plans.registry import register

MIN_COUNT, TOP, SHARE = 30, 2000, 80
#: score = floor(SCALE * a / (l + r))
SCALE = 2_000_000
#: words taken together in a task before their grams are handed on
WORDS = 2_000_000
#: counters of the pair table: one for about four words of text, within these bounds (2^28 are 32 MB of bits)
CELL_BITS, BYTES_PER_CELL = (20, 28), 24
_RANGE_BITS = 20
#: rounds of pointer doubling; paths are cut at one in ``BREAK`` nodes so that they are nearly always shorter than 2^ROUNDS
ROUNDS, BREAK = 6, 8
#: counts (about 60 bytes) that may be broadcast
LOOKUP_ROWS = 400_000

_U = np.uint64
_APART = np.zeros(256, dtype=bool)
_APART[[9, 32, 10, 11, 12, 13, *b".,;:!?"]] = True
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[10, 11, 12, 13, *b".,;:!?"]] = True
_ROLE = mix(np.arange(11, 15, dtype=np.uint64)) | _U(1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# ----------------------------------------------------------------------------- words of a task

def _words(column: pa.Array):
    """Per megabyte of documents: bytes, fingerprints, starts and ends of the words, and whether a piece begins at each."""
    end = np.array([10], dtype=np.uint8)
    for _, docs in groups(column):
        buf = np.concatenate([x for d in docs for x in (d, end)])
        h, starts, ends = word_hashes(buf, spans=True, apart=_APART)
        if not len(h):
            continue
        h[h == 0] = 1                       # 0 stands for no word
        seen = np.cumsum(_ENDS_PIECE[buf])[starts]
        yield buf, h, starts, ends, np.concatenate([[True], seen[1:] != seen[:-1]])


def _by_lang(batch: pa.RecordBatch):
    lang = batch.column(0)
    for name in lang.unique().to_pylist():
        yield name, batch.column(1).filter(pa.compute.equal(lang, name))


def _lang_seed(lang: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "big"))


def _pairs(h: np.ndarray, lang: str) -> np.ndarray:
    """A fingerprint for each word with the next one."""
    return mix(h[:-1] * _ROLE[0] + h[1:] * _ROLE[1] + _lang_seed(lang))


# ----------------------------------------------------------------------------- pairs that may be frequent

def _count_pairs(bits: int):
    def packed(cells):
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        entry = (cell & np.uint32((1 << _RANGE_BITS) - 1)) | (np.minimum(n, 4095).astype(np.uint32) << np.uint32(_RANGE_BITS))
        cuts = np.searchsorted(cell, np.arange(0, (1 << bits) + 1, 1 << _RANGE_BITS))
        used = np.flatnonzero(np.diff(cuts))
        for some in np.array_split(used, -(-len(used) // 16)) if len(used) else ():
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([entry[cuts[r]:cuts[r + 1]].tobytes() for r in some], pa.binary())],
                                             names=["range", "cells"])

    def run(batches):
        held, total = [], 0
        for b in batches:
            for lang, column in _by_lang(b):
                for _, h, _, _, cut in _words(column):
                    held.append((_pairs(h, lang)[~cut[1:]] >> _U(64 - bits)).astype(np.uint32))
                    total += len(held[-1])
                    if total >= WORDS:
                        yield from packed(held)
                        held, total = [], 0
        if total:
            yield from packed(held)
    return run


def _frequent_cells(min_count: int):
    """Adds up the counters of each range as its rows stream by: 4 MB for a range, whatever the number of rows."""
    def run(batches):
        tables: dict = {}
        for b in batches:
            for r, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                entry = np.frombuffer(cells, dtype=np.uint32)
                t = tables.setdefault(r, np.zeros(1 << _RANGE_BITS, dtype=np.uint32))
                at = entry & np.uint32((1 << _RANGE_BITS) - 1)
                t[at] = np.minimum(t[at] + (entry >> np.uint32(_RANGE_BITS)), 1 << 30)
        for r, t in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(t >= min_count).tobytes()], pa.binary())],
                                             names=["range", "bits"])
    return run


def frequent_pairs(texts: DataFrame, min_count: int, bits: int) -> bytes:
    """One bit for each of 2^bits counters: set if its pairs may reach ``min_count``.  At most 32 MB, whatever the input."""
    spark = texts.sparkSession
    whole = bytearray((1 << bits) // 8)
    with rows_per_batch(spark, 16):
        counted = texts.mapInArrow(_count_pairs(bits), "range int, cells binary").repartition(1 << (bits - _RANGE_BITS), "range")
        for row in counted.mapInArrow(_frequent_cells(min_count), "range int, bits binary").collect():
            at = row["range"] * len(row["bits"])
            whole[at:at + len(row["bits"])] = row["bits"]
    return bytes(whole)


# ----------------------------------------------------------------------------- longest grams

_GRAM = ["w1", "w2", "w3", "w4"]


def _grams(bits: int, frequent):
    """The longest gram of every word, counted within the task; and every word once with its text (c = 0)."""
    schema = pa.schema([("lang", pa.string()), *((w, pa.int64()) for w in _GRAM), ("word", pa.string()), ("c", pa.int64())])

    def rows(lang, columns, word, c):
        n = len(c)
        data = [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32))), *(pa.array(x.view(np.int64)) for x in columns),
                pa.nulls(n, pa.string()) if word is None else pa.array(word, pa.string()), pa.array(c, pa.int64())]
        whole = pa.RecordBatch.from_arrays(data, schema=schema)
        for at in range(0, n, 100_000):
            yield whole.slice(at, 100_000)

    def flush(lang, held, texts):
        w = [np.concatenate(x) for x in zip(*held)]
        key = mix(w[0] * _ROLE[0] + w[1] * _ROLE[1] + w[2] * _ROLE[2] + w[3] * _ROLE[3])
        _, at, c = np.unique(key, return_index=True, return_counts=True)
        yield from rows(lang, [x[at] for x in w], None, c)
        none = np.zeros(len(texts), dtype=np.uint64)
        yield from rows(lang, [np.array(list(texts), dtype=np.uint64), none, none, none], list(texts.values()), none.astype(np.int64))

    def run(batches):
        bitmap = np.frombuffer(frequent.value, dtype=np.uint8)
        held: dict = {}
        for b in batches:
            for lang, column in _by_lang(b):
                mine, texts, total = held.pop(lang, ([], {}, 0))
                for buf, h, starts, ends, cut in _words(column):
                    cell = _pairs(h, lang) >> _U(64 - bits)
                    may = (bitmap[(cell >> _U(3)).astype(np.int64)] >> (_U(7) - (cell & _U(7))).astype(np.uint8)) & 1
                    # whether a word goes on in the next one, for this word and the two behind it
                    on = np.zeros(len(h) + 3, dtype=bool)
                    on[:len(h) - 1] = ~cut[1:] & (may == 1)
                    n, two = len(h), on[:len(h)]
                    three = two & on[1:n + 1]
                    four = three & on[2:n + 2]
                    after = np.concatenate([h, np.zeros(3, dtype=np.uint64)])
                    mine.append((h, np.where(two, after[1:n + 1], 0).astype(np.uint64), np.where(three, after[2:n + 2], 0).astype(np.uint64),
                                 np.where(four, after[3:n + 3], 0).astype(np.uint64)))
                    which, at = np.unique(h, return_index=True)
                    data = buf.tobytes().translate(_LOWER)
                    for x, i in zip(which.tolist(), at.tolist()):
                        if x not in texts:
                            texts[x] = data[starts[i]:ends[i]].decode()
                    total += n
                    if total >= WORDS:
                        yield from flush(lang, mine, texts)
                        mine, texts, total = [], {}, 0
                if total:
                    held[lang] = (mine, texts, total)
                if sum(x[2] for x in held.values()) >= WORDS:      # many languages: hand on all that is held
                    for name, (mine, texts, _) in held.items():
                        yield from flush(name, mine, texts)
                    held = {}
        for name, (mine, texts, _) in held.items():
            yield from flush(name, mine, texts)
    return run


def gram_counts(docs: DataFrame, min_count: int = MIN_COUNT, cell_bits: int | None = None) -> DataFrame:
    """lang, w1 to w4 (0: the piece has ended), word (the text of w1, in rows with c = 0), c: the edges and piece ends."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    if cell_bits is None:
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cell_bits = min(max(CELL_BITS[0], (total // BYTES_PER_CELL).bit_length()), CELL_BITS[1])
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_pairs(texts, min_count, cell_bits))
    rows = texts.mapInArrow(_grams(cell_bits, frequent), "lang string, w1 long, w2 long, w3 long, w4 long, word string, c long")
    return staged(rows.groupBy("lang", *_GRAM, "word").agg(F.sum("c").alias("c")))


# ----------------------------------------------------------------------------- the graph

def _flow(grams: DataFrame, k: int) -> DataFrame:
    """Occurrences of the first k words: what flows on from them, and the pieces that end with them."""
    return grams.where(F.col(_GRAM[k - 1]) != 0).groupBy("lang", *_GRAM[:k]).agg(F.sum("c").alias("f"))


def compact_paths(edges: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(paths: lang, words, f; unary nodes inside the paths: lang, w1, w2, w3).

    ``edges`` are lang, w1 to w4, f and ``nodes`` lang, w1 to w3, f, both whole counts.  Every edge is in one path, once.
    An edge points to the one behind the unary node at its end; doubling the pointers leads to the last edge of
    the path.  Edges that have not arrived after ``rounds`` rounds (very long paths, rings) are paths of their own."""
    edges = staged(edges.withColumn("e", F.monotonically_increasing_id()))
    nodes = nodes.where(F.pmod(F.xxhash64("lang", "w1", "w2", "w3"), F.lit(BREAK)) != 0)
    into = edges.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), "f", "e")
    out = edges.select("lang", "w1", "w2", "w3", "f", F.col("e").alias("next"))
    on = ["lang", "w1", "w2", "w3", "f"]                 # all that flows through the node is in the edge before and in the edge behind it
    links = staged(nodes.join(into, on).join(out, on))
    step = links.where("e <> next").select("e", F.col("next").alias("to"), F.lit(1).alias("d"))
    for _ in range(rounds):
        far = step.select(F.col("e").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        step = staged(step.join(far, "to", "left").select("e", F.coalesce("to2", "to").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
    ended = step.join(links.select(F.col("e").alias("to")), "to", "left_anti")      # those that point to an edge without a next one
    line = edges.join(ended, "e", "left").select("lang", *_GRAM, "f", F.coalesce("to", "e").alias("path"), F.coalesce("d", F.lit(0)).alias("d"))
    steps = F.sort_array(F.collect_list(F.struct((-F.col("d")).alias("at"), *_GRAM)))
    paths = line.groupBy("lang", "path", "f").agg(steps.alias("s"))
    first = F.col("s")[0]
    paths = staged(paths.select("lang", F.concat(F.array(first["w1"], first["w2"], first["w3"]), F.transform("s", lambda x: x["w4"])).alias("words"), "f"))
    inside = _windows(paths.where(F.size("words") > 4), 3, 1)
    return paths, inside


def _windows(paths: DataFrame, k: int, skip: int = 0) -> DataFrame:
    """All k words in a row of each path, without the first and last ``skip`` of them, with the path's count."""
    at = F.explode(F.sequence(F.lit(1 + skip), F.size("words") - F.lit(k - 1 + skip))).alias("at")
    rows = paths.select("lang", "words", "f", at)
    return rows.select("lang", *[F.element_at("words", F.col("at") + i).alias(_GRAM[i]) for i in range(k)], "f")


# ----------------------------------------------------------------------------- candidates

def _whole(x) -> Column:
    return x.cast("decimal(38,0)")


def _extended(shorter: DataFrame, longer: DataFrame, k: int, share: int) -> DataFrame:
    """``shorter`` (k words) without those that one word more before or behind them repeats in ``share`` percent or more.
    A phrase of two words more is never more frequent than the phrase of one word more in it."""
    sides = [longer.select("lang", *[F.col(_GRAM[i + s]).alias(_GRAM[i]) for i in range(k)], "f") for s in (0, 1)]
    most = sides[0].unionByName(sides[1]).groupBy("lang", *_GRAM[:k]).agg(F.max("f").alias("most"))
    kept = shorter.join(most, ["lang", *_GRAM[:k]], "left")
    return kept.where(F.col("most").isNull() | (_whole(F.col("most")) * 100 < _whole(F.col("f")) * share)).drop("most")


def _parts(k: int) -> Column:
    """Each cut's two parts and each word by itself, as (cut, side, at, x1, x2, x3); cut 0 stands for the words."""
    def part(cut, side, a, b):
        x = [F.col(w) for w in _GRAM[a:b]] + [F.lit(0).cast("long")] * (3 - (b - a))
        return F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), *[c.alias(f"x{i + 1}") for i, c in enumerate(x)])
    return F.array(*[part(c, s, a, b) for c in range(1, k) for s, a, b in ((0, 0, c), (1, c, k))], *[part(0, i, i, i + 1) for i in range(k)])


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE, cell_bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to four words of each language."""
    grams = gram_counts(docs, min_count, cell_bits)
    vocabulary = grams.where(F.col("word").isNotNull()).select(F.col("w1").alias("x1"), "word").distinct()
    vocabulary = vocabulary.groupBy("x1").agg(F.collect_list("word").alias("word")).select(
        "x1", F.when(F.size("word") == 1, F.col("word")[0]).otherwise(F.raise_error(F.lit("two words have one fingerprint"))).alias("word"))
    enough = F.col("f") >= min_count
    one, two, three = (staged(_flow(grams, k).where(enough)) for k in (1, 2, 3))
    four = grams.where((F.col("w4") != 0) & (F.col("c") >= min_count)).select("lang", *_GRAM, F.col("c").alias("f"))
    paths, inside = compact_paths(four, three)
    four = _windows(paths, 4)
    junctions = three.join(inside, ["lang", "w1", "w2", "w3"], "left_anti")
    three = junctions.unionByName(inside)
    found = [(4, four), (3, _extended(junctions, four, 3, share)), (2, _extended(two, three, 2, share))]
    none = F.lit(0).cast("long")
    candidates = None
    for k, c in found:
        c = c.select("lang", *[F.col(w) if i < k else none.alias(w) for i, w in enumerate(_GRAM)], F.col("f").alias("a"))
        c = c.withColumn("part", F.explode(_parts(k)))
        candidates = c if candidates is None else candidates.unionByName(c)
    counts = one.select("lang", F.col("w1").alias("x1"), none.alias("x2"), none.alias("x3"), "f").join(vocabulary, "x1")
    for t, k in ((two, 2), (three, 3)):
        x = [F.col(_GRAM[i]).alias(f"x{i + 1}") if i < k else none.alias(f"x{i + 1}") for i in range(3)]
        counts = counts.unionByName(t.select("lang", *x, "f", F.lit(None).cast("string").alias("word")))
    rows = candidates.select("lang", *_GRAM, "a", "part.*").join(small(counts, LOOKUP_ROWS), ["lang", "x1", "x2", "x3"])
    # two sides of at most three cuts, and at most four words
    rows = rows.groupBy("lang", *_GRAM, "a").agg(
        F.sort_array(F.collect_list(F.when(F.col("cut") == 0, F.struct("side", "word")))).alias("words"),
        *[F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"f{c}{s}") for c in (1, 2, 3) for s in (0, 1)])
    scores = []
    for c in (1, 2, 3):
        left, right = F.col(f"f{c}0"), F.col(f"f{c}1")
        score = F.floor(_whole(F.lit(SCALE)).cast("decimal(18,0)") * F.col("a").cast("decimal(19,0)") / (left + right).cast("decimal(19,0)"))
        # the quotient has been rounded to its scale: the whole product puts the floor right if that went over a whole number
        over = score.cast("decimal(18,0)") * (left + right).cast("decimal(19,0)") > F.lit(SCALE).cast("decimal(18,0)") * F.col("a").cast("decimal(19,0)")
        scores.append(F.when(left.isNotNull(), F.struct((score.cast("long") - over.cast("long")).alias("score"), F.lit(c).alias("cut"), left.alias("l"), right.alias("r"))))
    best = F.array_min(F.filter(F.array(*scores), lambda s: s.isNotNull())).alias("best")
    scored = rows.select("lang", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"), "a", best)
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # the best of sixteen parts of each language, then of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(16))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    some = some.where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = grams.groupBy("lang").agg(F.sum("c").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (
    SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM words),
f AS (
    SELECT lang, g, count(*)::BIGINT AS f FROM grams GROUP BY lang, g HAVING count(*) >= {MIN_COUNT}),
candidates AS (
    SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
inner_parts AS (
    SELECT lang, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS g, a
    FROM candidates WHERE len(g) > 2),
longer AS (
    SELECT lang, g, max(a) AS most FROM inner_parts GROUP BY lang, g),
kept AS (
    SELECT c.lang, c.g, c.a FROM candidates c LEFT JOIN longer USING (lang, g) WHERE most IS NULL OR 100::HUGEINT * most < {SHARE}::HUGEINT * a),
cuts AS (
    SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
scores AS (
    SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (({SCALE}::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
best AS (
    SELECT *, array_to_string(g, ' ') AS phrase FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN totals USING (lang)
WHERE rank <= {TOP}"""


@register("op12_phrases", ORACLE)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
