"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating,
   and share all words; a source stops at ``EPOCHS`` times its own size and its
   excess goes to the others by weight until none is above (water filling).
2. Quotas: the mix is cut into equal blocks of ``BLOCK`` words.  Highest
   quotients target / (2s + 1) give each source an integer number of blocks,
   and the same rule deals a source's blocks to its shards by shard size.
3. Selection: a shard's documents stand in seeded hash order and its words form
   a circle of blocks; its quota is the run of consecutive blocks from a seeded
   block on, around the circle as often as it takes (three times at most).
   What a document gives is the number of its words that the run covers.

Everything is a sum, a window or a join with one row per source or shard, so
no block exists as a row and a source that holds a third of all rows is many
shards of about ``SHARD_WORDS`` words.

Defined results for odd input: null or empty text has size 0 and gives 0; a
null doc_id is an ordinary row; equal rows are placed one after another; an
empty table gives an empty result; other columns are kept by ``mixed_texts``
and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from halcyon.llm.common import WORD, n_words, staged, table
from halcyon.llm.sharding import hash48
from halcyon.plans.registry import register

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: words in a block
BLOCK = 16
#: words in a shard, about
SHARD_WORDS = 250_000
SEED = "mix-1"
#: up to so many sources their totals are broadcast (about 100 bytes each)
BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (one row each: source, source_size) with weight and target."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w.cast("decimal(38,0)"))
    s = s.withColumn("cap", (F.col("source_size") * epochs).cast("decimal(38,0)"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("left", F.sum("source_size").over(whole)
                     - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that does not fill up sets the share of it and all after it
    s = s.withColumn("full", F.col("cap").cast("double") * F.col("open").cast("double")
                     <= F.col("weight").cast("double") * F.col("left").cast("double"))
    s = s.withColumn("stop", F.min(F.when(~F.col("full"), F.struct(F.row_number().over(fill).alias("n"), "left", "open"))).over(whole))
    share = F.when(F.row_number().over(fill) >= F.col("stop.n"),
                   (F.col("weight") * F.col("stop.left")).cast("double") / F.col("stop.open").cast("double"))
    return s.select("source", "rank", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, cap: str, seats: str) -> DataFrame:
    """Adds ``won``: the seats of each party when ``seats`` go to the highest votes / (2s + 1)
    (none beyond a party's ``cap``; ties to the smaller ``key``), separately in each group.

    No party's proportional share may exceed its cap, as it does not after water
    filling.  Then each party's rounded share is at most a few seats off, so only the
    seats near it are compared: about three rows for each party, whatever the house.
    """
    g = Window.partitionBy(*group) if group else Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = parties.withColumn("_all", F.sum(votes).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    share = F.coalesce(F.col(votes) * F.col(seats) / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0))
    p = p.withColumn("_q", share)
    near = (F.ceil(F.col("_q") * 2 * F.col("_n") / F.greatest(F.col(seats), F.lit(1))) + 2).cast("long")
    p = p.withColumn("_from", F.least(F.greatest(F.floor("_q") - near, F.lit(0)), F.col(cap)).cast("long"))
    p = p.withColumn("_to", F.least(F.floor("_q").cast("long") + near, F.col(cap)))
    p = p.withColumn("_open", F.col(seats) - F.sum("_from").over(g))
    rows = p.withColumn("_seat", F.explode_outer(F.when(F.col("_to") > F.col("_from"), F.sequence(F.col("_from") + 1, F.col("_to")))))
    best = Window.partitionBy(*group).orderBy(F.desc_nulls_last(F.col(votes) / (2 * F.col("_seat") - 1)), key, "_seat")
    won = F.col("_seat").isNotNull() & (F.row_number().over(best) <= F.col("_open"))
    rows = rows.withColumn("_won", won.cast("long"))
    cols = [c for c in parties.columns if c not in group + [key]]
    return rows.groupBy(*group, key).agg(*[F.first(c).alias(c) for c in cols], (F.first("_from") + F.sum("_won")).alias("won"))


def plan(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED,
         weights=WEIGHTS, epochs: int = EPOCHS, keep: tuple = ()) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken and, for writing it out,
    ``whole`` (full copies) and the word ranges [a1, b1) and [a2, b2)."""
    place = hash48(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))))
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              n_words("text").alias("size"), place.alias("h"), *keep))
    sources = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs))
    n = sources.count()
    sources = (sources.withColumn("blocks", F.ceil(F.col("source_size") * epochs / block).cast("long"))
               .withColumn("house", F.round(F.sum("source_size").over(
                   Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / block).cast("long")))
    sources = (apportion(sources, [], "rank", "target", "blocks", "house").withColumnRenamed("won", "quota")
               .withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
               .select(F.col("source").alias("s_source"), "rank", "source_size", "target", "quota", "shards"))
    small = F.broadcast if n <= BROADCAST_SOURCES else (lambda x: x)
    rows = rows.join(small(sources), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "source")
    rows = rows.withColumn("shard", F.shiftright(F.shiftright("h", 24) * F.col("shards"), 24))
    shards = rows.groupBy("rank", "shard").agg(F.sum("size").cast("long").alias("words"), F.first("quota").alias("quota"))
    shards = shards.withColumn("most", F.ceil(F.col("words") * epochs / block).cast("long"))
    shards = apportion(shards, ["rank"], "shard", "words", "most", "quota")
    ring = F.greatest(F.col("words"), F.lit(1))
    take = F.least(F.col("won") * block, F.col("words") * epochs)
    first = (hash48(F.concat_ws(":", F.lit(seed), "rank", "shard")) % F.ceil(ring / block).cast("long")) * block
    shards = shards.select("rank", "shard", "words", F.floor(take / ring).cast("long").alias("whole"),
                           (take % ring).alias("rest"), first.alias("first"))
    order = Window.partitionBy("rank", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = rows.join(shards, ["rank", "shard"])
    end, stop = F.col("at") + F.col("size"), F.col("first") + F.col("rest")

    def inside(lo, hi):
        a, b = F.greatest(F.col("at"), lo) - F.col("at"), F.least(end, hi) - F.col("at")
        return F.when(b > a, F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))

    rows = rows.withColumn("r1", inside(F.col("first"), F.least(stop, F.col("words"))))
    rows = rows.withColumn("r2", inside(F.lit(0).cast("long"), stop - F.col("words")))
    taken = F.col("whole") * F.col("size") + F.col("r1.b") - F.col("r1.a") + F.col("r2.b") - F.col("r2.a")
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "whole",
                       F.col("r1.a").alias("a1"), F.col("r1.b").alias("b1"), F.col("r2.a").alias("a2"), F.col("r2.b").alias("b2"), *keep)


def mix(docs: DataFrame, **options) -> DataFrame:
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as it is taken whole, plus
    a row for each word range taken of it (its words with the white space between them; ``n_chars`` follows the text)."""
    cols = docs.columns
    docs = docs.select("doc_id", "text", "source", *[F.col(c).alias(f"_{c}") for c in cols if c not in ("doc_id", "text")])
    rows = plan(docs, keep=("text", *[c for c in docs.columns if c[0] == "_"]), **options)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    gaps = F.split("text", WORD, -1)  # before each word, and after the last

    def cut(a, b):
        n = (F.col(b) - F.col(a)).cast("int")
        part = F.slice(words, (F.col(a) + 1).cast("int"), n)
        between = F.concat(F.slice(gaps, (F.col(a) + 2).cast("int"), n - 1), F.array(F.lit("")))
        return F.when(F.col(b) > F.col(a), F.array_join(F.zip_with(part, between, lambda w, g: F.concat(w, g)), ""))

    whole = F.array_repeat(F.col("text"), F.col("whole").cast("int"))
    rows = rows.where("taken > 0").withColumn("piece", F.explode(F.concat(whole, F.array_compact(F.array(cut("a1", "b1"), cut("a2", "b2"))))))
    out = {"doc_id": F.col("doc_id"), "text": F.col("piece"), "n_chars": F.length("piece").cast("long")}
    return rows.select(*[out.get(c, F.col(f"_{c}")).alias(c) for c in cols])


def oracle(block=BLOCK, shard_words=SHARD_WORDS, seed=SEED, epochs=EPOCHS) -> str:
    def seats(src, group, key, votes, cap, n, name):
        g = f"PARTITION BY {group}" if group else ""
        gk = f"{group}, " if group else ""
        return f"""
    {name}_q AS (SELECT *, coalesce({votes} * {n} / nullif((sum({votes}) OVER ({g}))::DOUBLE, 0), 0.0) q, count(*) OVER ({g}) np FROM {src}),
    {name}_b AS (SELECT *, least(greatest(floor(q)::BIGINT - near, 0), {cap}) lo, least(floor(q)::BIGINT + near, {cap}) hi
        FROM (SELECT *, ceil(q * 2 * np / greatest({n}, 1))::BIGINT + 2 near FROM {name}_q)),
    {name}_s AS (SELECT *, {n} - sum(lo) OVER ({g}) free FROM {name}_b),
    {name}_e AS (SELECT {gk}{key}, seat, free, row_number() OVER ({g} ORDER BY {votes} / (2 * seat - 1)::DOUBLE DESC, {key}, seat) pos
        FROM (SELECT *, unnest(range(lo + 1, hi + 1)) seat FROM {name}_s)),
    {name} AS (SELECT s.*, s.lo + (SELECT count(*) FROM {name}_e e WHERE {f"e.{group} = s.{group} AND " if group else ""}e.{key} = s.{key} AND e.pos <= e.free) won
        FROM {name}_s s)"""
    h = "('0x' || substr(md5({}), 1, 12))::BIGINT"
    return f"""
    WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        {h.format(f"concat_ws(':', '{seed}', doc_id::VARCHAR, md5(text))")} h FROM documents),
    src0 AS (SELECT source, sum(size)::BIGINT source_size FROM docs GROUP BY 1),
    src1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src0),
    src2 AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] w, {epochs} * source_size cap FROM src1),
    src3 AS (SELECT *, row_number() OVER f n, (sum(source_size) OVER ()) - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM src2 WINDOW f AS (ORDER BY cap::DOUBLE / w, rank)),
    stop AS (SELECT n, rest, open FROM src3 WHERE NOT cap::DOUBLE * open <= w::DOUBLE * rest ORDER BY n LIMIT 1),
    src4 AS (SELECT source, rank, source_size, coalesce(CASE WHEN src3.n >= stop.n THEN (w * stop.rest)::DOUBLE / stop.open::DOUBLE END, cap::DOUBLE) AS target,
        ceil(source_size * {epochs} / {block}.0)::BIGINT blocks, round((sum(source_size) OVER ()) / {block}.0)::BIGINT house
        FROM src3 LEFT JOIN stop ON true),
    {seats("src4", "", "rank", "target", "blocks", "house", "src")},
    placed AS (SELECT d.doc_id, d.size, d.h, s.rank, s.source_size, s.target, s.won AS quota,
        ((d.h >> 24) * greatest(ceil(s.source_size / {shard_words}.0)::BIGINT, 1)) >> 24 AS shard
        FROM docs d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
    sh0 AS (SELECT rank, shard, sum(size)::BIGINT words, first(quota) quota, ceil(sum(size) * {epochs} / {block}.0)::BIGINT most FROM placed GROUP BY 1, 2),
    {seats("sh0", "rank", "shard", "words", "most", "quota", "sh")},
    sh_run AS (SELECT rank, shard, words, least(won * {block}, words * {epochs}) // greatest(words, 1) AS full_copies,
        least(won * {block}, words * {epochs}) % greatest(words, 1) AS rest,
        ({h.format(f"concat_ws(':', '{seed}', rank, shard)")} % ceil(greatest(words, 1) / {block}.0)::BIGINT) * {block} AS first_word FROM sh),
    lined AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM placed)
    SELECT doc_id, size, source_size, target, (full_copies * size
        + greatest(least(a + size, first_word + rest, words) - greatest(a, first_word), 0)
        + greatest(least(a + size, first_word + rest - words) - a, 0))::BIGINT AS taken
    FROM lined JOIN sh_run USING (rank, shard)"""


@register("op10_mixing", oracle())
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
