"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

Every document descends region -> rack -> shard.  At each level each child
draws ``-ln(u) / weight`` with ``u`` a hash of (doc_id, child's path) in (0, 1)
and the smallest draw wins, so a child gets a share of the rows equal to its
share of the weight and each child's draw depends on nothing but itself:
raising a weight moves rows only into that subtree, lowering it only out.

Law ``key``: doc_id and the tree alone decide.  ``grow`` hangs one more shard
into the tree as a region of its own, so no other subtree's weight changes and
rows move only into the new shard.

Defined results for odd input: a null doc_id hashes as the word ``null`` (one
shard for all such rows); a null text has size 1 and a null checksum; rows
that repeat are all kept, each with a slot of its own; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from halcyon.llm.common import parts, staged, table
from halcyon.plans.registry import register

#: region -> rack -> shard number -> weight
TREE = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}},
        "r1": {"k0": {4: 1.0, 5: 1.0}, "k1": {6: 1.0, 7: 1.0}}}
#: rows that one task numbers at once, about
SLOT_ROWS = 20_000


def grow(tree: dict, weight: float = 1.0) -> dict:
    """``tree`` with one more shard, as the only leaf of a new region."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, f"r{len(tree)}": {"k0": {new: weight}}}


def weight_of(node) -> float:
    return sum(map(weight_of, node.values())) if isinstance(node, dict) else float(node)


def hash48(text: Column) -> Column:
    """The first 48 bits of the text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def descend(key: Column, tree: dict, path: str = "") -> Column:
    """The shard that ``key`` reaches in ``tree``, as one column expression."""
    draws = []
    for i, (name, node) in enumerate(tree.items()):
        u = (hash48(F.concat(key, F.lit(f"{path}/{name}"))) + F.lit(0.5)) / F.lit(float(2 ** 48))
        draws.append(F.struct((-F.log(u) / F.lit(weight_of(node))).alias("d"), F.lit(i).alias("i")))
    won = F.array_min(F.array(*draws))["i"] if len(draws) > 1 else F.lit(0)
    out = None
    for i, (name, node) in enumerate(tree.items()):
        leaf = descend(key, node, f"{path}/{name}") if isinstance(node, dict) else F.lit(int(name))
        out = F.when(won == i, leaf) if out is None else out.when(won == i, leaf)
    return out


def shard(docs: DataFrame, tree: dict | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Slots count from 0 within a shard, without gaps, in the order of a hash of
    (doc_id, checksum).  That order is cut into ranges of about ``SLOT_ROWS``
    rows: each range is numbered by itself and starts where the counts of the
    ranges before it end, so no task orders a whole shard.  Equal rows are one
    row with a count until the last step, so copies do not pile up anywhere.
    """
    tree = tree or TREE
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    crc = F.crc32(F.col("text").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       crc.alias("text_crc32"), key.alias("key"))
    rows = rows.select("doc_id", "size", "text_crc32", descend(F.col("key"), tree).cast("int").alias("shard"),
                       descend(F.col("key"), grow(tree)).cast("int").alias("grown_shard"),
                       hash48(F.concat_ws(":", "key", "text_crc32")).alias("h"))
    rows = staged(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    ranges = parts(rows.count(), SLOT_ROWS)
    # 24 + 24 bits, so that the product stays a long for any number of ranges
    rows = rows.withColumn("range", F.shiftright(F.shiftright("h", 24) * F.lit(ranges), 24))
    totals = rows.groupBy("shard", "range").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = (Window.partitionBy("shard", "range").orderBy("h", "doc_id", "text_crc32", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.join(totals, ["shard", "range"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard",
                       (F.col("start") + F.col("here")).alias("first"), "n").select(
        "doc_id", "size", "text_crc32", "law", "shard",
        F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), "grown_shard")


def _paths(tree: dict) -> str:
    """The tree as SQL rows (region, rack, shard, region weight, rack weight, weight)."""
    return ", ".join(f"('{r}', '{k}', {s}, {weight_of(racks)}, {weight_of(shards)}, {w})"
                     for r, racks in tree.items() for k, shards in racks.items() for s, w in shards.items())


def oracle(tree: dict) -> str:
    def placed(t: dict, name: str) -> str:
        def u(path):
            return f"-ln((('0x' || substr(md5(k || {path}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"
        return f"""
        {name}_t(r, rk, s, wr, wk, ws) AS (VALUES {_paths(t)}),
        {name}_r AS (SELECT k, arg_min(r, d) r FROM (SELECT k, r, {u("'/' || r")} / wr d
          FROM keys, (SELECT DISTINCT r, wr FROM {name}_t)) GROUP BY k),
        {name}_k AS (SELECT k, any_value(r) r, arg_min(rk, d) rk FROM (SELECT k, r, rk, {u("'/' || r || '/' || rk")} / wk d
          FROM {name}_r JOIN (SELECT DISTINCT r, rk, wk FROM {name}_t) USING (r)) GROUP BY k),
        {name} AS (SELECT k, arg_min(s, d)::INT s FROM (SELECT k, s, {u("'/' || r || '/' || rk || '/' || s")} / ws d
          FROM {name}_k JOIN {name}_t USING (r, rk)) GROUP BY k)"""
    return f"""
    WITH RECURSIVE bits(i, v, n) AS (
        SELECT i, i::BIGINT, 0 FROM range(256) t(i)
        UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
    crc_table AS (SELECT list(v ORDER BY i) v FROM bits WHERE n = 8),
    src AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') k, text, coalesce(strlen(text), 0) + 1 AS size FROM documents),
    crcs AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
          lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]))) AS crc
        FROM (SELECT DISTINCT text FROM src WHERE text IS NOT NULL), crc_table),
    keys AS (SELECT DISTINCT k FROM src),
    {placed(tree, 'eight')}, {placed(grow(tree), 'nine')},
    put AS (SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, k, eight.s AS shard, nine.s AS grown_shard
        FROM src LEFT JOIN crcs USING (text) JOIN eight USING (k) JOIN nine USING (k))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
        ORDER BY substr(md5(concat_ws(':', k, text_crc32)), 1, 12), doc_id, text_crc32, size) - 1 AS slot, grown_shard
    FROM put"""


@register("op3_sharding", oracle(TREE))
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
