from collections import Counter
from zlib import crc32

from halcyon.llm import sharding

ODD = [(1, "a"), (1, "a"), (2, None), (None, "x"), (None, None), (3, ""), (4, "é" * 5000)]


def test_contract_on_odd_rows(frame):
    rows = sharding.shard(frame(ODD)).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32 or 0) for r in rows) == sorted(
        (d or 0, len((t or "").encode()) + 1, crc32((t or "").encode()) if t else 0) for d, t in ODD)
    for s in {r["shard"] for r in rows}:
        mine = sorted(r.slot for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert {r.law for r in rows} == {"key"}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id % 7) AS text")
    rows = sharding.shard(docs).collect()
    assert all(r.grown_shard in (r["shard"], 8) for r in rows)
    share = Counter(r["shard"] for r in rows)
    assert set(share) == set(range(8)) and max(share.values()) < 1.2 * min(share.values())
    assert abs(sum(r.grown_shard == 8 for r in rows) - 4000 / 9) < 70


def test_weight_change_stays_in_its_subtree(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text")
    light = {"r0": {"k0": {0: 1.0, 1: 1.0}}, "r1": {"k0": {2: 1.0, 3: 1.0}}}
    heavy = {"r0": {"k0": {0: 1.0, 1: 3.0}}, "r1": {"k0": {2: 1.0, 3: 1.0}}}
    a = {r.doc_id: r["shard"] for r in sharding.shard(docs, light).collect()}
    b = {r.doc_id: r["shard"] for r in sharding.shard(docs, heavy).collect()}
    moved = [(a[d], b[d]) for d in a if a[d] != b[d]]
    assert moved and all(to in (0, 1) for _, to in moved)   # nothing moves inside or into the unchanged region
    assert not any(frm == 1 for frm, _ in moved)


def test_empty(frame):
    assert sharding.shard(frame(ODD).limit(0)).count() == 0
