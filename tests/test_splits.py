"""Exact stratified split: shares, rare classes, many ranges."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from halcyon.operators import modeling as M


@pytest.mark.parametrize("stratum", [20_000, 50])
def test_shares_are_exact_per_class(spark, monkeypatch, stratum):
    monkeypatch.setattr(M, "STRATUM_ROWS", stratum)
    sizes = {"a": 500, "b": 33, "c": 4, "d": 2, "e": 1, None: 10}
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "k long, c string").repartition(4)
    train, test = M.stratified_split(df, "c", ["k"])
    got_train, got_test = train.collect(), test.collect()
    assert len(got_train) + len(got_test) == len(rows)
    assert {r.k for r in got_train} | {r.k for r in got_test} == set(range(len(rows)))
    n = Counter(r.c for r in got_test)
    assert {c: n[c] for c in sizes} == {"a": 100, "b": 7, "c": 1, "d": 1, "e": 0, None: 2}
    again = M.stratified_split(df.repartition(2), "c", ["k"])[1].collect()
    assert {r.k for r in again} == {r.k for r in got_test}


def test_pieces_of_a_model_input_grow_slower_than_its_rows():
    from halcyon.operators.modeling import pieces
    assert [pieces(n) for n in (0, 1, 2000, 2001, 150_000)] == [1, 1, 1, 2, 75]
    assert pieces(9_000_000) < 200 and pieces(54_000_000) < 700


def test_only_the_range_in_which_a_class_is_divided_is_ranked(spark, monkeypatch):
    """Rows of the other ranges go to their side without a shuffle."""
    monkeypatch.setattr(M, "STRATUM_ROWS", 50)
    df = spark.range(4000, numPartitions=4).selectExpr("id AS k", "id % 3 AS c", "repeat('note ', 10) AS note")
    u = {r.k: r.u for r in df.select("k", M.hash_unit(["k"]).alias("u")).collect()}
    train, test = M.stratified_split(df.persist(), "c", ["k"])
    # a class's test rows are those with the smallest hashes
    got = {r.k for r in test.collect()}
    for c in range(3):
        mine = sorted((k for k in u if k % 3 == c), key=lambda k: (u[k], k))
        assert got & set(mine) == set(mine[:round(len(mine) * 0.2)])
    assert {r.k for r in train.collect()} == set(u) - got
    # most rows are still where they were read
    stay = train.select("k", F.spark_partition_id().alias("p")).where("p = floor(k / 1000)").count()
    assert stay > 0.9 * train.count()


def test_gradients_of_a_large_table_come_from_few_pieces():
    from halcyon.operators.notemodels import gradient_pieces
    assert [gradient_pieces(n) for n in (0, 2001, 150_000)] == [1, 2, 32]
    assert gradient_pieces(9_000_000) <= 50 and gradient_pieces(54_000_000) <= 140
