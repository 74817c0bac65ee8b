"""CSV by header name, typed casts that count their failures, tables that are never overwritten on error."""

import pytest
from pyspark.sql import functions as F

from halcyon.functions import encode as E
from halcyon.operators import ingest as V
from halcyon.sources import files as S
from halcyon.streaming import jobs


def _csv(tmp_path, text):
    p = tmp_path / "in.csv"
    p.write_text(text)
    return str(p)


def test_columns_are_found_by_header(spark, tmp_path):
    path = _csv(tmp_path, "Children,REGION,age,note\n2,southwest,31,x\n0,northeast,57,y\n")
    rows = S.read_claims_csv(spark, path).orderBy("age").collect()
    assert [r.asDict() for r in rows] == [{"age": 31, "children": 2, "region": "southwest"}, {"age": 57, "children": 0, "region": "northeast"}]
    assert set(S.read_claims_csv(spark, path, extra_columns=True).columns) == {"age", "children", "region", "note"}


def test_missing_columns_are_reported_not_raised(spark, tmp_path):
    df = S.read_claims_csv(spark, _csv(tmp_path, "age,bmi\n40,22.5\n"))
    assert V.validation_report(df).first()["missing_columns"] == "charges,children,region,sex,smoker"


def test_bad_numbers_are_counted(spark, tmp_path):
    path = _csv(tmp_path, "age,bmi,charges\n40,22.5,1e3\nforty,22.5,\n 41 ,n/a,7\n")
    assert S.cast_failures(S.read_claims_text(spark, path)).first().asDict() == {"age": 1, "bmi": 1, "charges": 0}
    assert sorted(r.age or 0 for r in S.read_claims_csv(spark, path).collect()) == [0, 40, 41]


def test_missing_file(spark, tmp_path):
    with pytest.raises(S.DataLoadError):
        S.read_claims_csv(spark, str(tmp_path / "none.csv"))


def test_read_or_build_keeps_what_it_cannot_read(spark, tmp_path):
    path = str(tmp_path / "t")
    built = S.read_or_build(spark, path, lambda: spark.range(3))
    assert built.count() == 3
    assert S.read_or_build(spark, path, lambda: spark.range(9)).count() == 3
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        S.read_or_build(spark, str(broken), lambda: spark.range(9)).count()
    assert (broken / "part-0.parquet").read_bytes() == b"not parquet"


def test_blanks_of_any_kind_are_stripped(spark):
    df = spark.createDataFrame([("yes\t", "\tmale", "southwest\r"), (" TRUE\n", "Male ", "\x0bnortheast")], "s string, x string, r string")
    rows = df.select(E.encode_smoker("s"), E.encode_sex("x"), E.encode_region("r")).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 3), (1, 1, 0)]


def test_landing_loses_no_rows(spark, tmp_path):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.timestamp_seconds(F.col("id") * 1000)).alias("t"))
    out = jobs.land_files(df, str(tmp_path / "land"), files=4, order_by="t")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))
