"""File sources and sinks: claim CSVs, enriched tables, fitted state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halcyon.functions import encode as E

CLAIMS_SCHEMA = T.StructType([
    T.StructField("age", T.IntegerType()),
    T.StructField("sex", T.StringType()),
    T.StructField("bmi", T.DoubleType()),
    T.StructField("children", T.IntegerType()),
    T.StructField("smoker", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("charges", T.DoubleType()),
])


class DataLoadError(IOError):
    pass


def read_claims_text(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns under their lower-cased header names.  A row
    that does not fit the header is an error (``FAILFAST``), not a silent null."""
    try:
        df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    except Exception as e:  # AnalysisException: path does not exist, ...
        raise DataLoadError(f"cannot read claims CSV at {path}: {e}") from e
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _cast(field: T.StructField):
    return E.strip(field.name).try_cast(field.dataType)


def read_claims_csv(spark: SparkSession, path: str, schema: T.StructType = CLAIMS_SCHEMA,
                    extra_columns: bool = False) -> DataFrame:
    """Header CSV with explicit types (S1).  Columns are found by their header
    name, whatever their order; one that the file lacks is absent from the result
    (V1 reports it) and a value that is no number is null (``cast_failures`` counts
    them).  ``extra_columns`` keeps the file's other columns, as text."""
    return typed_claims(read_claims_text(spark, path), schema, extra_columns)


def typed_claims(text: DataFrame, schema: T.StructType = CLAIMS_SCHEMA, extra_columns: bool = False) -> DataFrame:
    known = [f for f in schema.fields if f.name in text.columns]
    cols = [F.col(f.name) if isinstance(f.dataType, T.StringType) else _cast(f).alias(f.name) for f in known]
    names = {f.name for f in schema.fields}
    return text.select(*cols, *[F.col(f"`{c}`") for c in text.columns if extra_columns and c not in names])


def cast_failures(text: DataFrame, schema: T.StructType = CLAIMS_SCHEMA) -> DataFrame:
    """One row with, for each numeric column of the file, how many of its values are no number (V3 on text)."""
    numeric = [f for f in schema.fields if f.name in text.columns and not isinstance(f.dataType, T.StringType)]
    return text.agg(*[F.count_if((E.strip(f.name) != "") & _cast(f).isNull()).alias(f.name) for f in numeric])


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the enriched table when it exists, else build, write and re-read
    it (S3) so later jobs start from the written table, not the lineage.  Whether
    it exists is asked of its file system; a table that cannot be read is an
    error and stays as it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
