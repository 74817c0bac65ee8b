"""Pieces shared by the training-data operators."""

from __future__ import annotations

import math
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from halcyon.session import cut_lineage, ship_package

#: Words: maximal runs of anything but space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark (any file system)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder (survives lost executors)."""
    ship_package(df.sparkSession)
    return cut_lineage(df)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Within this, what is computed passes ``rows`` rows at a time to Python: for rows that hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: rows of documents passed to Python at once (about 3 MB of text)
DOCUMENT_ROWS = 1000


def lean(run):
    """``run`` (a mapInArrow function that treats batches one by one), giving Arrow's free memory back after each batch."""
    def each(batches):
        for b in batches:
            yield from run(iter([b]))
            pa.default_memory_pool().release_unused()
    return each


def parts(total: float, per_part: float, least: int = 1) -> int:
    """How many pieces of ``per_part`` hold ``total``; follows the data only, never the cluster."""
    return max(least, math.ceil((total or 0) / per_part))


def n_words(text) -> "F.Column":
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: ids (about 16 bytes each in a hash table) that may be broadcast
BROADCAST_IDS = 2_000_000


def small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``df`` staged, counted, and marked for broadcast if it has at most ``most`` rows; else an ordinary join side."""
    df = staged(df)
    return F.broadcast(df) if df.count() <= most else df
