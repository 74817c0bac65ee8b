"""Shared model plumbing: deterministic splits and the scaled feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halcyon.operators.features import FEATURES, Preprocessor, assemble
from halcyon.session import cut_lineage

SEED = 42
TEST_SHARE = 0.2


def hash_unit(key_cols: Sequence[str], seed: int = SEED, salt: int = 0) -> F.Column:
    """A per-row number in [0, 1) from a hash of the key — stable under any
    repartitioning (unlike ``randomSplit``, which depends on partition order)."""
    h = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed), F.lit(salt))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))


def hash_split(df: DataFrame, key_cols: Sequence[str], test_share: float = TEST_SHARE,
               seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key (M1)."""
    u = hash_unit(key_cols, seed)
    return df.where(u >= test_share), df.where(u < test_share)


#: rows of a class that one task ranks at once, about
STRATUM_ROWS = 20_000
#: classes whose place of division may be broadcast (about 50 bytes each)
BROADCAST_CLASSES = 1_000_000


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str], test_share: float = TEST_SHARE,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly the rounded share of every class in test, and at
    least one row on either side for a class of two rows or more (M2).

    Rows are ranked by the key's hash within their class.  The hash is cut into
    ranges of about ``STRATUM_ROWS`` rows, which are counted by class: only the range
    in which a class's test share ends is ranked row by row, all others lie on one
    side as they are, so rows are not shuffled but for about one range."""
    ranges = max(1, -(-df.count() // STRATUM_ROWS))
    rows = df.withColumn("_u", hash_unit(key_cols, seed)).withColumn("_range", F.floor(F.col("_u") * ranges).cast("int"))
    counts = rows.groupBy(F.col(label).alias("_class"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy("_class").orderBy("_r")
    counts = counts.select("_class", "_r", "_n",
                           F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy("_class")).alias("_all"))
    wanted = F.when(F.col("_all") < 2, 0).otherwise(F.least(F.greatest(F.round(F.col("_all") * test_share), F.lit(1.0)), F.col("_all") - 1))
    counts = counts.withColumn("_left", wanted - F.col("_before"))
    # the first range that does not go into test as a whole; every class has one
    ends = cut_lineage(counts.where((F.col("_left") >= 0) & (F.col("_left") < F.col("_n"))).groupBy("_class").agg(
        F.min(F.struct("_r", "_left")).alias("_end")).select("_class", "_end._r", "_end._left"))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_CLASSES else ends
    rows = rows.join(ends, F.col(label).eqNullSafe(F.col("_class")))
    ranked = rows.where("_range = _r").withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_range").orderBy("_u", *key_cols)))
    whole = [rows.where(side).select(*df.columns) for side in ("_range > _r", "_range < _r")]
    divided = [ranked.where(side).select(*df.columns) for side in ("_rank > _left", "_rank <= _left")]
    return tuple(w.unionByName(d) for w, d in zip(whole, divided))


def fold_column(df: DataFrame, key_cols: Sequence[str], k: int, seed: int = SEED, out: str = "fold") -> DataFrame:
    """Deterministic fold id 0..k-1 for ``CrossValidator(foldCol=...)``."""
    return df.withColumn(out, F.floor(hash_unit(key_cols, seed, salt=7) * k).cast("int"))


ROWS_PER_PARTITION = 2_000
#: pieces of that size, about; beyond, one more for each LARGE_PIECE rows
SMALL_PIECES, LARGE_PIECE = 96, 100_000


def pieces(n: int) -> int:
    """Pieces of a model input of ``n`` rows.  What each task sends to the driver or to the next stage (metrics, histograms,
    gradients) does not depend on its rows, so pieces become larger with the table."""
    return max(1, min(-(-n // ROWS_PER_PARTITION), SMALL_PIECES + n // LARGE_PIECE))


def size_partitions(df: DataFrame, n_rows: int | None = None, key: str = "claim_key", pieces=pieces) -> DataFrame:
    """Repartition a model input into ``pieces`` of its rows (2,000 rows each, more in large tables), by the hash of
    its key and in key order within a piece.  Learners that draw samples per
    partition then see the same rows in the same order on any cluster: the number
    of pieces follows the rows, not the cores."""
    n = n_rows if n_rows is not None else df.count()
    parts = pieces(n)
    if key not in df.columns:
        return df.repartition(parts)
    return df.repartition(parts, key).sortWithinPartitions(key)


def model_matrix(claims: DataFrame, pre: Preprocessor | None = None) -> tuple[DataFrame, Preprocessor]:
    """Fit (or reuse) the preprocessor and return rows with ``features``
    (scaled, 22 dims), ``log_charges``, ``charges`` and the targets, in
    partitions sized for iterative model fitting."""
    pre = pre or Preprocessor.fit(claims)
    out = assemble(pre.transform(claims), FEATURES)
    return size_partitions(out), pre


def coefficients_table(spark, names: Sequence[str], values: Sequence[float], top: int = 15) -> DataFrame:
    """Feature weight table (A17): |coefficient| or importance, top-n.  The
    input is one number per feature (bounded by the feature count)."""
    rows = [(n, float(abs(v))) for n, v in zip(names, values)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(top)
