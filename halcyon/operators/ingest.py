"""Load-time validation, cleaning, de-duplication, ids and request checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halcyon.functions import encode as E

# ---- fixed values -----------------------------------------------------------
COLUMN_KINDS = {"age": "numeric", "bmi": "numeric", "children": "numeric", "charges": "numeric",
                "sex": "categorical", "smoker": "categorical", "region": "categorical"}
MIN_ROWS = 100
# request rules: 0 < age < 120, 10 <= bmi <= 70, 0 <= children <= 10,
# gender in {Male, Female}, region in the four canonical regions
REQUEST_GENDERS = ["Male", "Female"]
REQUEST_REGIONS = ["Northeast", "Southeast", "Northwest", "Southwest"]
# -----------------------------------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def validation_report(df: DataFrame, kinds: Mapping[str, str] = COLUMN_KINDS,
                      min_rows: int = MIN_ROWS) -> DataFrame:
    """One-row report for V1-V4 from a single aggregate pass.

    Missing and non-numeric columns are schema facts (metadata only); row count
    and all-null columns come from one ``agg`` over all columns.
    """
    lower = {c.lower(): c for c in df.columns}
    missing = sorted(set(kinds) - set(lower))
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    non_numeric = sorted(c for c, k in kinds.items()
                         if k == "numeric" and c in types and not isinstance(types[c], _NUMERIC))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count(F.col(f"`{c}`")).alias(f"_nn_{i}") for i, c in enumerate(df.columns)]
    r = df.agg(*aggs)
    empty = F.concat_ws(",", F.array_compact(F.array(*[
        F.when(F.col(f"_nn_{i}") == 0, F.lit(c)) for i, c in enumerate(df.columns)])))
    return r.select(
        "n_rows",
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(",".join(non_numeric)).alias("non_numeric_columns"),
        empty.alias("empty_columns"),
        (F.col("n_rows") < F.lit(min_rows)).alias("too_few_rows"),
    ).withColumn("is_valid", (F.col("missing_columns") == "") & (F.col("non_numeric_columns") == "")
                 & (F.col("empty_columns") == "") & ~F.col("too_few_rows"))


class DataValidationError(ValueError):
    pass


def assert_valid(report: DataFrame) -> None:
    """Raise with the reasons when the (one-row) report says invalid."""
    r = report.first()
    if not r["is_valid"]:
        raise DataValidationError(
            f"missing={r['missing_columns']!r} non_numeric={r['non_numeric_columns']!r} "
            f"empty={r['empty_columns']!r} rows={r['n_rows']} (min {MIN_ROWS})")


def normalize_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """strip + lower every string column (V5)."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[F.lower(E.strip(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def dedupe_claims(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop exact duplicates (V6).  Hash aggregate with map-side combine, so a
    group of copies holding a third of the rows collapses before the shuffle."""
    return df.dropDuplicates(list(subset) if subset else None)


def dedupe_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_after, n_removed as one lazy aggregate over both inputs
    (a union of per-side markers, so no join of 1-row tables is needed)."""
    marks = before.select(F.lit(1).alias("_b"), F.lit(0).alias("_a")) \
        .unionByName(after.select(F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    return marks.agg(F.sum("_b").cast("long").alias("n_before"), F.sum("_a").cast("long").alias("n_after")) \
        .withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def with_claim_id(df: DataFrame, cols: Sequence[str], out: str = "claim_id") -> DataFrame:
    """Stable content id (V7)."""
    return df.withColumn(out, E.claim_id(cols))


def canonical_enums(df: DataFrame) -> DataFrame:
    """gender/region to canonical title case, unknown unchanged (V9)."""
    return df.withColumn("gender", E.canonical("gender", E.GENDER_CANON)) \
             .withColumn("region", E.canonical("region", E.REGION_CANON))


def reject_reasons(df: DataFrame) -> DataFrame:
    """Add ``reject_reasons`` (array) for V8 request rules (after V9)."""
    checks = [
        (F.col("age").isNull(), "age_missing"),
        ((F.col("age") <= 0) | (F.col("age") >= 120), "age_out_of_range"),
        (F.col("gender").isNull(), "gender_missing"),
        (~F.col("gender").isin(REQUEST_GENDERS), "gender_invalid"),
        (F.col("bmi").isNull(), "bmi_missing"),
        ((F.col("bmi") < 10) | (F.col("bmi") > 70), "bmi_out_of_range"),
        (F.col("children").isNull(), "children_missing"),
        ((F.col("children") < 0) | (F.col("children") > 10), "children_out_of_range"),
        (F.col("smoker").isNull(), "smoker_missing"),
        (F.col("region").isNull(), "region_missing"),
        (~F.col("region").isin(REQUEST_REGIONS), "region_invalid"),
    ]
    arr = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks]))
    return df.withColumn("reject_reasons", arr)


def split_valid_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) after canonicalisation; both are lazy filters of
    one projection, so Spark evaluates the rules once per consumer."""
    checked = reject_reasons(canonical_enums(df))
    return (checked.where(F.size("reject_reasons") == 0).drop("reject_reasons"),
            checked.where(F.size("reject_reasons") > 0))


def split_valid_claims(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) claims by the request rules (V8), with their columns as they came; the canonical
    sex and region (V9) are only checked."""
    checked = df.select(F.struct(*df.columns).alias("_claim"), "*").withColumn("gender", F.col("sex"))
    checked = reject_reasons(canonical_enums(checked)).select("_claim.*", "reject_reasons")
    return (checked.where(F.size("reject_reasons") == 0).drop("reject_reasons"),
            checked.where(F.size("reject_reasons") > 0))


def request_to_claim(df: DataFrame) -> DataFrame:
    """Request -> claim row (V10): smoker bool -> yes/no, gender -> sex, trimmed region."""
    return (df.withColumn("smoker", F.when(F.col("smoker"), F.lit("yes")).otherwise(F.lit("no")))
              .withColumnRenamed("gender", "sex")
              .withColumn("region", E.strip("region")))
