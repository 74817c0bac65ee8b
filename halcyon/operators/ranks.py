"""Distributed cumulative counts, exact quantiles and percentile ranks.

A window ordered over a whole table (``Window.orderBy(v)`` without a
partition) moves every row into one task.  Instead:

1. pre-aggregate to one row per (group, value) with per-value weights — a hot
   value holding a third of the rows becomes one row, combined map-side;
2. cut the distinct values of each group into ranges of at most ``BUCKET_ROWS``
   values: ``percentile_approx`` (a mergeable sketch) gives splitters, a binary search
   puts each value into its range, and ranges that are still too large are cut
   again, so the number of ranges follows the values and not a setting;
3. total each (group, range) and turn the totals into prefix offsets with a window over the ranges;
4. run the ordered running sum inside (group, range) partitions only and add
   the offset.

The result is exact (the cut points only decide *where* rows are ranked, not
*how*), and no task ever holds more than one range of distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from halcyon.session import cut_lineage

#: distinct values that one task ranks at once, at most
BUCKET_ROWS = 100_000
#: ranges that one round cuts a range into, at most; rounds (1001^6 ranges still fit a long)
FAN, ROUNDS = 1000, 6
#: rows of offsets or splitters that may be broadcast
BROADCAST_ROWS = 100_000


def position(value: Column, sorted_values: Column, at_most: int, inclusive: bool = False) -> Column:
    """How many of the first ``at_most`` elements of an increasing array are below the value (``inclusive``: or equal),
    by binary search inside the row."""
    steps = [1 << k for k in range(max(at_most, 1).bit_length() - 1, -1, -1)]

    def step(acc, s):
        x = F.get(sorted_values, acc + s - 1)
        below = (x <= value) if inclusive else (x < value)
        return F.when(F.coalesce(below, F.lit(False)), acc + s).otherwise(acc)      # past the end there is no element
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def with_ranges(counts: DataFrame, value: str, by: Sequence[str], rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """``counts`` (staged) with ``_b``, the number of the value's range within its group, in the order of the values; and
    how many (group, range) there are at most.  Ranges of more than ``rows`` values are cut until there are none."""
    keys = [*by, "_b"]
    n = counts.count()
    keyed = counts.withColumn("_b", F.lit(0).cast("long"))
    if n <= rows:
        return keyed, n
    ranges = n
    for _ in range(ROUNDS):
        sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
        st = sizes.agg(F.max("_m").alias("m"), F.sum((F.col("_m") > rows).cast("long")).alias("big"), F.count(F.lit(1)).alias("all")).first()
        ranges = st["all"]
        if not st["big"]:
            break
        pieces = min(FAN, max(2, -(-2 * st["m"] // rows)))
        big = _maybe_broadcast(sizes.where(F.col("_m") > rows).select(*keys), st["big"])
        shares = [i / pieces for i in range(1, pieces)]
        cuts = keyed.join(big, keys).groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), shares, 10_000).alias("_cuts"))
        if st["all"] == 1:          # one range of one group: its cuts are a constant, not an array that every row carries
            found = cuts.first()["_cuts"] or []
            inside = position(F.col(value).cast("double"), F.array(*[F.lit(c) for c in found]), pieces) if found else F.lit(0)
            keyed = keyed.withColumn("_b", F.col("_b") * (FAN + 1) + F.coalesce(inside, F.lit(0)))
        else:
            keyed = keyed.join(_maybe_broadcast(cuts, st["big"] * pieces), keys, "left")
            inside = position(F.col(value).cast("double"), F.col("_cuts"), pieces)
            keyed = keyed.withColumn("_b", F.col("_b") * (FAN + 1) + F.coalesce(inside, F.lit(0))).drop("_cuts")
        keyed = cut_lineage(keyed)
    return keyed, ranges


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = (),
                      weights: Mapping[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """Per (by..., value): the weight of the value, the running weight of all
    values <= it (``cum_<w>``) and the group total (``tot_<w>``).

    ``weights`` maps output names to numeric columns; default ``{"n": 1}``.
    """
    by = list(by)
    weights = dict(weights or {"n": F.lit(1)})
    wn = list(weights)
    counts = df.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    # all passes read the compact count table: write it once (reliable checkpoint in the
    # shared folder) instead of re-running the upstream plan
    keyed, ranges = with_ranges(cut_lineage(counts), value, by, rows or BUCKET_ROWS)
    totals = keyed.groupBy(*by, "_b").agg(*[F.sum(n).alias(f"_bt_{n}") for n in wn])
    wg = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    wprev = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_bt_{n}").over(wprev), F.lit(0)).alias(f"_off_{n}") for n in wn],
        *[F.sum(f"_bt_{n}").over(wg).alias(f"tot_{n}") for n in wn])
    joined = keyed.join(_maybe_broadcast(offsets, ranges), by + ["_b"], "inner")
    wrun = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *by, value, *wn,
        *[(F.col(f"_off_{n}") + F.sum(n).over(wrun)).alias(f"cum_{n}") for n in wn],
        *[F.col(f"tot_{n}") for n in wn])


def quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (),
              names: Sequence[str] | None = None, exact: bool = True, accuracy: int = 100000,
              weight: Column | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default, DuckDB's
    ``quantile_cont``), one row per group, one column per quantile.

    Each (group, value) row checks which target ranks fall in its rank range,
    so no join and no single-task sort is needed.  The exact path costs a
    sketch pass plus a rank pass; ``exact=False`` answers in one pass from the
    mergeable ``percentile_approx`` sketch (rank error <= n / ``accuracy``,
    and no interpolation).  With ``weight`` a row stands for so many (exact only).
    """
    by = list(by)
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    if not exact:
        a = df.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), list(qs), accuracy).alias("_q"))
        return a.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    nonnull = df.where(F.col(value).isNotNull())
    cc = cumulative_counts(nonnull, value, by, {"n": F.lit(1) if weight is None else weight})
    lo_rank = F.col("cum_n") - F.col("n")  # 0-based rank of the first copy
    targets = []
    for i, q in enumerate(qs):
        h = (F.col("tot_n") - 1).cast("double") * F.lit(float(q))
        lo = F.floor(h)
        hi = F.ceil(h)
        targets.append(F.when((lo >= lo_rank) & (lo < F.col("cum_n")),
                              F.struct(F.lit(i).alias("qi"), F.lit(0).alias("side"),
                                       (h - lo).alias("frac"))))
        targets.append(F.when((hi >= lo_rank) & (hi < F.col("cum_n")),
                              F.struct(F.lit(i).alias("qi"), F.lit(1).alias("side"),
                                       (h - lo).alias("frac"))))
    hits = cc.select(*by, F.col(value).cast("double").alias("_v"),
                     F.explode(F.filter(F.array(*targets), lambda t: t.isNotNull())).alias("_t"))
    per_q = hits.groupBy(*by, "_t.qi").agg(
        F.max(F.when(F.col("_t.side") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_t.side") == 1, F.col("_v"))).alias("_hi"),
        F.max("_t.frac").alias("_f"))
    per_q = per_q.withColumn("_q", F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo")))
    return per_q.groupBy(*by).agg(
        *[F.max(F.when(F.col("qi") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])


def global_quantiles(df: DataFrame, value: str, qs: Sequence[float],
                     names: Sequence[str] | None = None, exact: bool = True) -> dict:
    """Quantiles of a whole column as a small dict (one bounded row)."""
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    row = quantiles(df, value, qs, names=names, exact=exact).first()
    return {n: (row[n] if row is not None else None) for n in names}


def percentile_rank(reference: DataFrame, scored: DataFrame, value: str,
                    out: str = "percentile_rank") -> DataFrame:
    """100 * share of reference values <= each scored value (1 dp).

    Doubles are looked up among the at most 1,001 reference values at which the rank changes, so the scored rows are
    read once and do not move.  Values of other types (a cast could merge them) are put in one value-count table with
    the reference rows, with a reference weight of 1 / 0, and the scored rows are joined back on the value.
    """
    if all(isinstance(d.schema[value].dataType, (DoubleType, FloatType)) for d in (reference, scored)):
        return scored.withColumn(out, rank_of(F.col(value), rank_levels(reference, value)))
    both = reference.select(F.col(value).alias("_v"), F.lit(1).alias("_r")) \
        .unionByName(scored.select(F.col(value).alias("_v"), F.lit(0).alias("_r")))
    cc = cumulative_counts(both.where(F.col("_v").isNotNull()), "_v", weights={"r": F.col("_r")})
    ranks = cc.select(F.col("_v"), F.round(F.try_divide(F.lit(100.0) * F.col("cum_r"), F.col("tot_r")), 1).alias(out))
    return scored.join(ranks, scored[value] == ranks["_v"], "left").drop("_v")


def rank_levels(reference: DataFrame, value: str) -> list[tuple[float, float]]:
    """(smallest reference value, percentile rank) for each rank that occurs, in order.

    Ranks have one decimal, so these are at most 1,001 rows however large the reference is, and they give
    the exact rank of any value, seen or not (``rank_of``): it changes only at these values."""
    cc = cumulative_counts(reference.where(F.col(value).isNotNull()), value)
    rank = F.round(F.lit(100.0) * F.col("cum_n") / F.col("tot_n"), 1)
    rows = cc.select(F.col(value).cast("double").alias("v"), rank.alias("r")).groupBy("r").agg(F.min("v").alias("v")).collect()
    return sorted((float(x["v"]), float(x["r"])) for x in rows)


def rank_of(value: Column, levels: Sequence[tuple[float, float]]) -> Column:
    """The percentile rank of any value against the reference of ``levels``: that of the largest reference value not above it,
    0 below all of them, null for null.  A native expression, so it works in streams."""
    if not levels:
        return F.lit(None).cast("double")
    at = position(value.cast("double"), F.array(*[F.lit(v) for v, _ in levels]), len(levels), inclusive=True)
    return F.when(value.isNotNull(), F.get(F.array(F.lit(0.0), *[F.lit(r) for _, r in levels]), at))
