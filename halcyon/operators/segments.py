"""Risk segments: nearest-centroid assignment, profiles, charge-ranked labels.

The assignment is a native expression over a bounded list of centres
(K x d numbers), so it runs per row without a join.  Profiles and labels are
computed on one row per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halcyon.operators.analytics import RISK_LABELS, label_by_rank, profile_by, share_by  # noqa: F401, share_by

PROFILE_COLS = ["age", "bmi", "children", "charges", "risk_score"]

# ---- fixed values: reference centres for the SQL-checked segment queries ----
# space: (age / 100, bmi / 100, smoker 0/1)
FIXED_CENTRES = [
    (0.25, 0.25, 0.0),
    (0.55, 0.30, 0.0),
    (0.30, 0.35, 1.0),
    (0.55, 0.40, 1.0),
]
# -----------------------------------------------------------------------------


def nearest_centre(coords: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """0-based index of the nearest centre (squared Euclidean, first on ties)."""
    dists = []
    for c in centres:
        d = None
        for x, v in zip(coords, c):
            term = (x - F.lit(float(v))) * (x - F.lit(float(v)))
            d = term if d is None else d + term
        dists.append(d)
    arr = F.array(*dists)
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


def fixed_coords() -> list[Column]:
    return [F.col("age").cast("double") / F.lit(100.0), F.col("bmi").cast("double") / F.lit(100.0),
            F.col("smoker").cast("double")]


def fixed_segments(df: DataFrame, centres=FIXED_CENTRES) -> DataFrame:
    """cluster_id by nearest fixed centre on encoded claims."""
    return df.withColumn("cluster_id", nearest_centre(fixed_coords(), centres))


def profiles(seg: DataFrame, cols: Sequence[str] = PROFILE_COLS) -> DataFrame:
    """Mean profile per cluster, 2 dp."""
    return profile_by(seg, "cluster_id", cols)


def labels(prof: DataFrame, labels_: Sequence[str] = RISK_LABELS) -> DataFrame:
    """cluster -> charge rank and risk label."""
    return label_by_rank(prof, "cluster_id", "mean_charges", labels_).select("cluster_id", "charge_rank", "risk_label")


def assign_labels(seg: DataFrame) -> DataFrame:
    lab = labels(profiles(seg))
    return seg.join(F.broadcast(lab), "cluster_id", "left")


def assign_segment(seg: DataFrame, k: int | None = None) -> DataFrame:
    """cluster id, label, score = rank / (K - 1) * 10 (1 dp) and cluster size
    (M15).  Label and size tables have one row per cluster (bounded by K)."""
    lab = labels(profiles(seg))
    sizes = seg.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("similar_members_count"))
    kk = k or len(RISK_LABELS)
    out = seg.join(F.broadcast(lab), "cluster_id", "left").join(F.broadcast(sizes), "cluster_id", "left")
    return out.withColumn("segment_risk_score", F.round(F.col("charge_rank").cast("double") / F.lit(float(kk - 1)) * F.lit(10.0), 1))


def segment_distribution(seg: DataFrame) -> DataFrame:
    """Rows, percentage and mean profile of each risk group (A7): one row per cluster."""
    prof = profiles(seg)
    lab = labels(prof).select("cluster_id", "risk_label")
    return share_by(seg, "cluster_id").join(F.broadcast(prof), "cluster_id").join(F.broadcast(lab), "cluster_id").drop("cluster_id")


def fixed_segments_sql(centres=FIXED_CENTRES) -> tuple[str, str, str]:
    """CTE blocks ``seg``, ``prof``, ``lab`` for the oracle (over ``feat``)."""
    coords = ["CAST(age AS DOUBLE) / CAST(100 AS DOUBLE)", "CAST(bmi AS DOUBLE) / CAST(100 AS DOUBLE)",
              "CAST(smoker AS DOUBLE)"]
    dists = []
    for c in centres:
        dists.append(" + ".join(f"({x} - CAST({v!r} AS DOUBLE)) * ({x} - CAST({v!r} AS DOUBLE))"
                                for x, v in zip(coords, c)))
    arr = "[" + ", ".join(dists) + "]"
    seg = f"seg AS (SELECT *, CAST(list_position({arr}, list_min({arr})) - 1 AS INTEGER) AS cluster_id FROM feat)"
    prof = ("prof AS (SELECT cluster_id, " + ", ".join(f"round(avg({c}), 2) AS mean_{c}" for c in PROFILE_COLS)
            + " FROM seg GROUP BY cluster_id)")
    case = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(RISK_LABELS))
    lab = ("lab AS (SELECT cluster_id, charge_rank, coalesce(CASE charge_rank " + case
           + " END, 'Segment ' || CAST(charge_rank AS VARCHAR)) AS risk_label FROM ("
           "SELECT cluster_id, CAST(row_number() OVER (ORDER BY mean_charges, cluster_id) - 1 AS INTEGER) AS charge_rank"
           " FROM prof) x)")
    return seg, prof, lab
