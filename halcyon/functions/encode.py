"""Column expressions for encoding and binning claim fields (all native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
SMOKER_TRUE = ["yes", "true", "1"]
SEX_TRUE = ["male", "true", "1"]
REGION_CODES = {"northeast": 0, "northwest": 1, "southeast": 2, "southwest": 3}
AGE_EDGES = [0, 25, 35, 45, 55, 100]
AGE_LABELS = ["youth", "young_adult", "adult", "middle_aged", "senior"]
BMI_EDGES = [0, 18.5, 25.0, 30.0, 100]
BMI_LABELS = ["underweight", "normal", "overweight", "obese"]
# canonical request spellings
GENDER_CANON = {"male": "Male", "female": "Female"}
REGION_CANON = {"northeast": "Northeast", "northwest": "Northwest",
                "southeast": "Southeast", "southwest": "Southwest"}
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


BLANKS = "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$"


def strip(col) -> Column:
    """The text without blanks (tabs and line ends too) at its ends; ``trim`` takes spaces only."""
    return F.regexp_replace(_c(col).cast("string"), BLANKS, "")


def flag_in(col, truthy: Sequence[str]) -> Column:
    """1 when the lower-case text of col without blanks around it is one of ``truthy`` else 0 (nulls -> 0)."""
    txt = F.lower(strip(col))
    return F.coalesce(txt.isin(list(truthy)), F.lit(False)).cast("int")


def encode_smoker(col="smoker") -> Column:
    return flag_in(col, SMOKER_TRUE)


def encode_sex(col="sex") -> Column:
    return flag_in(col, SEX_TRUE)


def encode_region(col="region", codes: dict | None = None) -> Column:
    """Fixed region code; unknown or null -> 0."""
    codes = codes or REGION_CODES
    txt = F.lower(strip(col))
    expr = None
    for name, code in codes.items():
        expr = F.when(txt == name, F.lit(code)) if expr is None else expr.when(txt == name, F.lit(code))
    return F.coalesce(expr, F.lit(0)).cast("int")


def bin_right_closed(col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edges[i], edges[i+1]] holding the value; null outside.

    Right-closed like ``pandas.cut`` (``ml.Bucketizer`` is left-closed).
    """
    x = _c(col)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def age_group(col="age") -> Column:
    return bin_right_closed(col, AGE_EDGES, AGE_LABELS)


def bmi_category(col="bmi") -> Column:
    return bin_right_closed(col, BMI_EDGES, BMI_LABELS)


def canonical(col, mapping: dict) -> Column:
    """Trim/lower and map to the canonical spelling; unknown values unchanged."""
    txt = F.lower(strip(col))
    expr = None
    for k, v in mapping.items():
        expr = F.when(txt == k, F.lit(v)) if expr is None else expr.when(txt == k, F.lit(v))
    return expr.otherwise(_c(col))


def patient_category(smoker="smoker", bmi="bmi", age="age") -> Column:
    """Ordered 5-way profile rule (first match wins)."""
    s, b, a = _c(smoker), _c(bmi), _c(age)
    return (F.when((s == "yes") & (b > 30), F.lit("high_bmi_smoker"))
            .when((s == "no") & (b > 30), F.lit("high_bmi_nonsmoker"))
            .when((a < 35) & (b < 28), F.lit("young_healthy"))
            .when(a > 55, F.lit("elderly_hypertension"))
            .otherwise(F.lit("general")))


def claim_id(cols: Sequence[str], sep: str = "|") -> Column:
    """'CLM-' + first 12 hex digits (upper case) of sha256 over the row values
    joined by ``sep``.  Doubles are rendered by Spark's cast to string, which
    equals Python's ``str`` for magnitudes in [1e-3, 1e7)."""
    joined = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])
    return F.concat(F.lit("CLM-"), F.upper(F.substring(F.sha2(joined, 256), 1, 12)))
