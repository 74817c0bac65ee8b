"""The claims view derived from the driver tables.

The test tables hold no insurance claims, so one claim per order is derived
from ``orders JOIN customer`` by integer arithmetic (k = o_orderkey,
u = o_custkey).  The rules are deterministic, so the same rows can be rebuilt
by any SQL engine (see ``halcyon.plans.sqlviews``).

Scale notes: only five columns of ``orders`` and two of ``customer`` are read
(column pruning reaches the parquet scan); the join is a plain equi-join on
the customer key, so Spark picks sort-merge at scale and AQE splits a hot
customer key (skew join) — nothing is broadcast by hint because ``customer``
grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values (the view's text rules) -----------------------------------
REGIONS = ["northeast", "northwest", "southeast", "southwest"]

# phrase and diagnosis code chosen by k mod 8
NOTE_PHRASES = [
    ("Known diabetes, takes Metformin and insulin. HbA1c of {X}%. ", "E11"),
    ("Long-term HTN, on Amlodipine. ", "I10"),
    ("COPD with SOB, uses Tiotropium. ", "J44"),
    ("Asthma, Salbutamol when needed. ", "J45"),
    ("Anxiety, started Sertraline OD. ", "F41"),
    ("Fever, malaria confirmed, Paracetamol TDS. ", "B54"),
    ("Pale and tired, anaemia likely. ", "D50"),
    ("No complaints at this visit. ", "Z00"),
]
# chosen by k mod 3
URGENCY_PHRASES = ["Severe and worsening. ", "Routine annual check, stable. ", "Seen today. "]
# chosen by k mod 4 (the last one is empty)
PROCEDURE_PHRASES = ["ECG done. ", "Chest X-ray and spirometry ordered. ", "Blood test sent. ", ""]
NOISE_MOD, NOISE_REST, NOISE_CODE = 50, 7, "Z00"
# -----------------------------------------------------------------------------


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a small fixed list, as a native CASE expression."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def _hba1c_text(k: Column) -> Column:
    x = (F.lit(75) + k % 40)
    return F.concat((x / 10).cast("long").cast("string"), F.lit("."), (x % 10).cast("string"))


def derive_claims(joined: DataFrame) -> DataFrame:
    """Apply the claim rules to an ``orders JOIN customer`` frame."""
    k = F.col("o_orderkey")
    u = F.col("o_custkey")
    age = (F.lit(18) + (F.lit(7) * u + k) % 47).cast("int")
    smoker_yes = ((F.lit(3) * k + u) % 5) == 0
    bmi = (F.lit(1596) + (F.lit(37) * u + F.lit(11) * k) % 3718).cast("double") / F.lit(100.0)
    children = (k % 6).cast("int")
    charges = (F.lit(250.0) * age.cast("double")
               + F.when(smoker_yes, F.lit(23000.0)).otherwise(F.lit(0.0))
               + F.lit(475.0) * children.cast("double")
               + F.col("o_totalprice").cast("double") / F.lit(200.0))
    sex = F.when(u % 2 == 0, F.lit("male")).otherwise(F.lit("female"))

    phrase_idx = k % 8
    phrase = None
    for i, (text, _) in enumerate(NOTE_PHRASES):
        if "{X}" in text:
            pre, post = text.split("{X}")
            val = F.concat(F.lit(pre), _hba1c_text(k), F.lit(post))
        else:
            val = F.lit(text)
        phrase = F.when(phrase_idx == i, val) if phrase is None else phrase.when(phrase_idx == i, val)
    code = _pick([c for _, c in NOTE_PHRASES], phrase_idx)
    code = F.when(k % NOISE_MOD == NOISE_REST, F.lit(NOISE_CODE)).otherwise(code)

    bp = F.when(k % 4 != 0, F.concat(F.lit("BP "), (F.lit(118) + k % 50).cast("string"), F.lit("/"),
                                     (F.lit(74) + k % 32).cast("string"), F.lit(" mmHg. "))).otherwise(F.lit(""))
    bmi_txt = F.when(k % 3 != 0, F.concat(F.lit("BMI is "), F.floor(bmi).cast("string"), F.lit(". "))) \
        .otherwise(F.lit(""))
    hr = F.when(k % 5 != 0, F.concat(F.lit("HR "), (F.lit(62) + k % 34).cast("string"), F.lit(" bpm."))) \
        .otherwise(F.lit(""))
    note = F.rtrim(F.concat(
        F.lit("Member aged "), age.cast("string"), F.lit(", "), sex, F.lit(". "),
        phrase, _pick(URGENCY_PHRASES, k % 3), _pick(PROCEDURE_PHRASES, k % 4), bp, bmi_txt, hr))

    return joined.select(
        k.alias("claim_key"),
        age.alias("age"),
        sex.alias("sex"),
        bmi.alias("bmi"),
        children.alias("children"),
        F.when(smoker_yes, F.lit("yes")).otherwise(F.lit("no")).alias("smoker"),
        _pick(REGIONS, F.col("c_nationkey") % 4).alias("region"),
        charges.alias("charges"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("claim_ts"),
        note.alias("clinical_note"),
        code.alias("icd_code"),
    )


def claims_view(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The lazy derivation (orders JOIN customer + rules), in so many partitions if ``files`` is given: what
    the rules read is shuffled, and not the notes that they make."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet") \
        .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    joined = o.join(c, o.o_custkey == c.c_custkey, "inner").drop("c_custkey")
    return derive_claims(joined if files is None else joined.repartition(files))


#: rows of a written file, about: what a task that reads one sorts or shuffles stays small
FILE_ROWS = 250_000
_WRITTEN: dict = {}


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per order: the default input of every claims operator.

    Derived once per application and written as parquet to the shared folder;
    every query then scans that table (column pruning and filter pushdown
    apply) instead of repeating the join — the shape a production claims
    table has anyway.
    """
    from halcyon.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = scratch_path(spark, "claims")
        n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()   # parquet footer metadata
        files = max(spark.sparkContext.defaultParallelism, -(-n // FILE_ROWS))
        claims_view(spark, sf_dir, files).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


RAW_COLUMNS = ["age", "sex", "bmi", "children", "smoker", "region", "charges"]


def claim_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims shaped like incoming requests (gender, boolean smoker, padded
    region text), with some out-of-range or missing fields so validation has
    something to reject.  Every change is a pure function of the claim key."""
    c = claims(spark, sf_dir)
    k = F.col("claim_key")
    return c.select(
        "claim_key",
        F.when(k % 11 == 0, F.col("age") - 70).otherwise(F.col("age")).alias("age"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
         .when(k % 2 == 0, F.initcap("sex")).otherwise(F.upper("sex")).alias("gender"),
        F.when(k % 13 == 0, F.col("bmi") * 1.5).otherwise(F.col("bmi")).alias("bmi"),
        F.when(k % 19 == 0, F.col("children") + 9).otherwise(F.col("children")).alias("children"),
        (F.col("smoker") == "yes").alias("smoker"),
        F.when(k % 7 == 3, F.concat(F.lit("  "), F.upper("region"), F.lit(" ")))
         .when(k % 7 == 4, F.concat(F.lit("\t"), F.col("region"), F.lit("\r")))
         .when(k % 23 == 0, F.lit("central"))
         .otherwise(F.col("region")).alias("region"),
        F.when(k % 3 == 1, F.lit(None).cast("string")).otherwise(F.col("clinical_note")).alias("clinical_note"),
    )
