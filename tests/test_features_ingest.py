import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from halcyon.functions import encode as E
from halcyon.operators import features as P
from halcyon.operators import ingest as V
from halcyon.operators.cost import CostModel, cost_tier
from halcyon.sources.claims import RAW_COLUMNS


class _Identity:
    """A stand-in model whose prediction is the log of a given cost."""
    def transform(self, df):
        return df.withColumn("prediction", F.log1p("cost"))


TIERS = {"q25": 1520.0, "q50": 4075.5, "q75": 6210.25, "q90": 18333.0}


@pytest.mark.parametrize("cost,tier", [(0.0, "low"), (1520.0, "low"), (1520.01, "medium"), (6210.25, "medium"),
                                       (6210.26, "high"), (18333.0, "high"), (18333.01, "very_high")])
def test_cost_tier_includes_its_upper_limit(spark, cost, tier):
    df = spark.createDataFrame([(cost,)], "cost double")
    assert df.select(cost_tier(F.col("cost"), TIERS).alias("t")).first()["t"] == tier


def test_cost_prediction_rows(spark):
    costs = [42.5, 1999.99, 6300.0, 250000.0]
    m = CostModel(model=_Identity(), model_name="Stub", tiers=TIERS)
    rows = m.predict(spark.createDataFrame([(c,) for c in costs], "cost double")).orderBy("cost").collect()
    assert [r["cost_tier"] for r in rows] == ["low", "medium", "high", "very_high"]
    assert {r["model_used"] for r in rows} == {"Stub"}
    for r, c in zip(rows, costs):
        assert r["ci_lower"] == pytest.approx(c * 0.82, abs=0.02) and r["ci_upper"] == pytest.approx(c * 1.18, abs=0.02)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(25,), (26,), (0,), (100,), (101,)], "age int")
    got = [r["g"] for r in df.select(E.age_group("age").alias("g")).collect()]
    assert got == ["youth", "young_adult", None, "senior", None]


def test_encoders(spark):
    df = spark.createDataFrame([(" Yes ", "MALE", " SouthWest"), ("no", "female", "mars"), (None, None, None)],
                               "smoker string, sex string, region string")
    r = df.select(E.encode_smoker().alias("s"), E.encode_sex().alias("x"), E.encode_region().alias("r")).collect()
    assert [(a["s"], a["x"], a["r"]) for a in r] == [(1, 1, 3), (0, 0, 0), (0, 0, 0)]


def test_preprocessor_standardises_with_population_std(small_claims):
    pre = P.Preprocessor.fit(small_claims)
    out = pre.transform(small_claims).select("age_z", "bmi_z", "region_0_z").toPandas()
    ages = np.array([23, 61, 47, 34, 55, 19, 42, 58], dtype=float)
    assert out["age_z"].to_numpy() == pytest.approx((ages - ages.mean()) / ages.std())
    assert out["bmi_z"].mean() == pytest.approx(0.0, abs=1e-12)
    assert len(pre.features) == 22


def test_targets(small_claims):
    pre = P.Preprocessor.fit(small_claims)
    t = {r["claim_key"]: r for r in pre.transform(small_claims).select("claim_key", "approved", "high_cost_flag")
         .collect()}
    # the most expensive claim and the 61-year-old smoker are rejected; BMI 45.3 is rejected
    assert t[2]["approved"] == 0 and t[8]["approved"] == 0 and t[1]["approved"] == 1
    assert sum(r["high_cost_flag"] for r in t.values()) == 2


def test_validation_report(spark, small_claims):
    r = V.validation_report(small_claims.drop("charges")).first()
    assert r["missing_columns"] == "charges" and r["too_few_rows"] and not r["is_valid"]
    bad = small_claims.withColumn("age", F.col("age").cast("string")).withColumn("x", F.lit(None).cast("int"))
    r = V.validation_report(bad, min_rows=1).first()
    assert r["non_numeric_columns"] == "age" and r["empty_columns"] == "x"


def test_dedupe_and_report(small_claims):
    dup = small_claims.unionByName(small_claims.where("claim_key <= 3"))
    out = V.dedupe_claims(dup)
    assert out.count() == 8
    assert V.dedupe_report(dup, out).first().asDict() == {"n_before": 11, "n_after": 8, "n_removed": 3}


def test_claim_id_matches_python_digest(small_claims):
    r = V.with_claim_id(small_claims, RAW_COLUMNS).where("claim_key = 3").first()
    text = "|".join(str(r[c]) for c in RAW_COLUMNS)
    assert r["claim_id"] == "CLM-" + hashlib.sha256(text.encode()).hexdigest()[:12].upper()


def test_request_rules(spark):
    rows = [(1, 30, " male ", 24.0, 1, True, "northeast"), (2, -5, "Female", 24.0, 1, False, "Southeast"),
            (3, 40, None, 200.0, 1, False, "moon")]
    df = spark.createDataFrame(rows, "claim_key long, age int, gender string, bmi double, children int, "
                                     "smoker boolean, region string")
    ok, bad = V.split_valid_rejected(df)
    assert [r["claim_key"] for r in ok.collect()] == [1]
    reasons = {r["claim_key"]: r["reject_reasons"] for r in bad.collect()}
    assert reasons[2] == ["age_out_of_range"]
    assert set(reasons[3]) == {"gender_missing", "bmi_out_of_range", "region_invalid"}
    claim = V.request_to_claim(ok).first()
    assert claim["sex"] == "Male" and claim["smoker"] == "yes" and claim["region"] == "Northeast"
