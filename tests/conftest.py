import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from halcyon.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="halcyon-test-ckpt-")
    s = get_spark("local[4]", app="halcyon-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_claims(spark):
    """A hand-written claims frame (our own values) with notes and codes."""
    rows = [
        (1, 23, "female", 22.4, 0, "no", "northeast", 2100.5,
         "Annual wellness review, routine check, vitals normal.", "Z00"),
        (2, 61, "male", 31.2, 2, "yes", "southeast", 41250.0,
         "Severe chest pain, acute emergency admission. BP 165/101 mmHg. HR 104 bpm.", "I25"),
        (3, 47, "female", 36.9, 1, "no", "northwest", 9800.25,
         "Type 2 diabetes on metformin and insulin. HbA1c of 8.4% and BMI is 36.9.", "E11"),
        (4, 34, "male", 27.0, 3, "no", "southwest", 6120.0,
         "COPD exacerbation, SOB on exertion, tiotropium inhaler, spirometry ordered.", "J44"),
        (5, 55, "female", 29.5, 0, "yes", "northeast", 28900.75,
         "Hx of HTN, amlodipine OD, ECG done. BP 150/95 mmHg.", "I10"),
        (6, 19, "male", 18.5, 0, "no", "northwest", 1750.0,
         "Asthma, salbutamol when needed, mild wheeze, stable.", "J45"),
        (7, 42, "female", 25.0, 2, "no", "southeast", 7400.0,
         "Anxiety and depression, sertraline started, follow up scheduled.", "F41"),
        (8, 58, "male", 45.3, 1, "no", "southwest", 12999.0,
         "Obesity with BMI 45.3, hyperlipidemia on atorvastatin, blood test sent.", "E66"),
    ]
    schema = ("claim_key long, age int, sex string, bmi double, children int, smoker string, region string, "
              "charges double, clinical_note string, icd_code string")
    return spark.createDataFrame(rows, schema)
