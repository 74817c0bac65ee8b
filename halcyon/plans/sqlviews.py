"""SQL text of the derived views, for the DuckDB oracle.

Only base tables are registered on the oracle side, so every oracle query
inlines these as ``WITH`` blocks.  They restate the rules of
``halcyon.sources.claims`` in portable SQL (all arithmetic cast to DOUBLE,
because DuckDB reads decimal literals as DECIMAL).
"""

CLAIMS_BASE = """
claims_base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS u, o.o_totalprice AS price,
         o.o_orderdate AS ts, c.c_nationkey AS nk
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
claims_num AS (
  SELECT k, u, price, ts, nk,
         CAST(18 + (7 * u + k) % 47 AS INTEGER) AS age,
         CAST(1596 + (37 * u + 11 * k) % 3718 AS DOUBLE) / CAST(100 AS DOUBLE) AS bmi,
         CAST(k % 6 AS INTEGER) AS children,
         ((3 * k + u) % 5 = 0) AS smk
  FROM claims_base
),
claims AS (
  SELECT k AS claim_key, age,
         CASE WHEN u % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
         bmi, children,
         CASE WHEN smk THEN 'yes' ELSE 'no' END AS smoker,
         CASE nk % 4 WHEN 0 THEN 'northeast' WHEN 1 THEN 'northwest'
                     WHEN 2 THEN 'southeast' ELSE 'southwest' END AS region,
         CAST(250 AS DOUBLE) * CAST(age AS DOUBLE)
           + (CASE WHEN smk THEN CAST(23000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
           + CAST(475 AS DOUBLE) * CAST(children AS DOUBLE)
           + CAST(price AS DOUBLE) / CAST(200 AS DOUBLE) AS charges,
         CAST(ts AS TIMESTAMP) AS claim_ts,
         rtrim(
           'Member aged ' || CAST(age AS VARCHAR) || ', '
           || (CASE WHEN u % 2 = 0 THEN 'male' ELSE 'female' END) || '. '
           || (CASE k % 8
                 WHEN 0 THEN 'Known diabetes, takes Metformin and insulin. HbA1c of '
                             || CAST((75 + k % 40) // 10 AS VARCHAR) || '.'
                             || CAST((75 + k % 40) % 10 AS VARCHAR) || '%. '
                 WHEN 1 THEN 'Long-term HTN, on Amlodipine. '
                 WHEN 2 THEN 'COPD with SOB, uses Tiotropium. '
                 WHEN 3 THEN 'Asthma, Salbutamol when needed. '
                 WHEN 4 THEN 'Anxiety, started Sertraline OD. '
                 WHEN 5 THEN 'Fever, malaria confirmed, Paracetamol TDS. '
                 WHEN 6 THEN 'Pale and tired, anaemia likely. '
                 ELSE 'No complaints at this visit. ' END)
           || (CASE k % 3 WHEN 0 THEN 'Severe and worsening. '
                          WHEN 1 THEN 'Routine annual check, stable. '
                          ELSE 'Seen today. ' END)
           || (CASE k % 4 WHEN 0 THEN 'ECG done. '
                          WHEN 1 THEN 'Chest X-ray and spirometry ordered. '
                          WHEN 2 THEN 'Blood test sent. ' ELSE '' END)
           || (CASE WHEN k % 4 <> 0 THEN 'BP ' || CAST(118 + k % 50 AS VARCHAR) || '/'
                                          || CAST(74 + k % 32 AS VARCHAR) || ' mmHg. ' ELSE '' END)
           || (CASE WHEN k % 3 <> 0 THEN 'BMI is ' || CAST(CAST(floor(bmi) AS BIGINT) AS VARCHAR) || '. '
                    ELSE '' END)
           || (CASE WHEN k % 5 <> 0 THEN 'HR ' || CAST(62 + k % 34 AS VARCHAR) || ' bpm.' ELSE '' END)
         ) AS clinical_note,
         CASE WHEN k % 50 = 7 THEN 'Z00'
              ELSE (CASE k % 8 WHEN 0 THEN 'E11' WHEN 1 THEN 'I10' WHEN 2 THEN 'J44'
                               WHEN 3 THEN 'J45' WHEN 4 THEN 'F41' WHEN 5 THEN 'B54'
                               WHEN 6 THEN 'D50' ELSE 'Z00' END) END AS icd_code
  FROM claims_num
)"""

CLAIM_REQUESTS = """
claim_requests AS (
  SELECT claim_key,
         CASE WHEN claim_key % 11 = 0 THEN age - 70 ELSE age END AS age,
         CASE WHEN claim_key % 17 = 0 THEN CAST(NULL AS VARCHAR)
              WHEN claim_key % 2 = 0 THEN upper(substr(sex, 1, 1)) || substr(sex, 2)
              ELSE upper(sex) END AS gender,
         CASE WHEN claim_key % 13 = 0 THEN bmi * CAST(1.5 AS DOUBLE) ELSE bmi END AS bmi,
         CASE WHEN claim_key % 19 = 0 THEN children + 9 ELSE children END AS children,
         (smoker = 'yes') AS smoker,
         CASE WHEN claim_key % 7 = 3 THEN '  ' || upper(region) || ' '
              WHEN claim_key % 7 = 4 THEN chr(9) || region || chr(13)
              WHEN claim_key % 23 = 0 THEN 'central'
              ELSE region END AS region,
         CASE WHEN claim_key % 3 = 1 THEN CAST(NULL AS VARCHAR) ELSE clinical_note END AS clinical_note
  FROM claims
)"""


def with_claims(*extra: str) -> str:
    """``WITH`` prefix holding the claims view plus any extra CTE blocks."""
    blocks = [CLAIMS_BASE] + [e.strip().rstrip(",") for e in extra]
    return "WITH " + ",\n".join(b.strip() for b in blocks) + "\n"
