"""SQL text of the layered tables, used to check the Spark plans independently."""

from __future__ import annotations

from perilake.functions.parsing import MISSING_TOKENS
from perilake.sources.schemas import CATEGORIES, CLAIMS, MOTOR

_TOKENS = ", ".join("'" + t + "'" for t in MISSING_TOKENS)


def _clean(name: str) -> str:
    return f"CASE WHEN {name} IN ({_TOKENS}) THEN NULL ELSE {name} END AS {name}"


def _bronze(schema) -> str:
    return ", ".join(_clean(f.name) if f.dataType.typeName() == "string" else f.name for f in schema.fields)


MOTOR_RAW = """motor_raw AS (
  SELECT p_type AS TYPE_VEHICLE,
    CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_brand END AS MAKE,
    o_orderpriority AS USAGE,
    CASE WHEN l_quantity = 1 THEN '0' WHEN l_partkey % 53 = 0 THEN 'n/a'
         ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS INSURED_VALUE,
    CASE WHEN l_suppkey % 41 = 0 THEN NULL
         ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2))
              * (CAST(0.01 AS DECIMAL(4,2)) + CAST(l_tax AS DECIMAL(4,2))) AS VARCHAR) END AS PREMIUM,
    CASE WHEN l_returnflag = 'R'
         THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR)
         END AS CLAIM_PAID,
    CASE WHEN p_size = 50 THEN NULL ELSE CAST(1990 + p_size % 29 AS VARCHAR) END AS PROD_YEAR,
    upper(strftime(least(o_orderdate, l_shipdate), '%d-%b-%y')) AS INSR_BEGIN,
    upper(strftime(greatest(o_orderdate, l_shipdate), '%d-%b-%y')) AS INSR_END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

BRONZE_MOTOR = f"bronze_motor AS (SELECT {_bronze(MOTOR)} FROM motor_raw)"

TYPED = """SELECT TYPE_VEHICLE, MAKE, USAGE,
    TRY_CAST(INSURED_VALUE AS DOUBLE) AS INSURED_VALUE,
    TRY_CAST(PREMIUM AS DOUBLE) AS PREMIUM,
    coalesce(TRY_CAST(CLAIM_PAID AS DOUBLE), 0) AS CLAIM_PAID,
    TRY_CAST(PROD_YEAR AS DOUBLE) AS PROD_YEAR,
    CAST(TRY_STRPTIME(INSR_BEGIN, '%d-%b-%y') AS DATE) AS INSR_BEGIN,
    CAST(TRY_STRPTIME(INSR_END, '%d-%b-%y') AS DATE) AS INSR_END"""

TYPED_MOTOR = f"typed_motor AS ({TYPED} FROM (SELECT DISTINCT * FROM bronze_motor))"

SILVER_MOTOR = """silver_motor AS (
  SELECT * FROM typed_motor WHERE INSURED_VALUE IS NOT NULL AND PREMIUM IS NOT NULL)"""

GOLD_MOTOR = """gold_motor AS (
  SELECT *, CAST(CLAIM_PAID > 0 AS INTEGER) AS had_claim,
    round(PREMIUM / nullif(INSURED_VALUE, 0) * 100, 4) AS premium_rate_pct,
    CAST(date_diff('day', INSR_BEGIN, INSR_END) AS INTEGER) AS policy_duration_days,
    CAST(2024 AS DOUBLE) - coalesce(PROD_YEAR, 2010) AS vehicle_age
  FROM silver_motor)"""

CLAIMS_RAW = """per_order AS (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS acc,
    count(*) FILTER (l_discount > 0.085) AS spd, count(*) FILTER (l_tax > 0.075) AS dui
  FROM lineitem GROUP BY l_orderkey),
order_driver AS (
  SELECT o.*, c.*, coalesce(acc, 0) AS acc, coalesce(spd, 0) AS spd, coalesce(dui, 0) AS dui
  FROM orders o JOIN customer c ON o_custkey = c_custkey LEFT JOIN per_order ON l_orderkey = o_orderkey),
claims_once AS (
  SELECT o_orderkey AS ID,
    CASE o_custkey % 4 WHEN 0 THEN '16-25' WHEN 1 THEN '26-39' WHEN 2 THEN '40-64' ELSE '65+' END AS AGE,
    CASE o_custkey % 2 WHEN 0 THEN 'female' ELSE 'male' END AS GENDER,
    CASE WHEN c_nationkey < 20 THEN 'majority' ELSE 'minority' END AS RACE,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '0-9y' WHEN o_orderpriority = '3-MEDIUM' THEN '10-19y'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '20-29y' ELSE '30y+' END AS DRIVING_EXPERIENCE,
    CASE o_custkey % 3 WHEN 0 THEN 'high school' WHEN 1 THEN 'none' ELSE 'university' END AS EDUCATION,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'poverty' WHEN 'BUILDING' THEN 'working class'
         WHEN 'FURNITURE' THEN 'middle class' ELSE 'upper class' END AS INCOME,
    CASE WHEN c_acctbal < -900 THEN NULL ELSE (c_acctbal + 1000) / 11000 END AS CREDIT_SCORE,
    CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS DOUBLE) AS VEHICLE_OWNERSHIP,
    CASE WHEN o_orderkey % 10 < 3 THEN 'after 2015' ELSE 'before 2015' END AS VEHICLE_YEAR,
    CAST(o_orderkey % 2 AS DOUBLE) AS MARRIED,
    CAST((o_orderkey % 3) % 2 AS DOUBLE) AS CHILDREN,
    CAST(10000 + c_nationkey AS INTEGER) AS POSTAL_CODE,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL
         ELSE CAST(5000 + (o_orderkey * 7919) % 25 * 1000 AS DOUBLE) END AS ANNUAL_MILEAGE,
    CASE WHEN o_orderkey % 20 = 0 THEN 'sports car' ELSE 'sedan' END AS VEHICLE_TYPE,
    CAST(spd AS BIGINT) AS SPEEDING_VIOLATIONS, CAST(dui AS BIGINT) AS DUIS, CAST(acc AS BIGINT) AS PAST_ACCIDENTS,
    CAST(CASE WHEN acc * 2 + spd + dui * 3 + (o_orderkey * 31) % 7 > 8 THEN 1 ELSE 0 END AS DOUBLE) AS OUTCOME
  FROM order_driver),
claims_raw AS (SELECT * FROM claims_once UNION ALL SELECT * FROM claims_once WHERE ID % 97 = 0)"""

BRONZE_CLAIMS = f"bronze_claims AS (SELECT {_bronze(CLAIMS)} FROM claims_raw)"

SILVER_CLAIMS = (
    "silver_claims AS (SELECT DISTINCT * FROM bronze_claims WHERE "
    + " AND ".join(f"{f.name} IS NOT NULL" for f in CLAIMS.fields)
    + ")"
)


def _code(name: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {name}) - 1 AS INTEGER) AS {name}"


GOLD_CLAIMS = f"""encoded AS (
  SELECT {", ".join(_code(f.name) if f.name in CATEGORIES else f.name for f in CLAIMS.fields)} FROM silver_claims),
scored AS (
  SELECT *, CAST(2 * PAST_ACCIDENTS + SPEEDING_VIOLATIONS + 3 * DUIS AS BIGINT) AS risk_score,
    CAST(ANNUAL_MILEAGE > 15000 AS INTEGER) AS high_mileage_flag FROM encoded),
gold_claims AS (
  SELECT *, CAST(CASE WHEN risk_score > -1 AND risk_score <= 2 THEN 0 WHEN risk_score > 2 AND risk_score <= 5 THEN 1
    WHEN risk_score > 5 AND risk_score <= 100 THEN 2 END AS INTEGER) AS risk_tier FROM scored)"""

MOTOR_STEPS = [MOTOR_RAW, BRONZE_MOTOR, TYPED_MOTOR, SILVER_MOTOR, GOLD_MOTOR]
CLAIMS_STEPS = [CLAIMS_RAW, BRONZE_CLAIMS, SILVER_CLAIMS, GOLD_CLAIMS]


def _with(steps: list[str], body: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n" + body


def over_motor(body: str, *steps: str) -> str:
    return _with([*MOTOR_STEPS, *steps], body)


def over_claims(body: str, *steps: str) -> str:
    return _with([*CLAIMS_STEPS, *steps], body)


def over_both(body: str, *steps: str) -> str:
    return _with([*MOTOR_STEPS, *CLAIMS_STEPS, *steps], body)


def money_sum(col: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({col} AS DECIMAL({14 + scale},{scale}))) AS DOUBLE)"


def money_avg(col: str, scale: int = 4) -> str:
    return f"{money_sum(col, scale)} / nullif(count({col}), 0)"
