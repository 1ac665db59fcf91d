"""Grouped reports over the motor and claims tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perilake.functions import risk
from perilake.functions.numeric import exact_avg, exact_sum, percent, round_to, to_whole
from perilake.functions.ordering import down, top, up
from perilake.plans.catalog import plan
from perilake.plans.checksql import money_avg, money_sum, over_claims, over_motor

RATIO_SCALE = 10


def count_all() -> Column:
    return F.count(F.lit(1))


def claim_rate(digits: int) -> Column:
    """Share of claims among rows with a known outcome, in percent."""
    return percent(F.sum(F.col("OUTCOME").cast("bigint")), F.count("OUTCOME"), digits)


_RATE = "round(sum(CAST(OUTCOME AS BIGINT))::DOUBLE / nullif(count(OUTCOME), 0) * 100, {})"
_MOTOR_RATE = "round(sum(had_claim)::DOUBLE / count(*) * 100, {})"


def motor_kpis(gold: DataFrame) -> DataFrame:
    """All five figures from one scan of four columns."""
    claimed = F.col("had_claim") == 1
    return gold.agg(
        count_all().alias("total_policies"),
        F.count_if(claimed).alias("total_claims"),
        round_to(exact_avg(F.col("PREMIUM")), 2).alias("avg_premium"),
        round_to(exact_avg(F.when(claimed, F.col("CLAIM_PAID"))), 2).alias("avg_claim_paid"),
        percent(F.count_if(claimed), count_all(), 2).alias("claim_rate_pct"),
    )


@plan(
    "g01_motor_kpis",
    over_motor(
        f"""SELECT count(*) AS total_policies, count(*) FILTER (had_claim = 1) AS total_claims,
        round({money_avg("PREMIUM")}, 2) AS avg_premium,
        round({money_avg("CASE WHEN had_claim = 1 THEN CLAIM_PAID END")}, 2) AS avg_claim_paid,
        {_MOTOR_RATE.format(2)} AS claim_rate_pct FROM gold_motor"""
    ),
)
def g01(lake):
    return motor_kpis(lake.gold("motor"))


def policies_by_type(gold: DataFrame, n: int = 10) -> DataFrame:
    grouped = gold.groupBy("TYPE_VEHICLE").agg(
        count_all().alias("policies"), round_to(exact_sum(F.col("CLAIM_PAID"))).alias("total_claims_paid")
    )
    return top(grouped, "policies", ["TYPE_VEHICLE"], n)


@plan(
    "g02_policies_by_type",
    over_motor(
        f"""SELECT TYPE_VEHICLE, count(*) AS policies, round({money_sum("CLAIM_PAID")}, 0) AS total_claims_paid
        FROM gold_motor GROUP BY ALL ORDER BY policies DESC, TYPE_VEHICLE NULLS LAST LIMIT 10"""
    ),
)
def g02(lake):
    return policies_by_type(lake.gold("motor"))


def policies_by_make(gold: DataFrame, n: int = 10) -> DataFrame:
    return top(gold.groupBy("MAKE").agg(count_all().alias("policies")), "policies", ["MAKE"], n)


@plan(
    "g03_policies_by_make",
    over_motor(
        """SELECT MAKE, count(*) AS policies FROM gold_motor GROUP BY MAKE
        ORDER BY policies DESC, MAKE NULLS LAST LIMIT 10"""
    ),
)
def g03(lake):
    return policies_by_make(lake.gold("motor"))


def policies_by_year(gold: DataFrame) -> DataFrame:
    return (
        gold.where(F.col("PROD_YEAR").isNotNull())
        .groupBy(to_whole(F.col("PROD_YEAR")).alias("year"))
        .agg(count_all().alias("cnt"))
        .orderBy(up("year"))
    )


@plan(
    "g04_policies_by_year",
    over_motor(
        """SELECT CAST(PROD_YEAR AS INTEGER) AS year, count(*) AS cnt FROM gold_motor
        WHERE PROD_YEAR IS NOT NULL GROUP BY 1 ORDER BY 1"""
    ),
)
def g04(lake):
    return policies_by_year(lake.gold("motor"))


def averages_by_usage(gold: DataFrame) -> DataFrame:
    return gold.groupBy("USAGE").agg(
        round_to(exact_avg(F.col("PREMIUM")), 2).alias("avg_premium"),
        round_to(exact_avg(F.col("CLAIM_PAID")), 2).alias("avg_claim"),
    )


@plan(
    "g05_averages_by_usage",
    over_motor(
        f"""SELECT USAGE, round({money_avg("PREMIUM")}, 2) AS avg_premium,
        round({money_avg("CLAIM_PAID")}, 2) AS avg_claim FROM gold_motor GROUP BY USAGE"""
    ),
)
def g05(lake):
    return averages_by_usage(lake.gold("motor"))


def driver_kpis(gold: DataFrame) -> DataFrame:
    return gold.agg(
        count_all().alias("total_drivers"),
        F.count_if(F.col("risk_tier") == 2).alias("high_risk"),
        claim_rate(2).alias("claim_rate_pct"),
    )


@plan(
    "g06_driver_kpis",
    over_claims(
        f"""SELECT count(*) AS total_drivers, count(*) FILTER (risk_tier = 2) AS high_risk,
        {_RATE.format(2)} AS claim_rate_pct FROM gold_claims"""
    ),
)
def g06(lake):
    return driver_kpis(lake.gold("claims"))


def rate_by(silver: DataFrame, key: str) -> DataFrame:
    return silver.groupBy(key).agg(count_all().alias("drivers"), claim_rate(1).alias("claim_rate_pct"))


@plan(
    "g07_rate_by_age",
    over_claims(
        f"""SELECT AGE, count(*) AS drivers, {_RATE.format(1)} AS claim_rate_pct FROM silver_claims
        GROUP BY AGE ORDER BY claim_rate_pct DESC NULLS LAST, AGE NULLS LAST"""
    ),
)
def g07(lake):
    return rate_by(lake.silver("claims"), "AGE").orderBy(down("claim_rate_pct"), up("AGE"))


@plan(
    "g08_rate_by_experience",
    over_claims(
        f"""SELECT DRIVING_EXPERIENCE, {_RATE.format(1)} AS claim_rate_pct FROM silver_claims
        GROUP BY DRIVING_EXPERIENCE"""
    ),
)
def g08(lake):
    return rate_by(lake.silver("claims"), "DRIVING_EXPERIENCE").drop("drivers")


def drivers_by_tier(gold: DataFrame) -> DataFrame:
    counts = gold.groupBy("risk_tier").agg(count_all().alias("drivers"))
    return counts.withColumn("risk_label", risk.map_values(F.col("risk_tier"), risk.TIER_BY_CODE))


@plan(
    "g09_drivers_by_tier",
    over_claims(
        """SELECT risk_tier, count(*) AS drivers,
        CASE risk_tier WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS risk_label
        FROM gold_claims GROUP BY risk_tier"""
    ),
)
def g09(lake):
    return drivers_by_tier(lake.gold("claims"))


@plan(
    "g10_rate_by_postal_code",
    over_claims(
        f"""SELECT POSTAL_CODE, count(*) AS drivers, {_RATE.format(1)} AS claim_rate_pct FROM silver_claims
        GROUP BY POSTAL_CODE ORDER BY claim_rate_pct DESC NULLS LAST, POSTAL_CODE NULLS LAST LIMIT 20"""
    ),
)
def g10(lake):
    return top(rate_by(lake.silver("claims"), "POSTAL_CODE"), "claim_rate_pct", ["POSTAL_CODE"], 20)


def motor_profile(gold: DataFrame) -> DataFrame:
    return gold.groupBy("TYPE_VEHICLE", "USAGE").agg(
        count_all().alias("total_policies"),
        round_to(exact_avg(F.col("PREMIUM")), 2).alias("avg_premium"),
        round_to(exact_avg(F.col("INSURED_VALUE")), 2).alias("avg_insured_value"),
        round_to(exact_avg(F.col("CLAIM_PAID")), 2).alias("avg_claim_paid"),
        percent(F.sum("had_claim"), F.count("had_claim"), 1).alias("claim_rate_pct"),
        round_to(F.min("PREMIUM"), 2).alias("min_premium"),
        round_to(F.max("PREMIUM"), 2).alias("max_premium"),
    )


MOTOR_PROFILE_SQL = f"""SELECT TYPE_VEHICLE, USAGE, count(*) AS total_policies,
  round({money_avg("PREMIUM")}, 2) AS avg_premium,
  round({money_avg("INSURED_VALUE")}, 2) AS avg_insured_value,
  round({money_avg("CLAIM_PAID")}, 2) AS avg_claim_paid,
  {_MOTOR_RATE.format(1)} AS claim_rate_pct,
  round(min(PREMIUM), 2) AS min_premium, round(max(PREMIUM), 2) AS max_premium
  FROM gold_motor GROUP BY TYPE_VEHICLE, USAGE"""


@plan("g11_motor_profile", over_motor(MOTOR_PROFILE_SQL))
def g11(lake):
    return motor_profile(lake.gold("motor"))


def make_profile(gold: DataFrame, n: int = 60) -> DataFrame:
    grouped = (
        gold.where(F.col("MAKE").isNotNull())
        .groupBy("MAKE", "TYPE_VEHICLE")
        .agg(
            count_all().alias("total_policies"),
            round_to(exact_avg(F.col("PREMIUM")), 2).alias("avg_premium"),
            round_to(exact_avg(F.col("CLAIM_PAID")), 2).alias("avg_claim_paid"),
            percent(F.sum("had_claim"), F.count("had_claim"), 1).alias("claim_rate_pct"),
        )
    )
    return top(grouped, "total_policies", ["MAKE", "TYPE_VEHICLE"], n)


MAKE_PROFILE_SQL = f"""SELECT MAKE, TYPE_VEHICLE, count(*) AS total_policies,
  round({money_avg("PREMIUM")}, 2) AS avg_premium, round({money_avg("CLAIM_PAID")}, 2) AS avg_claim_paid,
  {_MOTOR_RATE.format(1)} AS claim_rate_pct
  FROM gold_motor WHERE MAKE IS NOT NULL GROUP BY MAKE, TYPE_VEHICLE
  ORDER BY total_policies DESC, MAKE NULLS LAST, TYPE_VEHICLE NULLS LAST LIMIT 60"""


@plan("g12_make_profile", over_motor(MAKE_PROFILE_SQL))
def g12(lake):
    return make_profile(lake.gold("motor"))


def driver_profile(silver: DataFrame) -> DataFrame:
    return silver.groupBy("AGE", "DRIVING_EXPERIENCE").agg(
        count_all().alias("total_drivers"),
        claim_rate(1).alias("claim_rate_pct"),
        round_to(exact_avg(F.col("ANNUAL_MILEAGE"))).alias("avg_mileage"),
        round_to(exact_avg(F.col("CREDIT_SCORE"), RATIO_SCALE), 3).alias("avg_credit_score"),
        round_to(exact_avg(F.col("PAST_ACCIDENTS")), 2).alias("avg_accidents"),
    )


DRIVER_PROFILE_SQL = f"""SELECT AGE, DRIVING_EXPERIENCE, count(*) AS total_drivers,
  {_RATE.format(1)} AS claim_rate_pct, round({money_avg("ANNUAL_MILEAGE")}, 0) AS avg_mileage,
  round({money_avg("CREDIT_SCORE", RATIO_SCALE)}, 3) AS avg_credit_score,
  round({money_avg("PAST_ACCIDENTS")}, 2) AS avg_accidents
  FROM silver_claims GROUP BY AGE, DRIVING_EXPERIENCE"""


@plan("g13_driver_profile", over_claims(DRIVER_PROFILE_SQL))
def g13(lake):
    return driver_profile(lake.silver("claims"))


def tier_profile(gold: DataFrame) -> DataFrame:
    return (
        gold.groupBy("risk_tier")
        .agg(
            count_all().alias("total_drivers"),
            claim_rate(1).alias("claim_rate_pct"),
            round_to(exact_avg(F.col("risk_score")), 2).alias("avg_risk_score"),
        )
        .select(
            "risk_tier", risk.tier_name(F.col("risk_tier")).alias("risk_level"), "total_drivers", "claim_rate_pct",
            "avg_risk_score",
        )
    )


TIER_PROFILE_SQL = f"""SELECT risk_tier, CASE risk_tier WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS risk_level,
  count(*) AS total_drivers, {_RATE.format(1)} AS claim_rate_pct,
  round({money_avg("risk_score")}, 2) AS avg_risk_score
  FROM gold_claims GROUP BY risk_tier"""


@plan(
    "g14_tier_profile",
    over_claims(f"SELECT risk_level, total_drivers, claim_rate_pct, avg_risk_score FROM ({TIER_PROFILE_SQL})"),
)
def g14(lake):
    return tier_profile(lake.gold("claims")).drop("risk_tier")
