"""Reports rebuilt from merged partials instead of the full tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perilake.functions import risk
from perilake.functions.numeric import round_to
from perilake.functions.ordering import top
from perilake.operators.chunks import all_chunks
from perilake.operators.partials import mean, merge, partials, total

MOTOR_KEYS = ("TYPE_VEHICLE", "USAGE", "MAKE")
CLAIMS_KEYS = ("AGE", "DRIVING_EXPERIENCE", "risk_tier")


def motor_partials(gold: DataFrame, *more_keys: str) -> DataFrame:
    sums = ["PREMIUM", "INSURED_VALUE", "CLAIM_PAID", "had_claim"]
    return partials(gold, [*more_keys, *MOTOR_KEYS], sums, extremes=["PREMIUM"])


def claims_partials(featured: DataFrame, *more_keys: str) -> DataFrame:
    sums = {"OUTCOME": 0, "ANNUAL_MILEAGE": 4, "CREDIT_SCORE": 10, "PAST_ACCIDENTS": 0, "risk_score": 0}
    return partials(featured, [*more_keys, *CLAIMS_KEYS], sums)


def _rounded(name: str, digits: int) -> Column:
    return round_to(mean(name), digits)


def _rate(name: str, digits: int) -> Column:
    return round_to(mean(name) * F.lit(100.0), digits)


def motor_kpis(parts: DataFrame) -> DataFrame:
    claims = F.col("sum_had_claim").cast("bigint")
    # Rows without a claim paid nothing, so the sum over claims is the whole sum.
    paid = F.try_divide(total("CLAIM_PAID"), F.nullif(claims, F.lit(0)).cast("double"))
    return merge(parts, []).select(
        F.coalesce("n", F.lit(0)).alias("total_policies"),
        F.coalesce(claims, F.lit(0)).alias("total_claims"),
        _rounded("PREMIUM", 2).alias("avg_premium"),
        round_to(paid, 2).alias("avg_claim_paid"),
        _rate("had_claim", 2).alias("claim_rate_pct"),
    )


def motor_profile(parts: DataFrame) -> DataFrame:
    return merge(parts, ["TYPE_VEHICLE", "USAGE"]).select(
        "TYPE_VEHICLE",
        "USAGE",
        F.col("n").alias("total_policies"),
        _rounded("PREMIUM", 2).alias("avg_premium"),
        _rounded("INSURED_VALUE", 2).alias("avg_insured_value"),
        _rounded("CLAIM_PAID", 2).alias("avg_claim_paid"),
        _rate("had_claim", 1).alias("claim_rate_pct"),
        round_to(F.col("min_PREMIUM"), 2).alias("min_premium"),
        round_to(F.col("max_PREMIUM"), 2).alias("max_premium"),
    )


def make_profile(parts: DataFrame, n: int = 60) -> DataFrame:
    known = merge(parts.where(F.col("MAKE").isNotNull()), ["MAKE", "TYPE_VEHICLE"]).select(
        "MAKE",
        "TYPE_VEHICLE",
        F.col("n").alias("total_policies"),
        _rounded("PREMIUM", 2).alias("avg_premium"),
        _rounded("CLAIM_PAID", 2).alias("avg_claim_paid"),
        _rate("had_claim", 1).alias("claim_rate_pct"),
    )
    return top(known, "total_policies", ["MAKE", "TYPE_VEHICLE"], n)


def driver_profile(parts: DataFrame) -> DataFrame:
    return merge(parts, ["AGE", "DRIVING_EXPERIENCE"]).select(
        "AGE",
        "DRIVING_EXPERIENCE",
        F.col("n").alias("total_drivers"),
        _rate("OUTCOME", 1).alias("claim_rate_pct"),
        _rounded("ANNUAL_MILEAGE", 0).alias("avg_mileage"),
        _rounded("CREDIT_SCORE", 3).alias("avg_credit_score"),
        _rounded("PAST_ACCIDENTS", 2).alias("avg_accidents"),
    )


def tier_profile(parts: DataFrame) -> DataFrame:
    return merge(parts, ["risk_tier"]).select(
        "risk_tier",
        risk.tier_name(F.col("risk_tier")).alias("risk_level"),
        F.col("n").alias("total_drivers"),
        _rate("OUTCOME", 1).alias("claim_rate_pct"),
        _rounded("risk_score", 2).alias("avg_risk_score"),
    )


def motor_chunks(parts: DataFrame) -> DataFrame:
    return all_chunks({"motor": motor_profile(parts), "motor_make": make_profile(parts)})


def claims_chunks(parts: DataFrame) -> DataFrame:
    return all_chunks({"claims_age": driver_profile(parts), "claims_risk": tier_profile(parts)})
