"""Gold tables: derived columns on top of silver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from perilake.functions import numeric, risk
from perilake.operators import encoding
from perilake.sources.schemas import CATEGORIES


def select_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def add_driver_features(df: DataFrame) -> DataFrame:
    """Risk score and mileage flag, then the tier of the score."""
    score = risk.risk_score(F.col("PAST_ACCIDENTS"), F.col("SPEEDING_VIOLATIONS"), F.col("DUIS"))
    return df.withColumns(
        {
            "risk_score": score,
            "high_mileage_flag": risk.high_mileage(F.col("ANNUAL_MILEAGE")),
            "risk_tier": risk.risk_tier(score),
        }
    )


def gold_claims(silver: DataFrame, mapping: DataFrame) -> DataFrame:
    return add_driver_features(encoding.apply_encoder(silver, mapping, CATEGORIES))


def gold_motor(silver: DataFrame) -> DataFrame:
    return silver.withColumns(
        {
            "had_claim": risk.had_claim(F.col("CLAIM_PAID")),
            "premium_rate_pct": numeric.safe_ratio(F.col("PREMIUM"), F.col("INSURED_VALUE"), 100.0, 4),
            "policy_duration_days": risk.policy_days(F.col("INSR_BEGIN"), F.col("INSR_END")),
            "vehicle_age": risk.vehicle_age(F.col("PROD_YEAR")),
        }
    )
