"""Risk features of drivers and policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Weights, edges and amounts that define the features.
ACCIDENT_WEIGHT, SPEEDING_WEIGHT, DUI_WEIGHT = 2, 1, 3
HIGH_MILEAGE = 15000
TIER_EDGES = (-1, 2, 5, 100)
TIER_NAMES = ("Low", "Medium", "High")
TIER_BY_CODE = {0: "Low", 1: "Medium", 2: "High"}
AS_OF_YEAR, DEFAULT_YEAR = 2024, 2010
PREMIUM_BASE, PREMIUM_PER_RISK, PREMIUM_PER_ACCIDENT = 400, 100, 150
CLAIM_THRESHOLD = 0.5


def flag(predicate: Column) -> Column:
    """0/1 flag; a comparison with a missing value counts as false."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def had_claim(paid: Column) -> Column:
    return flag(paid > 0)


def high_mileage(mileage: Column) -> Column:
    return flag(mileage > HIGH_MILEAGE)


def risk_score(accidents: Column, speeding: Column, duis: Column) -> Column:
    return accidents * ACCIDENT_WEIGHT + speeding * SPEEDING_WEIGHT + duis * DUI_WEIGHT


def bucketize(col: Column, edges: Sequence, labels: Sequence, right: bool = True) -> Column:
    """Label of the interval the value falls in, NULL outside all of them."""
    cases = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (col > low) & (col <= high) if right else (col >= low) & (col < high)
        cases = F.when(inside, label) if cases is None else cases.when(inside, label)
    return cases


def risk_tier(score: Column) -> Column:
    return bucketize(score, TIER_EDGES, range(len(TIER_NAMES)))


def risk_tier_label(score: Column) -> Column:
    """Tier name by lower thresholds, so a score above every edge is High."""
    return F.when(score >= 6, "High").when(score >= 3, "Medium").otherwise("Low")


def tier_name(tier: Column) -> Column:
    """Name of a stored tier code; anything that is not 0 or 1 reads as High."""
    return F.when(tier == 0, "Low").when(tier == 1, "Medium").otherwise("High")


def map_values(col: Column, names: Mapping) -> Column:
    """Look a code up in a fixed map; NULL when the code is absent."""
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], names.items(), [])
    return F.try_element_at(F.create_map(*pairs), col)


def policy_days(begin: Column, end: Column) -> Column:
    return F.datediff(end, begin)


def vehicle_age(year: Column, as_of: int = AS_OF_YEAR, default: int = DEFAULT_YEAR) -> Column:
    return F.lit(float(as_of)) - F.coalesce(year, F.lit(float(default)))


def suggested_premium(score: Column, accidents: Column) -> Column:
    return F.lit(PREMIUM_BASE) + score * PREMIUM_PER_RISK + accidents * PREMIUM_PER_ACCIDENT


def threshold(probability: Column, at: float = CLAIM_THRESHOLD) -> Column:
    return (probability >= F.lit(at)).cast("int")


def direction(impact: Column) -> Column:
    return F.when(impact > 0, "increases").otherwise("reduces")
