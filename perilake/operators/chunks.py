"""Grouped profiles turned into text chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from perilake.functions.text import render

# The sentence of each chunk source and the format of each figure.
TEMPLATES = {
    "motor": "Vehicle Type: {TYPE_VEHICLE}, Usage: {USAGE}. Total policies: {total_policies}. "
    "Average premium: ${avg_premium}. Premium range: ${min_premium} to ${max_premium}. "
    "Average insured value: ${avg_insured_value}. Average claim paid: ${avg_claim_paid}. "
    "Claim rate: {claim_rate_pct}%.",
    "motor_make": "Vehicle make: {MAKE}, type: {TYPE_VEHICLE}. Total policies: {total_policies}. "
    "Average premium: ${avg_premium}. Average claim paid: ${avg_claim_paid}. Claim rate: {claim_rate_pct}%.",
    "claims_age": "Driver age: {AGE}, experience: {DRIVING_EXPERIENCE}. Total drivers: {total_drivers}. "
    "Claim rate: {claim_rate_pct}%. Avg mileage: {avg_mileage}. Avg credit score: {avg_credit_score}. "
    "Avg past accidents: {avg_accidents}.",
    "claims_risk": "Risk tier: {risk_level}. Total drivers: {total_drivers}. Claim rate: {claim_rate_pct}%. "
    "Average risk score: {avg_risk_score}.",
}
FORMATS = {
    "total_policies": "%d", "total_drivers": "%d", "claim_rate_pct": "%.1f",
    "avg_premium": "%.2f", "min_premium": "%.2f", "max_premium": "%.2f",
    "avg_insured_value": "%.2f", "avg_claim_paid": "%.2f", "avg_mileage": "%.0f",
    "avg_credit_score": "%.3f", "avg_accidents": "%.2f", "avg_risk_score": "%.2f",
}
KEYS = {
    "motor": ("TYPE_VEHICLE", "USAGE"),
    "motor_make": ("MAKE", "TYPE_VEHICLE"),
    "claims_age": ("AGE", "DRIVING_EXPERIENCE"),
    "claims_risk": ("risk_tier",),
}


def escaped(key: str) -> Column:
    """A group key in an id: the sign between keys is escaped, and a missing key is no word."""
    text = F.replace(F.replace(F.col(key).cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.coalesce(text, F.lit("%"))


def chunk(profile: DataFrame, source: str) -> DataFrame:
    """Rows (chunk_id, source, text); the id is the source and its group keys, each group its own."""
    parts = [F.lit(source), *[escaped(key) for key in KEYS[source]]]
    return profile.select(
        F.concat_ws("/", *parts).alias("chunk_id"),
        F.lit(source).alias("source"),
        render(TEMPLATES[source], FORMATS).alias("text"),
    )


def all_chunks(profiles: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [chunk(df, source) for source, df in profiles.items()])
