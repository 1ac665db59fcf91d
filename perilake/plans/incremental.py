"""Incremental plans, checked against a full rebuild in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perilake.plans.catalog import plan
from perilake.plans.checksql import over_both, over_claims, over_motor
from perilake.plans.knowledge import _CHUNKS
from perilake.plans.reports import MOTOR_PROFILE_SQL
from perilake.sources import files
from perilake.sources.schemas import CATEGORIES, CLAIMS
from perilake.streaming import refresh, summaries

ARRIVALS = 3


def _streamed(lake, feed: refresh.Feed) -> refresh.Refresh:
    """Export the bronze rows as arrivals, dealt out row by row, and stream them in."""
    place = F.monotonically_increasing_id() % ARRIVALS
    return _arrived(lake, feed, feed.name, lake.bronze(feed.name).withColumn("_arrival", place))


def _arrived(lake, feed: refresh.Feed, name: str, rows: DataFrame) -> refresh.Refresh:
    """Stream rows in by their number ``_arrival``, one batch each; an arrival has as many files as its scan has tasks."""
    root = lake.store.fresh_path("stream", name)
    job = refresh.Refresh(lake.spark, feed, root)
    for i in range(ARRIVALS):
        files.write_csv(rows.where(F.col("_arrival") == i).drop("_arrival"), f"{root}/arrivals/{i}", "gzip")
        job.start(f"{root}/arrivals/*", every=None).awaitTermination()
    return job


@plan("s01_stream_claims", over_claims("SELECT * FROM silver_claims"))
def s01(lake):
    return _streamed(lake, refresh.CLAIMS_FEED).read("silver")


_FIRST = ", ".join(f"min(ID % {ARRIVALS}) OVER (PARTITION BY {c}) AS first_{c}" for c in CATEGORIES)
_GROWN = "arrived AS (SELECT *, " + _FIRST + " FROM silver_claims), grown AS (SELECT " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY first_{f.name}, {f.name}) - 1 AS INTEGER) AS {f.name}" if f.name in CATEGORIES else f.name
    for f in CLAIMS.fields) + " FROM arrived)"


@plan(
    "s01_stream_gold_claims",
    over_claims(
        """SELECT *, risk_score_ AS risk_score, CAST(ANNUAL_MILEAGE > 15000 AS INTEGER) AS high_mileage_flag,
        CAST(CASE WHEN risk_score_ > -1 AND risk_score_ <= 2 THEN 0 WHEN risk_score_ <= 5 THEN 1 WHEN risk_score_ <= 100 THEN 2 END
        AS INTEGER) AS risk_tier FROM (SELECT *, CAST(2 * PAST_ACCIDENTS + SPEEDING_VIOLATIONS + 3 * DUIS AS BIGINT) AS risk_score_
        FROM grown)""".replace("SELECT *, risk_score_ AS", "SELECT * EXCLUDE (risk_score_), risk_score_ AS"),
        _GROWN,
    ),
)
def s01_gold(lake):
    """Codes follow the order of arrival: the arrival of an ID is its remainder."""
    rows = lake.bronze("claims").withColumn("_arrival", F.col("ID") % ARRIVALS)
    return _arrived(lake, refresh.CLAIMS_FEED, "gold_claims", rows).read("gold")


@plan("s02_stream_motor", over_motor("SELECT * FROM gold_motor"))
def s02(lake):
    return _streamed(lake, refresh.MOTOR_FEED).read("gold")


@plan(
    "s01_stream_chunks",
    over_both("SELECT chunk_id, source, text FROM chunks WHERE source LIKE 'claims%'", _CHUNKS),
)
def s01_chunks(lake):
    return _streamed(lake, refresh.CLAIMS_FEED).latest_chunks()


def _sliced(lake):
    """Partials of sixteen slices of the table, as if they came in batches."""
    gold = lake.gold("motor")
    return summaries.motor_partials(gold.withColumn("slice", F.pmod(F.xxhash64(*gold.columns), F.lit(16))), "slice")


@plan("s03_merged_profile", over_motor(MOTOR_PROFILE_SQL))
def s03(lake):
    return summaries.motor_profile(_sliced(lake))


@plan(
    "s03_merged_kpis",
    over_motor(
        """SELECT count(*) AS total_policies, CAST(sum(had_claim) AS BIGINT) AS total_claims,
        round(CAST(sum(CAST(PREMIUM AS DECIMAL(18,4))) AS DOUBLE) / count(*), 2) AS avg_premium,
        round(CAST(sum(CAST(CLAIM_PAID AS DECIMAL(18,4))) AS DOUBLE) / sum(had_claim), 2) AS avg_claim_paid,
        round(sum(had_claim)::DOUBLE / count(*) * 100, 2) AS claim_rate_pct FROM gold_motor"""
    ),
)
def s03_kpis(lake):
    return summaries.motor_kpis(_sliced(lake))
