"""Exploration profiles of the raw and typed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilake.operators import profiling
from perilake.operators.cleaning import type_motor
from perilake.plans.catalog import plan
from perilake.plans.checksql import over_claims, over_motor
from perilake.sources.schemas import CLAIMS, MOTOR


@plan(
    "g15_value_counts",
    over_motor(
        """SELECT TYPE_VEHICLE, count(*) AS count FROM bronze_motor WHERE TYPE_VEHICLE IS NOT NULL
        GROUP BY TYPE_VEHICLE"""
    ),
)
def g15(lake):
    return profiling.value_counts(lake.bronze("motor"), "TYPE_VEHICLE")


@plan(
    "g15_outcome_counts",
    over_claims(
        "SELECT OUTCOME, count(*) AS count FROM bronze_claims WHERE OUTCOME IS NOT NULL GROUP BY OUTCOME"
    ),
)
def g15_outcome(lake):
    return profiling.value_counts(lake.bronze("claims"), "OUTCOME")


def _nulls(table: str, schema) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f.name}' AS column_name, count(*) - count({f.name}) AS missing FROM {table}" for f in schema.fields
    )


@plan("g16_null_counts_claims", over_claims(_nulls("bronze_claims", CLAIMS)))
def g16_claims(lake):
    return profiling.null_counts(lake.bronze("claims"))


@plan("g16_null_counts_motor", over_motor(_nulls("bronze_motor", MOTOR)))
def g16_motor(lake):
    return profiling.null_counts(lake.bronze("motor"))


def _shape(table: str, schema) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS column_type,
        (SELECT count(*) FROM {table}) AS row_count, {len(schema.fields)} AS column_count"""
        for i, f in enumerate(schema.fields)
    )


@plan("g17_shape_claims", over_claims(_shape("bronze_claims", CLAIMS)))
def g17_claims(lake):
    return profiling.shape(lake.bronze("claims"))


@plan("g17_shape_motor", over_motor(_shape("bronze_motor", MOTOR)))
def g17_motor(lake):
    return profiling.shape(lake.bronze("motor"))


@plan(
    "g18_claim_share",
    over_motor(
        """SELECT count(*) FILTER (TRY_CAST(CLAIM_PAID AS DOUBLE) > 0)::DOUBLE / count(*) * 100 AS claim_paid_pct
        FROM bronze_motor"""
    ),
)
def g18(lake):
    return profiling.percent_where(type_motor(lake.bronze("motor")), F.col("CLAIM_PAID") > 0, "claim_paid_pct")


@plan("g19_age_histogram", over_claims("SELECT AGE, count(*) AS count FROM bronze_claims GROUP BY AGE"))
def g19(lake):
    return profiling.category_histogram(lake.bronze("claims"), "AGE")


@plan(
    "g19_age_outcome_histogram",
    over_claims("SELECT AGE, OUTCOME, count(*) AS count FROM bronze_claims GROUP BY AGE, OUTCOME"),
)
def g19_series(lake):
    return profiling.category_histogram(lake.bronze("claims"), "AGE", "OUTCOME")


@plan(
    "g20_claim_histogram",
    over_motor(
        """SELECT bin, low + bin * width AS bin_start, count(*) AS count FROM binned GROUP BY ALL""",
        """paid AS (SELECT TRY_CAST(CLAIM_PAID AS DOUBLE) AS v FROM bronze_motor
          WHERE TRY_CAST(CLAIM_PAID AS DOUBLE) > 0)""",
        "edge AS (SELECT min(v) AS low, (max(v) - min(v)) / 20.0::DOUBLE AS width FROM paid)",
        """binned AS (SELECT low, width,
          CAST(least(coalesce(floor((v - low) / nullif(width, 0)), 0), 19) AS INTEGER) AS bin FROM paid, edge)""",
    ),
)
def g20(lake):
    typed = type_motor(lake.bronze("motor"))
    return profiling.numeric_histogram(typed.where(F.col("CLAIM_PAID") > 0), "CLAIM_PAID")


@plan(
    "g21_class_balance",
    over_claims(
        """SELECT CAST(OUTCOME AS INTEGER) AS label, count(*) AS class_rows,
        (SELECT count(*) FROM gold_claims)::DOUBLE
          / ((SELECT count(DISTINCT OUTCOME) FROM gold_claims)::DOUBLE * count(*)) AS balanced_weight,
        ((SELECT count(*) FROM gold_claims) - count(*))::DOUBLE / count(*) AS other_to_own
        FROM gold_claims GROUP BY OUTCOME"""
    ),
)
def g21(lake):
    return profiling.class_balance(lake.gold("claims"), "OUTCOME")


@plan(
    "g21_class_weights",
    over_claims(
        """SELECT ID, CAST(CASE WHEN OUTCOME = 1
          THEN (SELECT count(*) FROM gold_claims)::DOUBLE / (2 * (SELECT count(*) FROM gold_claims WHERE OUTCOME = 1))
          ELSE (SELECT count(*) FROM gold_claims)::DOUBLE / (2 * (SELECT count(*) FROM gold_claims WHERE OUTCOME = 0))
          END AS DOUBLE) AS weight FROM gold_claims"""
    ),
)
def g21_weights(lake):
    return profiling.add_class_weight(lake.gold("claims"), "OUTCOME").select("ID", "weight")
