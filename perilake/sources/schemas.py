"""Logical schemas of the two raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _LONG, _REAL, _INT = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CLAIMS = _schema(
    ID=_LONG, AGE=_TEXT, GENDER=_TEXT, RACE=_TEXT, DRIVING_EXPERIENCE=_TEXT,
    EDUCATION=_TEXT, INCOME=_TEXT, CREDIT_SCORE=_REAL, VEHICLE_OWNERSHIP=_REAL,
    VEHICLE_YEAR=_TEXT, MARRIED=_REAL, CHILDREN=_REAL, POSTAL_CODE=_INT,
    ANNUAL_MILEAGE=_REAL, VEHICLE_TYPE=_TEXT, SPEEDING_VIOLATIONS=_LONG,
    DUIS=_LONG, PAST_ACCIDENTS=_LONG, OUTCOME=_REAL,
)

MOTOR = _schema(
    TYPE_VEHICLE=_TEXT, MAKE=_TEXT, USAGE=_TEXT, INSURED_VALUE=_TEXT, PREMIUM=_TEXT,
    CLAIM_PAID=_TEXT, PROD_YEAR=_TEXT, INSR_BEGIN=_TEXT, INSR_END=_TEXT,
)

# The text columns of claims that become ordinal codes.
CATEGORIES = (
    "AGE", "GENDER", "RACE", "DRIVING_EXPERIENCE",
    "EDUCATION", "INCOME", "VEHICLE_YEAR", "VEHICLE_TYPE",
)

# Model features in their published order.
FEATURES = (
    "AGE", "GENDER", "DRIVING_EXPERIENCE", "EDUCATION", "INCOME", "CREDIT_SCORE",
    "VEHICLE_OWNERSHIP", "VEHICLE_YEAR", "MARRIED", "CHILDREN", "ANNUAL_MILEAGE",
    "VEHICLE_TYPE", "SPEEDING_VIOLATIONS", "DUIS", "PAST_ACCIDENTS",
    "risk_score", "high_mileage_flag",
)
TARGET = "OUTCOME"
