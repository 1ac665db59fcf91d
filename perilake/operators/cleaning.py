"""Missing rows, duplicates and the typed silver tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from perilake.functions import parsing


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(subset) if subset else None)


def dedup(df: DataFrame) -> DataFrame:
    """One of each full row, NULL equal to NULL.

    Planned as a partial and a final hash aggregate over all columns, so copies
    of one row collapse inside each input task before anything is shuffled.
    """
    return df.dropDuplicates()


def silver_claims(bronze: DataFrame) -> DataFrame:
    # Dropping first and deduplicating after gives the same rows and shuffles fewer.
    return dedup(drop_missing(bronze))


def type_motor(raw: DataFrame) -> DataFrame:
    """Row-wise typing: numbers, dates, and no claim paid read as zero."""
    return raw.withColumns(
        {
            "CLAIM_PAID": F.coalesce(parsing.to_number(F.col("CLAIM_PAID")), F.lit(0.0)),
            "INSURED_VALUE": parsing.to_number(F.col("INSURED_VALUE")),
            "PREMIUM": parsing.to_number(F.col("PREMIUM")),
            "PROD_YEAR": parsing.to_number(F.col("PROD_YEAR")),
            "INSR_BEGIN": parsing.to_date_coerce(F.col("INSR_BEGIN")),
            "INSR_END": parsing.to_date_coerce(F.col("INSR_END")),
        }
    )


def usable_motor(raw: DataFrame) -> DataFrame:
    """Raw rows whose insured value and premium both parse."""
    usable = F.lit(True)
    for name in ("INSURED_VALUE", "PREMIUM"):
        usable = usable & parsing.to_number(F.col(name)).isNotNull()
    return raw.where(usable)


def silver_motor(bronze: DataFrame) -> DataFrame:
    """Duplicates are judged on the raw text, before typing."""
    return type_motor(dedup(usable_motor(bronze)))
