"""Lenient parsing of raw text: bad input becomes NULL instead of an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The tokens a CSV reader with default settings takes as missing.
# Lowercase "none" is not among them; it is a real education level.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# try_cast alone would also take Java literals such as "1d" or "1f".
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i:[+-]?inf(inity)?)$"

SHORT_DATE = r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"
# Month names of the short date format.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Two-digit years from 69 on belong to the 1900s; Spark itself reads all as 20yy.
CENTURY_PIVOT = "69"


def normalize_missing(
    df: DataFrame,
    tokens: Iterable[str] = MISSING_TOKENS,
    cols: Iterable[str] | None = None,
) -> DataFrame:
    """Turn missing tokens in text columns and NaN in float columns into NULL."""
    tokens = list(tokens)
    wanted = set(df.columns if cols is None else cols)
    changed = {}
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.name not in wanted:
            continue
        if isinstance(field.dataType, T.StringType):
            changed[field.name] = F.when(~col.isin(tokens), col)
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            changed[field.name] = F.when(~F.isnan(col), col)
    return df.withColumns(changed) if changed else df


def to_number(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_date_coerce(col: Column) -> Column:
    """Parse ``08-AUG-13`` style dates.

    The parts are put together as an ISO date and cast, which is several times
    cheaper than a date pattern and rejects bad text without an exception.
    """
    numbers = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, f"{i:02d}")])
    day, name, year = F.substring_index(col, "-", 1), F.substring(col, -6, 3), F.right(col, F.lit(2))
    month = F.try_element_at(numbers, F.upper(name))
    century = F.when(year >= CENTURY_PIVOT, "19").otherwise("20")
    iso = F.concat(century, year, F.lit("-"), month, F.lit("-"), day)
    return F.when(col.rlike(SHORT_DATE), iso.try_cast("date"))
