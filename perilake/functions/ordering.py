"""Sort keys: missing values last in both directions, ties always broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def down(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def top(df: DataFrame, by: str, ties: Sequence[str], n: int) -> DataFrame:
    """The n rows with the largest value; planned as TakeOrderedAndProject."""
    return df.orderBy(down(by), *[up(t) for t in ties]).limit(n)
