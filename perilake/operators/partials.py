"""Additive partial aggregates that can be kept per batch and merged on read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from perilake.functions.numeric import MONEY_SCALE, big_sum, far_sum, fixed_sum, joined_sum


def partials(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, int] | Sequence[str] = (),
    extremes: Sequence[str] = (),
) -> DataFrame:
    """Per key: ``n``, and per column ``cnt_``, ``sum_`` and ``min_``/``max_``.

    ``sums`` maps a column to the decimal places its sum keeps. Values beyond the
    range of such a sum are in ``big_`` and ``far_``; see ``total``.
    """
    scales = dict(sums) if isinstance(sums, Mapping) else {c: MONEY_SCALE for c in sums}
    figures = [F.count(F.lit(1)).alias("n")]
    for c, scale in scales.items():
        figures.append(F.count(c).alias(f"cnt_{c}"))
        figures.append(fixed_sum(F.col(c), scale).alias(f"sum_{c}"))
        figures += [big_sum(F.col(c), scale).alias(f"big_{c}"), far_sum(F.col(c)).alias(f"far_{c}")]
    for c in extremes:
        figures += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(*keys).agg(*figures)


def merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine partials, also to coarser keys than they were taken at."""
    figures = []
    for f in df.schema.fields:
        if f.name == "n" or f.name.startswith(("cnt_", "sum_", "big_", "far_")):
            # Every merge gives the same type, however often it is repeated.
            wide = T.DecimalType(38, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else f.dataType
            figures.append(F.sum(f.name).cast(wide).alias(f.name))
        elif f.name.startswith("min_"):
            figures.append(F.min(f.name).alias(f.name))
        elif f.name.startswith("max_"):
            figures.append(F.max(f.name).alias(f.name))
    return df.groupBy(*keys).agg(*figures)


def total(name: str) -> Column:
    return joined_sum(F.col(f"sum_{name}"), F.col(f"big_{name}"), F.col(f"far_{name}"))


def mean(name: str) -> Column:
    return F.try_divide(total(name), F.col(f"cnt_{name}").cast("double"))
