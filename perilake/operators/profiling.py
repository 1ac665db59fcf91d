"""Data profiles: null counts, value counts, histograms, class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perilake.functions.ordering import down, up


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Frequency of each present value, most frequent first."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(down("count"), up(name))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: column_name, missing. One pass, one aggregate row."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "missing")


def shape(df: DataFrame) -> DataFrame:
    """One row per column with its position, type and the table's size."""
    described = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.inline(described), "row_count", F.lit(len(df.columns)).alias("column_count"))


def percent_where(df: DataFrame, predicate: Column, name: str) -> DataFrame:
    """Share of all rows satisfying the predicate; a missing value does not."""
    hits = F.count_if(predicate).cast("double")
    total = F.count(F.lit(1)).cast("double")
    return df.agg((F.try_divide(hits, total) * F.lit(100.0)).alias(name))


def category_histogram(df: DataFrame, name: str, series: str | None = None) -> DataFrame:
    keys = [name] if series is None else [name, series]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def numeric_histogram(df: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """Counts over equal-width bins of [min, max]; the last bin is closed."""
    values = df.where(F.col(name).isNotNull()).select(name)
    low = values.agg(F.min(name)).scalar()
    width = values.agg((F.max(name) - F.min(name)) / F.lit(float(bins))).scalar()
    place = F.coalesce(F.floor(F.try_divide(F.col(name) - low, width)), F.lit(0))
    binned = values.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    return (
        binned.groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("bin", (low + F.col("bin") * width).alias("bin_start"), "count")
        .orderBy("bin")
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row per class: rows, balanced weight n/(k*n_c), other/own ratio."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))
    totals = counts.agg(
        F.struct(F.sum("class_rows").alias("n"), F.count(F.lit(1)).alias("k"))
    ).scalar()
    n, k, own = (c.cast("double") for c in (totals["n"], totals["k"], F.col("class_rows")))
    return counts.select(
        F.col(label).cast("int").alias("label"),
        "class_rows",
        F.try_divide(n, k * own).alias("balanced_weight"),
        F.try_divide(n - own, own).alias("other_to_own"),
    )


def add_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class; two classes, 0 and 1.

    The totals come from one aggregate row, used as a scalar.
    """
    one = F.count_if(F.col(label) == 1).cast("double")
    zero = F.count_if(F.col(label) == 0).cast("double")
    weights = df.agg(
        F.struct(
            F.try_divide(one + zero, F.lit(2.0) * zero).alias("w0"),
            F.try_divide(one + zero, F.lit(2.0) * one).alias("w1"),
        )
    ).scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, weights["w1"]).otherwise(weights["w0"]))
