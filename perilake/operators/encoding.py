"""Ordinal codes of category columns, kept as a mapping table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from perilake.session import shared_root

# Distinct values per column up to which one task per column ranks them.
WINDOW_VALUES = 1_000_000


def fit_encoder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mapping (column_name, value, code): sorted distinct values are 0..k-1.

    All columns are gathered in one pass; only distinct pairs leave a task.
    """
    spark = df.sparkSession
    shared_root(spark)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    pairs = (
        text.unpivot([], list(cols), "column_name", "value")
        .where(F.col("value").isNotNull())
        .distinct()
        .checkpoint()
    )
    sizes = pairs.groupBy("column_name").count().agg(F.max("count")).first()[0] or 0
    if sizes <= WINDOW_VALUES:
        return rank_in_window(pairs)
    return rank_by_range(pairs)


def rank_in_window(pairs: DataFrame) -> DataFrame:
    order = Window.partitionBy("column_name").orderBy("value")
    return pairs.withColumn("code", (F.row_number().over(order) - 1).cast("int"))


def rank_by_range(pairs: DataFrame) -> DataFrame:
    """The same codes with no task holding a whole column.

    Pairs are range-partitioned in order and checkpointed, so that partition
    numbers are fixed; a code is the rank inside the partition plus the number
    of values of that column in earlier partitions.
    """
    placed = (
        pairs.repartitionByRange("column_name", "value")
        .checkpoint()
        .withColumn("part", F.spark_partition_id())
    )
    # One row per (partition, column): as many rows as shuffle partitions.
    sizes = placed.groupBy("column_name", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("column_name", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("column_name", "part").orderBy("value")
    ranked = placed.withColumn("place", F.row_number().over(inside) - 1)
    code = (F.col("before") + F.col("place")).cast("int")
    return ranked.join(offsets, ["column_name", "part"]).select("column_name", "value", code.alias("code"))


def apply_encoder(df: DataFrame, mapping: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by its code; a value not seen at fit time gets k.

    The joins carry no broadcast hint: Spark broadcasts a column's mapping when
    its size allows and otherwise shuffles, with skewed partitions split by AQE.
    """
    sizes = {r["column_name"]: r["count"] for r in mapping.groupBy("column_name").count().collect()}
    names = df.columns
    for c in cols:
        codes = mapping.where(F.col("column_name") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        unseen = F.when(F.col(c).isNotNull(), F.lit(sizes.get(c, 0)).cast("int"))
        df = (
            df.join(codes, F.col(c).cast("string") == F.col("_value"), "left")
            .withColumn(c, F.coalesce(F.col("_code"), unseen))
            .drop("_value", "_code")
        )
    return df.select(*names)
