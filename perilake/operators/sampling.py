"""Deterministic train/test splits that never sort the rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from perilake.session import shared_root

# Classes up to this number are broadcast; rows are then read in place and no class meets in one task.
BROADCAST_CLASSES = 100_000
# Digits by which one pass narrows the cut-off: at most 16^3 counts per class.
STEP = 3
AFTER_ALL_DIGITS = "g"


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def hash_below(key: Column, share: float, seed: int) -> Column:
    """True for about ``share`` of all keys; the same key always gets the same side.

    The first eight hex digits of an md5 are compared as text, which orders
    them like the numbers they stand for.
    """
    if not 0.0 < share < 1.0:
        raise ValueError("share must lie between 0 and 1")
    return F.substring(_digest(key, seed), 1, 8) < F.lit(format(int(share * 2**32), "08x"))


def stratified_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``; every class is thinned by the same hash threshold."""
    return df.withColumn("is_test", hash_below(F.col(key), share, seed).cast("int"))


def train_and_test(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    held = hash_below(F.col(key), share, seed)
    return df.where(~held), df.where(held)


def _per_class(df: DataFrame) -> DataFrame:
    """A stored table of one row per class, ready to be joined to the rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df


def class_cutoffs(df: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """Per class (``_label``), a text ``_cutoff`` that exactly ``ceil(share * rows)`` digests lie below.

    Each pass counts the rows per digest prefix inside the prefix found so far, at
    most 16^3 counts per class. Rows with equal keys are never separated, which can
    put a class over its number by the copies of one key.
    """
    shared_root(df.sparkSession)
    rows = df.select(F.col(label).alias("_label"), _digest(F.col(key), seed).alias("_digest")).where("_digest IS NOT NULL")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("n"))
    need = F.ceil(F.lit(Decimal(str(share))) * F.col("n")).cast("long")
    state = sizes.select("_label", F.lit("").alias("_prefix"), need.alias("_need"), F.lit(False).alias("_found")).checkpoint()
    for length in [*range(STEP, 32, STEP), 32]:
        searched = _per_class(state.where(~F.col("_found")).select(F.col("_label").alias("_l"), "_prefix", "_need"))
        same = rows["_label"].eqNullSafe(F.col("_l")) & F.col("_digest").startswith(F.col("_prefix"))
        counts = rows.join(searched, same).groupBy("_label", "_need", F.substring("_digest", 1, length).alias("_prefix")) \
            .agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_label").orderBy("_prefix"))
        found = (F.col("upto") == F.col("_need")) | F.lit(length == 32)
        picked = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("_need")) & (F.col("upto") - F.col("n") < F.col("_need")))
        picked = picked.select(
            "_label", F.when(found, F.concat("_prefix", F.lit(AFTER_ALL_DIGITS))).otherwise(F.col("_prefix")).alias("_prefix"),
            (F.col("_need") - F.col("upto") + F.col("n")).alias("_need"), found.alias("_found"))
        state = state.where("_found").unionByName(picked).checkpoint()
        if state.where(~F.col("_found")).isEmpty():
            break
    return state.select("_label", F.col("_prefix").alias("_cutoff"))


def exact_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test`` so that each class gives the same share to the row.

    Cut-offs are joined, one row per class, however many classes there are.
    """
    cutoffs = _per_class(class_cutoffs(df, label, key, share, seed))
    below = F.coalesce(_digest(F.col(key), seed) < F.col("_cutoff"), F.lit(False))
    joined = df.join(cutoffs, F.col(label).eqNullSafe(F.col("_label")), "left")
    return joined.withColumn("is_test", below.cast("int")).drop("_label", "_cutoff")
