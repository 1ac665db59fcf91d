"""Row keys, lineage cuts and loaded tables shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.session import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def free(df: DataFrame, *taken: str) -> list[str]:
    """Names like ``taken`` that the columns of ``df`` don't use yet."""
    have, out = {c.lower() for c in df.columns}, []
    for name in taken:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def largest_frame_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of the named text columns, with 16 for each row."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(16))
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n")).first().n
