"""CSV and JSON files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from perilake.functions.parsing import normalize_missing

CORRUPT = "_corrupt_record"


#: Written text comes back as it was: blanks kept, quotes doubled.
EXACT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False, line_breaks: bool = False
) -> DataFrame:
    """CSV with header under a declared schema; missing tokens become NULL.

    Number columns are declared, never inferred. A field that does not parse
    reads as NULL; with ``keep_corrupt`` the whole bad line is kept as text, and
    ``misfits`` counts such lines. With ``line_breaks``, quoted fields may hold
    line breaks; a file is then read by one task, so keep files moderate.
    """
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(schema)
        .options(**EXACT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", line_breaks)
    )
    names = [f.name for f in schema.fields if f.name != CORRUPT]
    return normalize_missing(reader.csv(path), cols=names)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with header; a file of ``gzip`` takes a fraction of the disk and is read by one task."""
    df.write.mode("overwrite").options(**EXACT).csv(path, compression=compression)


def misfits(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False) -> DataFrame:
    """One row: how many lines there are, and how many have a field that is not of its declared type."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = read_csv(spark, path, text, line_breaks=line_breaks)
    bad = [
        F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        for f in schema.fields
        if not isinstance(f.dataType, T.StringType)
    ]
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count_if(reduce(or_, bad, F.lit(False))).alias("misfits"))


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines, a handful of rows in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
