"""The corpus pipeline: documents through four filters to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of ``documents``. A document whose text
changes gets a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm import leaks, line_dedup, near_dedup, quality, subwords
from perilake.llm.queries import VOCABULARY
from perilake.llm.shared import fresh_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs.select(COLUMNS), model)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those of which nothing is left go."""
    rows = line_dedup.remove_repeated_lines(docs.select(COLUMNS))
    changed = F.col("n_removed") > 0
    return rows.filter(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")) \
        .withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows without an id and rows that repeat a kept id and its text all stay.
    """
    groups = near_dedup.near_groups(docs, size=5, percent=80)
    gone = groups.filter(~F.coalesce("kept", F.lit(True))).select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return leaks.without_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    return subwords.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, ids_col="token_ids") \
        .withColumn("n_tokens", F.size("token_ids").cast("long")).drop("text")


STAGES = [
    ("quality", good_quality),
    ("lines", unrepeated_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("tokens", token_ids),
]

#: SQL can't state the classifier, the edit search and the encoder; tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    root = fresh_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
