"""A file stream that carries arrivals through bronze, silver, gold and chunks.

Every micro-batch writes its own ``batch_id=`` folder in each table and reads
only folders of earlier batches, so a batch that is run again after a failure
replaces its own output and nothing else. Batches are numbered from 0 without gaps.

What a batch reads does not grow with the number of batches. Rows seen so far lie in
hash buckets, in a folder for each batch and in merged folders of 16, 256, ... batches,
so that a batch opens its own buckets of at most 15 folders of each size. Sums and
codes are kept whole in each batch's folder, made from those of the batch before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from perilake.functions.parsing import normalize_missing
from perilake.operators import cleaning, encoding, features
from perilake.operators.partials import merge
from perilake.sources.files import EXACT
from perilake.sources.schemas import CATEGORIES, CLAIMS, MOTOR
from perilake.streaming import summaries

BATCH = "batch_id"
KEY = "row_key"
BUCKET = "bucket"
# Below the number of folders from which Spark lists them by a job.
BUCKETS = 32
# So many folders of seen rows become one.
FAN_IN = 16
# Repeated keys up to this number are looked up by value in the stored rows, and up to the second one by a broadcast.
LOOKUP_KEYS = 1_000
BROADCAST_KEYS = 1_000_000
# Rows, about, that a task holds while rows are compared, however many partitions the session asks for.
ROWS_AT_ONCE = 500_000
# Tasks of the comparison read, and take from a shuffle, about so much; a compressed row has 25 to 60 bytes.
SIZED = {
    "spark.sql.files.maxPartitionBytes": "16m", "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
# Of the tables that the stream keeps.
COMPRESSION = "zstd"

CODES = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("code", T.IntegerType())])


@dataclass(frozen=True)
class Feed:
    """What differs between the two inputs."""

    name: str
    schema: T.StructType
    usable: Callable[[DataFrame], DataFrame]
    typed: Callable[[DataFrame], DataFrame]
    encoded: bool
    featured: Callable[[DataFrame], DataFrame]
    partials: Callable[[DataFrame], DataFrame]
    keys: Sequence[str]
    chunks: Callable[[DataFrame], DataFrame]


CLAIMS_FEED = Feed(
    "claims", CLAIMS, cleaning.drop_missing, lambda raw: raw, True,
    features.add_driver_features, summaries.claims_partials, summaries.CLAIMS_KEYS, summaries.claims_chunks,
)
MOTOR_FEED = Feed(
    "motor", MOTOR, cleaning.usable_motor, cleaning.type_motor, False,
    features.gold_motor, summaries.motor_partials, summaries.MOTOR_KEYS, summaries.motor_chunks,
)


class Refresh:
    """Incrementally kept tables of one feed under ``root``."""

    def __init__(self, spark: SparkSession, feed: Feed, root: str):
        self.spark = spark
        self.feed = feed
        self.root = f"{root.rstrip('/')}/{feed.name}"
        self._sized: SparkSession | None = None

    def sized(self, rows: int) -> SparkSession:
        """A session with the settings of the stream's own, but tasks by the number of rows; one per stream."""
        if self._sized is None:
            self._sized = self.spark.newSession()
            for key, value in self.spark.conf.getAll.items():
                if self.spark.conf.isModifiable(key):
                    self._sized.conf.set(key, value)
            for key, value in SIZED.items():
                self._sized.conf.set(key, value)
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._sized.conf.set("spark.sql.shuffle.partitions", max(least, ceil(rows / ROWS_AT_ONCE)))
        return self._sized

    def path(self, table: str, batch_id: int | None = None) -> str:
        folder = f"{self.root}/{table}"
        return folder if batch_id is None else f"{folder}/{BATCH}={batch_id}"

    def read(self, table: str) -> DataFrame:
        """All batches of a table."""
        return self.spark.read.parquet(self.path(table)).drop(BATCH)

    def start(
        self,
        arrivals: str,
        files_per_batch: int | None = None,
        every: str | None = "5 minutes",
        line_breaks: bool = False,
    ) -> StreamingQuery:
        """Run on arriving CSV files; ``every=None`` takes what is there and stops.

        With ``line_breaks``, quoted fields may hold line breaks, and a file is read by
        one task.
        """
        reader = self.spark.readStream.schema(self.feed.schema).options(**EXACT).option("multiLine", line_breaks)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        writer = (
            reader.csv(arrivals)
            .writeStream.foreachBatch(self.take_in)
            .option("checkpointLocation", f"{self.root}/_progress")
        )
        writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
        return writer.start()

    def _save(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        """Write one batch folder and go on from the stored rows."""
        path = self.path(table, batch_id)
        df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
        return self.spark.read.schema(df.schema).parquet(path)

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(KEY, F.xxhash64(*self.feed.schema.names))

    def take_in(self, batch: DataFrame, batch_id: int) -> None:
        raw = self._save(normalize_missing(batch), "bronze", batch_id)
        # The number comes from the files' footers.
        raw = self.sized(raw.count()).read.schema(raw.schema).parquet(self.path("bronze", batch_id))
        fresh = self.new_rows(raw, batch_id).drop(KEY)
        silver = self._save(self.feed.typed(fresh), "silver", batch_id)
        # Gold and partials both start from stored silver, so they run side by side.
        with ThreadPoolExecutor(2) as pool:
            gold = pool.submit(lambda: self._save(self._gold(silver, batch_id), "gold", batch_id))
            summed = self.feed.partials(self.feed.featured(silver))
            parts = pool.submit(lambda: self._save(summed, "partials", batch_id))
            gold.result()
            state = self._merged(parts.result(), batch_id)
        self._save(self.feed.chunks(state), "chunks", batch_id)

    def _before(self, table: str, batch_id: int, schema: T.StructType) -> DataFrame:
        """A table's state after the batch before; no rows before the first one."""
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table, batch_id - 1))

    def _merged(self, parts: DataFrame, batch_id: int) -> DataFrame:
        """Sums over all batches so far: those of the batch before and this batch's, by key."""
        kinds = merge(parts, self.feed.keys).schema
        earlier = self._before("state", batch_id, kinds)
        return self._save(merge(earlier.unionByName(parts), self.feed.keys), "state", batch_id)

    def _gold(self, silver: DataFrame, batch_id: int) -> DataFrame:
        if not self.feed.encoded:
            return self.feed.featured(silver)
        return features.gold_claims(silver, self._codes(silver, batch_id))

    def _codes(self, silver: DataFrame, batch_id: int) -> DataFrame:
        """Codes of all categories so far: those of earlier batches never change, new values follow them."""
        earlier = self._before("encoder", batch_id, CODES)
        sizes = earlier.groupBy("column_name").agg(F.count(F.lit(1)).alias("known"))
        new = encoding.fit_encoder(silver, CATEGORIES).select("column_name", "value") \
            .join(earlier, ["column_name", "value"], "left_anti")
        ranked = encoding.rank_in_window(new).join(sizes, "column_name", "left")
        code = (F.col("code") + F.coalesce("known", F.lit(0))).cast("int")
        return self._save(earlier.unionByName(ranked.select("column_name", "value", code.alias("code"))), "encoder", batch_id)

    def latest(self, table: str) -> DataFrame:
        """A table's rows in its newest batch folder: the state, codes or chunks of all batches so far."""
        stored = self.spark.read.parquet(self.path(table))
        newest = stored.agg(F.max(BATCH)).scalar()
        return stored.where(F.col(BATCH) == newest).drop(BATCH)

    def latest_chunks(self) -> DataFrame:
        return self.latest("chunks")

    def segments(self, batch_id: int) -> list[str]:
        """Folders that hold the rows seen before a batch, the largest ones first."""
        out, at, size = [], 0, 1
        while size * FAN_IN <= batch_id:
            size *= FAN_IN
        while size:
            while at + size <= batch_id:
                out.append(self._segment(size, at))
                at += size
            size //= FAN_IN
        return out

    def _segment(self, size: int, first: int) -> str:
        return f"{self.root}/seen/batches={size}/first={first}"

    def _merge_segments(self, batch_id: int) -> None:
        """Make one folder of each sixteen that are whole now; a replay makes the same again."""
        size = FAN_IN
        while batch_id and batch_id % size == 0:
            small, first = size // FAN_IN, batch_id - size
            folders = [self._segment(small, at) for at in range(first, batch_id, small)]
            rows = self._seen(folders, self.sized(self._seen(folders).count()))
            # Ranges keep a bucket's rows in few files and still split a bucket that is too large for one task.
            self._write_seen(cleaning.dedup(rows).repartitionByRange(BUCKET, KEY), self._segment(size, first))
            size *= FAN_IN

    def _seen(self, folders: list[str], spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        kinds = T.StructType([*self.feed.schema.fields, T.StructField(KEY, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        if not folders:
            return spark.createDataFrame([], kinds)
        return reduce(DataFrame.unionByName, [spark.read.schema(kinds).parquet(f) for f in folders])

    def _write_seen(self, rows: DataFrame, path: str) -> None:
        rows.sortWithinPartitions(BUCKET, KEY).write.mode("overwrite").partitionBy(BUCKET).parquet(path, compression=COMPRESSION)

    def new_rows(self, raw: DataFrame, batch_id: int) -> DataFrame:
        """Distinct usable rows of the batch that no earlier batch held.

        A stored folder holds a row once, so no key is hot on that side. A batch is written
        as its deduplication leaves it, so its rows are shuffled once; folders are put in order
        when they are merged. The first look reads the key column of the batch's own buckets
        only. A repeated key is then confirmed on the full row: by value when few keys repeat,
        by a broadcast of the keys when more do, so that other rows are not shuffled.
        """
        self._merge_segments(batch_id)
        spark = raw.sparkSession
        bucket = F.pmod(F.col(KEY), F.lit(BUCKETS)).cast("int")
        self._write_seen(self._keyed(cleaning.dedup(self.feed.usable(raw))).withColumn(BUCKET, bucket), self._segment(1, batch_id))
        stored = self._seen([self._segment(1, batch_id)], spark)
        mine = stored.drop(BUCKET)
        touched = [r[0] for r in stored.select(BUCKET).distinct().collect()]  # BUCKETS numbers at most
        folders = self.segments(batch_id)
        if not folders:
            return mine
        seen = self._seen(folders, spark).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        path = f"{self.root}/repeated/{BATCH}={batch_id}"
        seen.select(KEY).join(mine.select(KEY), KEY, "left_semi").distinct().write.mode("overwrite").parquet(path, compression=COMPRESSION)
        repeated = spark.read.schema(f"{KEY} long").parquet(path)
        n = repeated.count()
        if not n:
            return mine
        if n > BROADCAST_KEYS:
            return self._unknown(mine, seen)
        if n <= LOOKUP_KEYS:
            here = F.col(KEY).isin([r[0] for r in repeated.collect()])
            return mine.where(~here).unionByName(self._unknown(mine.where(here), seen.where(here)))
        keys = F.broadcast(repeated)
        met = self._unknown(mine.join(keys, KEY, "left_semi"), seen.join(keys, KEY, "left_semi"))
        return mine.join(keys, KEY, "left_anti").unionByName(met)

    def _unknown(self, mine: DataFrame, seen: DataFrame) -> DataFrame:
        """The rows of ``mine`` that are not among ``seen``."""
        return mine.alias("m").join(seen.alias("s"), self._same_row("m", "s"), "left_anti")

    def _same_row(self, left: str, right: str) -> Column:
        equal = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in self.feed.schema.names]
        return reduce(lambda a, b: a & b, equal, F.col(f"{left}.{KEY}") == F.col(f"{right}.{KEY}"))
