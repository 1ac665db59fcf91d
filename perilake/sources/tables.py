"""Layered tables (bronze, silver, gold) as Parquet under one shared folder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T


LOG = T.StructType([T.StructField("committed", T.LongType()), T.StructField("folder", T.StringType())])


class Warehouse:
    """Tables under one root; each write goes to a folder of its own and takes effect by one line in a log.

    A reader keeps the folder it opened, also while the table is replaced; a write that
    fails leaves the table as it was. An instance goes on with the versions it has opened
    or written; ``refresh`` makes it look again. ``clean`` removes replaced versions.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.written: dict[str, int] = {}
        self.exports: list[str] = []
        self._opened: dict[tuple[str, str], str] = {}

    def path(self, layer: str, name: str) -> str:
        return f"{self.root}/{layer}/{name}"

    def fresh_path(self, layer: str, name: str) -> str:
        """A path of its own per call, so that no plan replaces files another one reads."""
        path = f"{self.path(layer, name)}-{uuid.uuid4().hex}"
        self.exports.append(path)
        return path

    def new_version(self, layer: str, name: str) -> str:
        """A folder for the next version; nobody reads it before ``commit``."""
        return f"{self.path(layer, name)}/v-{uuid.uuid4().hex}"

    def _log(self, layer: str, name: str) -> str:
        return f"{self.root}/_commits/{layer}/{name}"

    def _commits(self, layer: str, name: str) -> list[str]:
        """Folders of all versions, the newest first."""
        try:
            log = self.spark.read.schema(LOG).json(self._log(layer, name))
        except AnalysisException:  # no version was ever committed
            return []
        return [r["folder"] for r in log.orderBy(F.desc("committed"), F.desc("folder")).collect()]

    def commit(self, layer: str, name: str, path: str) -> None:
        """Make a whole version the current one; files of the log are added, never changed."""
        line = self.spark.createDataFrame([(time.time_ns(), path.rsplit("/", 1)[1])], LOG)
        line.coalesce(1).write.mode("append").json(self._log(layer, name))
        self._opened[layer, name] = path

    def current(self, layer: str, name: str) -> str | None:
        """Folder of the current version, or of the one this instance has opened."""
        if (layer, name) not in self._opened:
            commits = self._commits(layer, name)
            if not commits:
                return None
            self._opened[layer, name] = f"{self.path(layer, name)}/{commits[0]}"
        return self._opened[layer, name]

    def refresh(self) -> None:
        self._opened.clear()

    def read(self, layer: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.current(layer, name))

    def write(self, df: DataFrame, layer: str, name: str, partition_by: Sequence[str] = ()) -> None:
        """Replace a table; its row count is observed during the write itself."""
        seen = Observation(f"{layer}_{name}")
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        path = self.new_version(layer, name)
        writer.parquet(path)
        self.commit(layer, name, path)
        self.written[f"{layer}_{name}"] = seen.get["rows"]

    def append(self, df: DataFrame, layer: str, name: str) -> None:
        """Add an arrival batch; stored files are never read back or rewritten."""
        if self.current(layer, name) is None:
            self.write(df, layer, name)
        else:
            df.write.mode("append").parquet(self.current(layer, name))

    def clean(self, layer: str, name: str) -> int:
        """Remove all versions but the newest; returns how many. No reader may still be on them."""
        old = self._commits(layer, name)[1:]
        return sum(remove(self.spark, f"{self.path(layer, name)}/{folder}") for folder in old)

    def clean_exports(self) -> int:
        """Remove the folders that this instance handed out by ``fresh_path``."""
        gone = sum(remove(self.spark, path) for path in self.exports)
        self.exports.clear()
        return gone


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder through the file system it lies on; whether there was one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a small scan out over all cores; leave any larger scan as it is.

    A scan with no more splits than there are cores holds at most one split per
    core, so this shuffle is small; a large table never takes this branch.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def append_batch(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of both frames, matched by column name, repeats kept."""
    return target.unionByName(batch)


def audit_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table; Parquet answers it from file footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
