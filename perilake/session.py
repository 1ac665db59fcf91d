"""Session settings and the shared folder every written table lives in."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "perilake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors can reach, for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local session gets a fresh temporary folder and any other session uses its
    warehouse folder, if that does not lie on one machine.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if sc.master.startswith("local"):
            base = getattr(sc, "_perilake_root", None) or tempfile.mkdtemp(prefix="perilake-")
            sc._perilake_root = base
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
            if base.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{base}/checkpoints")
    return base.rstrip("/")
