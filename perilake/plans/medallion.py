"""The layered load: raw files to bronze, silver and gold tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from perilake.functions.parsing import normalize_missing
from perilake.operators import cleaning, encoding, features, models
from perilake.session import shared_root
from perilake.sources import testbed
from perilake.sources.schemas import CATEGORIES
from perilake.sources.tables import Warehouse


class Lake:
    """Tables of one load, each written once and read from storage after that.

    A table or model that an earlier session completed under the same root is
    opened as it is; take another root to load anew.

    Downstream plans start at the stored table: they read only the columns they
    need, do not repeat the full-row deduplication, and do not depend on the
    executors that wrote it.
    """

    def __init__(self, spark: SparkSession, root: str, claims: Callable[[], DataFrame], motor: Callable[[], DataFrame]):
        self.spark = spark
        self.store = Warehouse(spark, root)
        self._raw = {"claims": claims, "motor": motor}
        self._lock = threading.RLock()

    def stored(self, layer: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            if self.store.current(layer, name) is None:
                self.store.write(build(), layer, name)
        return self.store.read(layer, name)

    def bronze(self, name: str) -> DataFrame:
        return self.stored("bronze", name, lambda: normalize_missing(self._raw[name]()))

    def silver(self, name: str) -> DataFrame:
        clean = {"claims": cleaning.silver_claims, "motor": cleaning.silver_motor}[name]
        return self.stored("silver", name, lambda: clean(self.bronze(name)))

    def encoder(self) -> DataFrame:
        return self.stored("gold", "claims_encoder", lambda: encoding.fit_encoder(self.silver("claims"), CATEGORIES))

    def gold(self, name: str) -> DataFrame:
        if name == "motor":
            return self.stored("gold", name, lambda: features.gold_motor(self.silver(name)))
        return self.stored("gold", name, lambda: features.gold_claims(self.silver(name), self.encoder()))

    def model(self, name: str, train: Callable[[], PipelineModel]) -> PipelineModel:
        """A model trained once per lake and loaded from its saved form."""
        with self._lock:
            if self.store.current("models", name) is None:
                path = self.store.new_version("models", name)
                models.save_model(train(), path)
                self.store.commit("models", name, path)
        return models.load_model(self.store.current("models", name))

    def load_all(self) -> None:
        for name in ("claims", "motor"):
            self.gold(name)


class TestbedLake(Lake):
    """A lake whose raw inputs are derived from a folder of test tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        super().__init__(
            spark,
            root,
            claims=lambda: testbed.claims_raw(spark, sf_dir),
            motor=lambda: testbed.motor_raw(spark, sf_dir),
        )
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return testbed.table(self.spark, self.sf_dir, name)


_OPEN: dict[tuple[str, str], TestbedLake] = {}
_OPEN_LOCK = threading.Lock()


def open_lake(spark: SparkSession, sf_dir: str) -> TestbedLake:
    """The lake of this application and input folder, in a fresh shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _OPEN_LOCK:
        if key not in _OPEN:
            root = f"{shared_root(spark)}/perilake/{key[0]}/{uuid.uuid4().hex}"
            _OPEN[key] = TestbedLake(spark, sf_dir, root)
        return _OPEN[key]
