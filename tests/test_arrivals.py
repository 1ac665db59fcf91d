from types import SimpleNamespace

from perilake.plans import incremental
from perilake.sources.schemas import CLAIMS
from perilake.sources.tables import Warehouse
from perilake.streaming import refresh


def test_an_arrival_is_written_by_as_many_tasks_as_its_scan(spark, tmp_path):
    names = [f"CAST(id % 50 AS {f.dataType.simpleString()}) AS {f.name}" for f in CLAIMS.fields]
    spark.range(0, 120, 1, 6).selectExpr(*names).write.parquet(f"{tmp_path}/rows")
    store = Warehouse(spark, str(tmp_path / "lake"))
    bronze = spark.read.parquet(f"{tmp_path}/rows")
    job = incremental._streamed(SimpleNamespace(spark=spark, store=store, bronze=lambda name: bronze), refresh.CLAIMS_FEED)
    arrivals = spark.read.text(f"{store.exports[0]}/arrivals/*")
    assert len(arrivals.inputFiles()) == incremental.ARRIVALS * bronze.rdd.getNumPartitions() > incremental.ARRIVALS
    assert job.read("bronze").count() == 120
    assert sorted(job.read("silver").toArrow().column("ID").to_pylist()) == list(range(50))
    assert spark.read.parquet(job.path("bronze")).select("batch_id").distinct().count() == incremental.ARRIVALS
