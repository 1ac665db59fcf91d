import pytest
from conftest import values
from pyspark.sql import functions as F

from perilake.operators import cleaning, features
from perilake.plans import incremental
from perilake.sources import files
from perilake.sources.schemas import CATEGORIES
from perilake.streaming import refresh, summaries


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def motor(spark, lake, tmp_path_factory):
    """Three arriving files; the last repeats rows of the earlier ones."""
    root = str(tmp_path_factory.mktemp("motor"))
    raw = lake.bronze("motor")
    first, second = raw.where("TYPE_VEHICLE < 'M'"), raw.where("TYPE_VEHICLE >= 'M'")
    repeats = raw.where("USAGE = '1-URGENT'").unionByName(raw.where("USAGE = '1-URGENT'"))
    job = refresh.Refresh(spark, refresh.MOTOR_FEED, root)
    for i, part in enumerate((first, second, repeats)):
        files.write_csv(part.coalesce(1), f"{root}/arrivals/in{i}")
        job.start(f"{root}/arrivals/*", every=None).awaitTermination()
    return job, raw


def test_incremental_equals_rebuild(motor):
    job, raw = motor
    silver = cleaning.silver_motor(raw)
    assert same(job.read("silver"), silver)
    assert same(job.read("gold"), features.gold_motor(silver))
    assert job.read("bronze").count() > raw.count()


def test_kpis_from_partials_equal_full_aggregates(motor, lake):
    job, _ = motor
    parts = job.read("partials")
    assert same(summaries.motor_profile(parts), summaries.motor_profile(summaries.motor_partials(lake.gold("motor"))))
    whole = summaries.motor_kpis(summaries.motor_partials(lake.gold("motor")))
    assert values(summaries.motor_kpis(parts)) == values(whole)
    assert set(values(job.latest_chunks().select("source").distinct())) == {("motor",), ("motor_make",)}


def test_a_replayed_batch_changes_nothing(motor):
    job, raw = motor
    before = {t: sorted(values(job.read(t)), key=str) for t in ("silver", "gold", "partials", "state", "chunks")}
    job.take_in(job.spark.read.parquet(job.path("bronze", 1)).checkpoint(), 1)
    assert {t: sorted(values(job.read(t)), key=str) for t in before} == before


def test_many_repeats_take_the_full_comparison(motor, monkeypatch):
    job, _ = motor
    monkeypatch.setattr(refresh, "LOOKUP_KEYS", 3)
    again = job.spark.read.parquet(job.path("bronze", 0))
    assert job.new_rows(again, 3).count() == 0


def test_claims_stream_keeps_first_codes(spark, lake, tmp_path):
    root, raw = str(tmp_path), lake.bronze("claims")
    files.write_csv(raw.where("VEHICLE_TYPE = 'sedan'").coalesce(1), f"{root}/arrivals/a")
    job = refresh.Refresh(spark, refresh.CLAIMS_FEED, root)
    job.start(f"{root}/arrivals/*", every=None).awaitTermination()
    files.write_csv(raw.coalesce(1), f"{root}/arrivals/b")
    job.start(f"{root}/arrivals/*", every=None).awaitTermination()
    assert same(job.read("silver"), cleaning.silver_claims(raw))
    codes = dict(values(job.read("gold").groupBy("VEHICLE_TYPE").count()))
    silver = dict(values(job.read("silver").groupBy("VEHICLE_TYPE").count()))
    assert codes == {0: silver["sedan"], 1: silver["sports car"]}


def test_empty_batch(spark, tmp_path):
    job = refresh.Refresh(spark, refresh.MOTOR_FEED, str(tmp_path))
    job.take_in(spark.createDataFrame([], refresh.MOTOR_FEED.schema), 0)
    assert values(summaries.motor_kpis(job.read("partials"))) == [(0, 0, None, None, None)]


def test_an_empty_first_batch_leaves_all_codes(spark, lake, tmp_path):
    job, raw = refresh.Refresh(spark, refresh.CLAIMS_FEED, str(tmp_path)), lake.bronze("claims")
    job.take_in(raw.limit(0), 0)
    job.take_in(raw.where("VEHICLE_TYPE = 'sedan'"), 1)
    job.take_in(raw, 2)
    silver, gold = job.read("silver"), job.read("gold")
    for name in CATEGORIES:
        pairs = silver.select("ID", F.col(name).alias("value")).join(gold.select("ID", F.col(name).alias("code")), "ID")
        found = values(pairs.where("value IS NOT NULL").select("value", "code").distinct())
        assert len(found) == len({v for v, _ in found}) == len({c for _, c in found})
    before = sorted(values(job.read("encoder")))
    job.take_in(raw, 2)
    assert sorted(values(job.read("encoder"))) == before


def test_state_is_the_merge_of_all_batches(motor):
    job, _ = motor
    assert values(summaries.motor_kpis(job.latest("state"))) == values(summaries.motor_kpis(job.read("partials")))
    assert same(summaries.motor_profile(job.latest("state")), summaries.motor_profile(job.read("partials")))


def test_folders_of_seen_rows(spark, tmp_path):
    job = refresh.Refresh(spark, refresh.MOTOR_FEED, str(tmp_path))
    sizes = lambda n: [int(p.split("batches=")[1].split("/")[0]) for p in job.segments(n)]
    assert sizes(0) == [] and sizes(3) == [1] * 3 and sizes(16) == [16] and sizes(300) == [256, 16, 16] + [1] * 12
    for n in (1, 15, 16, 17, 255, 256, 1000, 5000):
        assert sum(sizes(n)) == n and len(sizes(n)) <= 15 * 4


def test_many_small_batches_open_few_files(spark, lake, tmp_path, monkeypatch):
    """Five batches with folders merged by twos: rows are kept once, a small batch opens its own buckets."""
    monkeypatch.setattr(refresh, "FAN_IN", 2)
    job = refresh.Refresh(spark, refresh.MOTOR_FEED, str(tmp_path))
    raw = lake.bronze("motor")
    rows = raw.distinct().limit(200).collect()
    fresh = []
    for n in range(5):
        part = rows[40 * n:40 * n + 40] + rows[:5]
        fresh.append(job.new_rows(spark.createDataFrame(part, raw.schema), n).count())
    usable = [refresh.MOTOR_FEED.usable(spark.createDataFrame(rows[40 * n:40 * n + 40], raw.schema)).count() for n in range(5)]
    assert fresh == usable
    folders = job.segments(5)
    assert [f.split("batches=")[1].split("/")[0] for f in folders] == ["4", "1"]
    one = job._seen(folders).limit(1).collect()[0]["bucket"]
    opened = lambda df: df.select(F.input_file_name()).distinct().count()
    everything = opened(job._seen(folders))
    few = opened(job._seen(folders).where(F.col("bucket") == one))
    assert few <= len(folders) and everything > 5 * few


def test_quoted_line_breaks_arrive_whole(spark, tmp_path):
    schema = refresh.MOTOR_FEED.schema
    row = ["Bus", "A\nB", "x, \"y\"", "100.0", "5.0", None, "2001", "01-JAN-14", "01-JAN-15"]
    files.write_csv(spark.createDataFrame([row], schema), f"{tmp_path}/arrivals/a")
    job = refresh.Refresh(spark, refresh.MOTOR_FEED, str(tmp_path))
    job.start(f"{tmp_path}/arrivals/*", every=None, line_breaks=True).awaitTermination()
    assert values(job.read("silver"), "MAKE", "USAGE") == [("A\nB", 'x, "y"')]


def test_arrivals_are_compressed_and_whole(lake, monkeypatch):
    """The stream's own input copy of the rows takes a fraction of their text."""
    class Taken:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(refresh.Refresh, "start", lambda self, arrivals, **kw: Taken())
    bronze = lake.bronze("motor")
    root = incremental._streamed(lake, refresh.MOTOR_FEED).root.rsplit("/", 1)[0]
    stored = lake.spark.read.format("binaryFile").load(f"{root}/arrivals/*/part-*").select("path", "length")
    assert stored.where(~F.col("path").endswith(".csv.gz")).isEmpty()
    text = bronze.select(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) + 1 for c in bronze.columns))).first()[0]
    assert stored.agg(F.sum("length")).first()[0] < text / 2
    assert same(files.read_csv(lake.spark, f"{root}/arrivals/*", refresh.MOTOR_FEED.schema), bronze)


def test_rows_of_a_batch_are_dealt_out_once(spark, lake, tmp_path, monkeypatch):
    """Deduplication places the rows; only merged folders are put in order by a second shuffle."""
    frames, dealt = type(spark.range(0)), []
    plain = frames.repartitionByRange
    monkeypatch.setattr(frames, "repartitionByRange", lambda self, *a: dealt.append(a) or plain(self, *a))
    monkeypatch.setattr(refresh, "FAN_IN", 2)
    job, rows = refresh.Refresh(spark, refresh.MOTOR_FEED, str(tmp_path)), lake.bronze("motor").distinct().limit(150).collect()
    frame = lambda n: spark.createDataFrame(rows[:n], refresh.MOTOR_FEED.schema)
    usable = [refresh.MOTOR_FEED.usable(frame(n)).count() for n in (50, 100, 150)]
    assert [job.new_rows(frame(50), 0).count(), job.new_rows(frame(100), 1).count()] == [usable[0], usable[1] - usable[0]]
    assert not dealt
    assert job.new_rows(frame(150), 2).count() == usable[2] - usable[1]
    assert len(dealt) == 1


def test_tasks_are_sized_by_rows(spark, tmp_path):
    """Whatever the session asks for, and without a change to it."""
    job, name = refresh.Refresh(spark, refresh.MOTOR_FEED, str(tmp_path)), "spark.sql.shuffle.partitions"
    before = spark.conf.getAll
    assert job.sized(10).conf.get(name) == spark.conf.get(name)
    assert job.sized(72_000_000).conf.get(name) == "144"
    assert job.sized(10).conf.get(name) == spark.conf.get(name)
    assert {k: v for k, v in job.sized(10).conf.getAll.items() if k not in refresh.SIZED and spark.conf.isModifiable(k)} == \
        {k: v for k, v in before.items() if k not in refresh.SIZED and spark.conf.isModifiable(k)}
    assert spark.conf.getAll == before


@pytest.mark.parametrize("lookup, broadcast", [(1000, 1000), (0, 1000), (0, 0)])
def test_rows_that_share_a_key_are_told_apart(spark, tmp_path, monkeypatch, lookup, broadcast):
    """Three keys for all rows: repeats go, other rows of the same key stay, nulls equal nulls."""
    monkeypatch.setattr(refresh, "LOOKUP_KEYS", lookup)
    monkeypatch.setattr(refresh, "BROADCAST_KEYS", broadcast)
    job = refresh.Refresh(spark, refresh.MOTOR_FEED, str(tmp_path))
    monkeypatch.setattr(job, "_keyed", lambda df: df.withColumn(refresh.KEY, F.pmod(F.col("PREMIUM").cast("long"), F.lit(3))))
    row = lambda i: ("Bus", None if i % 2 else "A", "x", "100.0", str(i), None, "2001", "01-JAN-14", None)
    frame = lambda numbers: spark.createDataFrame([row(i) for i in numbers], refresh.MOTOR_FEED.schema)
    premiums = lambda df: sorted(int(r["PREMIUM"]) for r in df.collect())
    assert premiums(job.new_rows(frame([1, 2, 2, 3, 4]), 0)) == [1, 2, 3, 4]
    assert premiums(job.new_rows(frame([2, 3, 5, 6, 6]), 1)) == [5, 6]
    assert premiums(job.new_rows(frame([6, 7, 1]), 2)) == [7]
    assert premiums(job.new_rows(frame([1, 2]), 3)) == []
