import datetime

import pytest
from conftest import values
from pyspark.sql import types as T

from perilake.plans import reports
from perilake.plans.medallion import Lake
from perilake.sources import files, tables, testbed
from perilake.sources.schemas import CLAIMS


def test_csv_round_trip(spark, lake, tmp_path):
    gold = lake.bronze("claims")
    files.write_csv(gold, str(tmp_path / "c"))
    again = files.read_csv(spark, str(tmp_path / "c"), CLAIMS)
    assert again.schema == CLAIMS
    assert again.exceptAll(gold).count() == 0 and gold.exceptAll(again).count() == 0


def test_csv_tokens_quotes_and_bad_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,v\nNA,1\n"say ""hi"", ok",2\nnone,oops\n,4\n')
    schema = T.StructType().add("k", "string").add("v", "double")
    df = files.read_csv(spark, str(tmp_path / "x.csv"), schema)
    assert values(df) == [(None, 1.0), ('say "hi", ok', 2.0), ("none", None), (None, 4.0)]
    kept = files.read_csv(spark, str(tmp_path / "x.csv"), schema, keep_corrupt=True).cache()
    assert values(kept, files.CORRUPT) == [(None,), (None,), ("none,oops",), (None,)]


def test_tables_replace_append_and_count(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    store.write(spark.range(10), "bronze", "n")
    store.write(spark.range(4), "bronze", "n")
    assert store.written == {"bronze_n": 4} and store.read("bronze", "n").count() == 4
    store.append(spark.range(3), "bronze", "n")
    assert values(tables.audit_counts({"n": store.read("bronze", "n")})) == [("n", 7)]


def test_appended_frames_match_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2), ("x", 1)], "s string, i int")
    assert sorted(values(tables.append_batch(a, b))) == [(1, "x"), (1, "x"), (2, "y")]


def test_metrics_file(spark, tmp_path):
    df = spark.createDataFrame([(0.8184, 0.8926)], "accuracy double, roc_auc double")
    files.write_metrics(df, str(tmp_path / "m"))
    assert values(files.read_metrics(spark, str(tmp_path / "m"), df.schema)) == [(0.8184, 0.8926)]


def test_spread_only_touches_small_scans(spark):
    assert tables.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(0, 100, 1, 40)).rdd.getNumPartitions() == 40


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    rows = [("  a ", "x"), ("b", 'line1\nline2, "quoted"'), ("c ", " ")]
    df = spark.createDataFrame(rows, "k string, v string")
    files.write_csv(df, str(tmp_path / "c"))
    again = files.read_csv(spark, str(tmp_path / "c"), df.schema, line_breaks=True)
    assert sorted(values(again)) == sorted(rows)


def test_misfits_are_counted(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\na,1\nb,2.0\nc,\nd,x\n")
    schema = T.StructType().add("k", "string").add("v", "long")
    assert values(files.misfits(spark, str(tmp_path / "x.csv"), schema)) == [(4, 2)]


def test_a_stored_lake_is_opened_without_a_write(spark, lake, tmp_path):
    def missing():
        raise AssertionError("the raw input was read again")

    first = Lake(spark, str(tmp_path), claims=missing, motor=lambda: lake.bronze("motor"))
    want = values(reports.motor_kpis(first.gold("motor")))
    again = Lake(spark, str(tmp_path), claims=missing, motor=missing)
    assert values(reports.motor_kpis(again.gold("motor"))) == want and not again.store.written


def test_a_reader_keeps_its_version_while_the_table_is_replaced(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    store.write(spark.range(10), "gold", "n")
    reader, other = store.read("gold", "n"), tables.Warehouse(spark, str(tmp_path))
    opened = other.read("gold", "n")
    store.write(spark.range(4), "gold", "n")
    assert reader.count() == opened.count() == 10 and store.read("gold", "n").count() == 4
    assert other.read("gold", "n").count() == 10
    other.refresh()
    assert other.read("gold", "n").count() == 4
    assert store.clean("gold", "n") == 1 and store.clean("gold", "n") == 0
    assert store.read("gold", "n").count() == 4
    assert len(list((tmp_path / "gold" / "n").iterdir())) == 1


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    store.write(spark.range(10), "gold", "n")
    broken = spark.range(5).selectExpr("raise_error('broken') AS id")
    with pytest.raises(Exception, match="broken"):
        store.write(broken, "gold", "n")
    assert tables.Warehouse(spark, str(tmp_path)).read("gold", "n").count() == 10
    assert store.current("gold", "missing") is None


def test_exports_can_be_removed(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    path = store.fresh_path("exports", "x")
    spark.range(3).write.parquet(path)
    store.write(spark.range(3), "gold", "n")
    assert store.clean_exports() == 1 and store.read("gold", "n").count() == 3
    assert not list((tmp_path / "exports").iterdir())


@pytest.mark.parametrize("parts", [0, 100])
def test_lines_of_a_large_table_are_dealt_out_once(spark, tmp_path, monkeypatch, parts):
    lines = [(i % 90 if i % 11 else None, i % 7, i, 5.0 + i, 100.0 + i, 0.05, 0.02, "R", datetime.date(2020, 1, 1 + i % 28))
             for i in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(i, "3-MEDIUM", datetime.date(2019, 5, 5)) for i in range(80)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, f"t{i}", "b", i) for i in range(6)], "p_partkey long, p_type string, p_brand string, p_size int") \
        .write.parquet(str(tmp_path / "part.parquet"))
    whole = testbed.motor_raw(spark, str(tmp_path))
    want = sorted(map(str, values(whole)))
    monkeypatch.setattr(testbed, "JOINED_AT_ONCE", 15)
    monkeypatch.setattr(testbed, "BROADCAST_PARTS", parts)
    monkeypatch.setattr(testbed, "spread", None)
    dealt = testbed.motor_raw(spark, str(tmp_path))
    assert len(want) > 200 and sorted(map(str, values(dealt))) == want
    plan = dealt._jdf.queryExecution().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 20), REPARTITION_BY_NUM" in plan
    assert ("hashpartitioning(l_partkey" in plan) == (parts == 0)


@pytest.mark.parametrize("customers", [0, 100])
def test_claims_of_a_large_table_are_dealt_out_by_order(spark, tmp_path, monkeypatch, customers):
    flags = [("R", 0.09, 0.08), ("N", 0.01, 0.01), (None, None, None)]
    lines = [(i % 90 if i % 11 else None, *flags[i % 3]) for i in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    # Orders without a key, without lines, twice, and of customers that are missing, twice or without a key.
    orders = [(i if i % 13 else None, i % 9 if i % 7 else None, "P" if i % 4 else "F", "3-MEDIUM") for i in [*range(120), 5, 5]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    people = [(i, i + 1, 10.5 * i, "BUILDING") for i in (0, 1, 2, 2, 3, 5, 6)] + [(None, 1, 0.0, "MACHINERY")]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    want = sorted(map(str, values(testbed.claims_raw(spark, str(tmp_path)))))
    monkeypatch.setattr(testbed, "JOINED_AT_ONCE", 15)
    monkeypatch.setattr(testbed, "BROADCAST_PARTS", customers)
    dealt = testbed.claims_raw(spark, str(tmp_path))
    assert len(want) > 80 and sorted(map(str, values(dealt))) == want
    plan = dealt._jdf.queryExecution().toString()
    assert plan.count(", 20), REPARTITION_BY_NUM") >= 2 and "hashpartitioning(l_orderkey" in plan and "hashpartitioning(o_orderkey" in plan
    assert ("hashpartitioning(c_custkey" in plan) == (customers == 0)
