import pytest
from conftest import values
from pyspark.sql import functions as F

from perilake.operators import profiling, sampling


def test_counts_and_nulls(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("b", None), (None, 2.0)], "k string, v double")
    assert values(profiling.value_counts(df, "k")) == [("b", 2), ("a", 1)]
    assert values(profiling.null_counts(df)) == [("k", 1), ("v", 2)]
    assert values(profiling.shape(df)) == [(0, "k", "string", 4, 2), (1, "v", "double", 4, 2)]
    assert values(profiling.percent_where(df, F.col("v") > 1, "pct")) == [(25.0,)]


def test_histograms(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (10.0,), (None,)], "v double")
    assert values(profiling.numeric_histogram(df, "v", 2)) == [(0, 0.0, 2), (1, 5.0, 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert values(profiling.numeric_histogram(same, "v", 5)) == [(0, 3.0, 2)]
    assert values(profiling.numeric_histogram(df.limit(0), "v", 5)) == []


def test_class_weights(spark):
    df = spark.createDataFrame([(1.0,)] + [(0.0,)] * 3, "y double")
    got = {r["label"]: r for r in profiling.class_balance(df, "y").collect()}
    assert got[0]["balanced_weight"] == pytest.approx(4 / 6) and got[1]["balanced_weight"] == 2.0
    assert got[1]["other_to_own"] == 3.0
    assert sorted(set(values(profiling.add_class_weight(df, "y")))) == [(0.0, 4 / 6), (1.0, 2.0)]


def test_single_class(spark):
    df = spark.createDataFrame([(0.0,)] * 3, "y double")
    assert values(profiling.class_balance(df, "y"), "label", "other_to_own") == [(0, 0.0)]
    assert set(values(profiling.add_class_weight(df, "y"), "weight")) == {(0.5,)}


def test_split_is_stable_and_close_to_its_share(spark):
    df = spark.range(20000).withColumn("y", F.col("id") % 3)
    one = sampling.stratified_split(df, "id")
    again = sampling.stratified_split(df.repartition(17), "id")
    assert one.exceptAll(again).count() == 0
    shares = values(one.groupBy("y").agg(F.avg("is_test")), "avg(is_test)")
    assert all(abs(s[0] - 0.2) < 0.02 for s in shares)
    train, test = sampling.train_and_test(df, "id")
    assert train.count() + test.count() == 20000 and train.join(test, "id").count() == 0
    with pytest.raises(ValueError):
        sampling.hash_below(F.col("id"), 1.5, 1)


def test_exact_split_takes_the_exact_share(spark):
    df = spark.range(9001).withColumn("y", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3))
    got = sampling.exact_split(df.repartition(7), "y", "id", 0.2, 42)
    for r in got.groupBy("y").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect():
        assert r["t"] == -(-r["n"] // 5)
    copies = df.unionByName(df.where("id = 3")).unionByName(df.where("id = 3"))
    sides = sampling.exact_split(copies, "y", "id").groupBy("id").agg(F.countDistinct("is_test").alias("n"))
    assert sides.where("n > 1").count() == 0
    assert sampling.exact_split(df.limit(0), "y", "id").count() == 0


def test_exact_split_of_very_many_classes(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 150).alias("y"))
    sizes = sampling.exact_split(df, "y", "id", 0.25).groupBy("y").agg(F.sum("is_test").alias("n"))
    assert set(values(sizes, "n")) == {(5,)} and sizes.count() == 150


def test_exact_split_reads_rows_of_few_classes_in_place(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS y").repartition(7).checkpoint()
    with_shuffled_joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sampling.exact_split(df, "y", "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_shuffled_joins)
    assert "hashpartitioning" not in plan
