import random

import pytest
from conftest import values
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from perilake.operators import metrics


def pairs_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", ["1", "8", "61"])
@pytest.mark.parametrize("low, high", [(0.0, 1.0), (-3.0, 5.0), (0.5, 0.5001)])
def test_auc_equals_pair_count(spark, parts, low, high):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), round(rng.uniform(low, high), 5)) for _ in range(400)]
    rows += [(i % 2, (low + high) / 2) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, s double").repartition(5)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, (parts, "false")):
        spark.conf.set(k, v)
    try:
        got = metrics.quality(df, "y", "s", at=0.5).first()
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert got["roc_auc"] == pytest.approx(pairs_auc(rows), abs=1e-12)
    assert got["tp"] == sum(y == 1 and s >= 0.5 for y, s in rows) and got["fp"] == sum(y == 0 and s >= 0.5 for y, s in rows)
    assert got["tn"] + got["fn"] + got["tp"] + got["fp"] == len(rows)


def test_scores_above_one_are_spread_over_tasks(spark):
    """All scores beyond [0, 1], none alike: no task ranks more than a few of the ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(200_000).select((F.col("id") % 2).cast("int").alias("y"), (F.lit(5.0) + F.col("id") / 7).alias("s"))
        ties = metrics.score_table(df, "y", "s").repartitionByRange("_s").groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in ties.collect()]
        assert len(sizes) == 8 and max(sizes) < 40_000
        assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.5, abs=1e-4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quality_of_no_rows(spark):
    df = spark.createDataFrame([], "y int, s double")
    assert values(metrics.quality(df, "y", "s")) == [(0, 0, 0, 0, 0.0, None)]


def test_auc_agrees_with_the_built_in_evaluator(spark):
    rng = random.Random(3)
    rows = [(float(i % 3 == 0), rng.random() + 0.2 * (i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "label double, s double")
    built_in = BinaryClassificationEvaluator(rawPredictionCol="s", numBins=0).evaluate(df)
    assert metrics.roc_auc(df, "label", "s").first()[0] == pytest.approx(built_in, abs=1e-9)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert values(metrics.roc_auc(df, "y", "s")) == [(None,)]


def test_auc_by_model(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.1), ("b", 0, 0.9)]
    df = spark.createDataFrame(rows, "m string, y int, s double")
    assert sorted(values(metrics.roc_auc(df, "y", "s", by=["m"]))) == [("a", 1.0), ("b", 0.0)]


def test_report_on_undefined_figures(spark):
    cells = spark.createDataFrame([(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    rows = {r["class"]: r for r in metrics.classification_report(cells).collect()}
    assert rows["1"]["precision"] == rows["1"]["recall"] == rows["1"]["f1"] == 0.0
    assert rows["0"]["f1"] == 1.0 and rows["accuracy"]["recall"] == 1.0 and rows["macro avg"]["f1"] == 0.5
    assert values(metrics.business_rates(cells)) == [(None, 0.0)]


def test_confusion_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y int, p int")
    assert values(metrics.accuracy(metrics.confusion(df, "y", "p"))) == [(2, 1, 1, 1, 0.6)]
