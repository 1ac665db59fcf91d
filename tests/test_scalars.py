import datetime as dt
from decimal import Decimal

import pytest
from conftest import values
from pyspark.sql import functions as F

from perilake.functions import numeric, risk, text
from perilake.functions.ordering import top, up
from perilake.plans import reports
from perilake.streaming import summaries


@pytest.mark.parametrize("x, digits, want", [(1.005, 2, 1.0), (0.285, 2, 0.28), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (0.49999999999999994, 0, 0.0), (1e300, 2, 1e300), (None, 1, None)])
def test_rounding(spark, x, digits, want):
    df = spark.createDataFrame([(x,)], "x double").select(numeric.round_to(F.col("x"), digits))
    assert values(df) == [(want,)]


def test_whole_numbers_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (2010.0,), (None,)], "x double")
    assert values(df.select(numeric.to_whole(F.col("x")))) == [(0,), (2,), (2,), (2010,), (None,)]


def test_ratio_is_null_on_zero_divisor(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (None, 2.0), (2.0, 3.0)], "a double, b double")
    assert values(df.select(numeric.safe_ratio(F.col("a"), F.col("b"), 100.0, 4))) == [(25.0,), (None,), (None,), (66.6667,)]


def test_sums_ignore_row_order(spark):
    rows = [(0.1,), (1e9,), (0.2,), (-1e9,), (0.3,)] * 50
    for n in (1, 7):
        df = spark.createDataFrame(rows, "x double").repartition(n)
        assert values(df.agg(numeric.exact_sum(F.col("x")))) == [(30.0,)]


@pytest.mark.parametrize("scale", [0, 4, 10])
def test_fixed_sums_against_exact_arithmetic(spark, scale):
    texts = ["-0.0003", "0.0001", "123456.7891", "-99999.5", "0", "7", "81234567.25", "-81234567.5"]
    df = spark.createDataFrame([(float(t),) for t in texts] + [(None,)], "x double").repartition(3)
    want = sum(Decimal(t).quantize(Decimal(1).scaleb(-scale), "ROUND_HALF_EVEN") for t in texts)
    got = df.agg(numeric.fixed_sum(F.col("x"), scale).alias("s")).first()["s"]
    assert got == want and df.limit(0).agg(numeric.fixed_sum(F.col("x"), scale)).first()[0] is None


def test_fixed_sum_of_large_values(spark):
    df = spark.createDataFrame([(9e11 - 0.125,)] * 1000 + [(-9e11,)] * 999, "x double")
    assert df.agg(numeric.fixed_sum(F.col("x"))).first()[0] == Decimal("899999999875")


def test_average_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "x double")
    assert values(df.agg(numeric.exact_avg(F.col("x")))) == [(None,)]


def test_tier_edges(spark):
    scores = [-1, 0, 2, 3, 5, 6, 100, 101, None]
    df = spark.createDataFrame([(s,) for s in scores], "s int")
    got = values(df.select(risk.risk_tier(F.col("s")), risk.risk_tier_label(F.col("s"))))
    assert [g[0] for g in got] == [None, 0, 0, 1, 1, 2, 2, None, None]
    assert [g[1] for g in got] == ["Low", "Low", "Low", "Medium", "Medium", "High", "High", "High", "Low"]


def test_left_closed_bins(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "s int")
    got = values(df.select(risk.bucketize(F.col("s"), (1, 2, 3), ("a", "b"), right=False)))
    assert got == [(None,), ("a",), ("b",), (None,)]


def test_flags_and_features(spark):
    df = spark.createDataFrame([(15000.0, 0.0), (15001.0, 0.5), (None, None)], "m double, paid double")
    assert values(df.select(risk.high_mileage(F.col("m")), risk.had_claim(F.col("paid")))) == [(0, 0), (1, 1), (0, 0)]
    age = spark.createDataFrame([(2014.0,), (None,)], "y double").select(risk.vehicle_age(F.col("y")))
    assert values(age) == [(10.0,), (14.0,)]
    days = spark.createDataFrame([(dt.date(2013, 8, 8), dt.date(2013, 8, 1)), (None, dt.date(2013, 8, 1))], "b date, e date")
    assert values(days.select(risk.policy_days(F.col("b"), F.col("e")))) == [(-7,), (None,)]


def test_codes_threshold_and_premium(spark):
    df = spark.createDataFrame([(0, 0.5), (2, 0.49999), (9, 1.0), (None, 0.0)], "c int, p double")
    assert values(df.select(risk.map_values(F.col("c"), risk.TIER_BY_CODE))) == [("Low",), ("High",), (None,), (None,)]
    assert values(df.select(risk.tier_name(F.col("c")))) == [("Low",), ("High",), ("High",), ("High",)]
    assert values(df.select(risk.threshold(F.col("p")))) == [(1,), (0,), (1,), (0,)]
    assert values(df.limit(1).select(risk.suggested_premium(F.lit(7), F.lit(2)))) == [(1400,)]
    assert values(df.limit(1).select(risk.direction(F.lit(0.0)), risk.direction(F.lit(0.1)))) == [("reduces", "increases")]


def test_rendered_text(spark):
    df = spark.createDataFrame([("Bus", 1e7, 3), (None, None, 4)], "k string, v double, n int")
    got = values(df.select(text.render("{k}: ${v}, {n}%.", {"v": "%.2f", "n": "%d"})))
    assert got == [("Bus: $10000000.00, 3%.",), ("unknown: $unknown, 4%.",)]


def test_top_breaks_ties_and_puts_nulls_last(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), (None, 2), ("c", None), ("d", 1)], "k string, n int")
    assert values(top(df, "n", ["k"], 4)) == [("a", 2), ("b", 2), (None, 2), ("d", 1)]
    assert [r[0] for r in values(df.orderBy(up("k")))] == ["a", "b", "c", "d", None]


@pytest.mark.parametrize("odd", ["inf", "-inf", "1e15", "1e300", "1e23"])
def test_no_value_stops_a_sum(spark, odd):
    numbers = [0.1, 0.2, -7.25, float(odd), 3.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    want = {values(df.repartition(n).agg(numeric.exact_sum(F.col("x"))))[0] for n in (1, 2, 5)}
    assert want == {(float(odd) + (-3.95 if odd == "1e15" else 0.0),)}


def test_reports_and_partials_take_any_value(spark, lake):
    gold = lake.gold("motor")
    first = gold.limit(1)
    for odd in (float("inf"), 1e15, 1e300):
        dirty = gold.unionByName(first.withColumn("PREMIUM", F.lit(odd)).withColumn("INSURED_VALUE", F.lit(odd)))
        parts = summaries.motor_partials(dirty)
        assert values(reports.motor_kpis(dirty)) == values(summaries.motor_kpis(parts))
        assert values(summaries.motor_kpis(parts), "avg_premium")[0][0] > 1e9
