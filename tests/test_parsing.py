import datetime as dt

import pytest
from conftest import values
from pyspark.sql import functions as F

from perilake.functions import parsing


@pytest.mark.parametrize(
    "text, number",
    [
        ("12.5", 12.5), (" 12 ", 12.0), ("-3", -3.0), ("+.5", 0.5), ("1e3", 1000.0), ("7.", 7.0),
        ("1d", None), ("1f", None), ("1,000", None), ("nan", None), ("", None), ("n/a", None), (None, None),
        ("inf", float("inf")), ("-Infinity", float("-inf")), ("0x10", None),
    ],
)
def test_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string").select(parsing.to_number(F.col("t")))
    assert values(df) == [(number,)]


@pytest.mark.parametrize(
    "text, day",
    [
        ("08-AUG-13", dt.date(2013, 8, 8)), ("8-Aug-13", dt.date(2013, 8, 8)), ("01-JAN-69", dt.date(1969, 1, 1)),
        ("01-JAN-68", dt.date(2068, 1, 1)), ("29-feb-72", dt.date(1972, 2, 29)),
        ("31-FEB-15", None), ("08-AUG-2013", None), (" 08-AUG-13", None), ("08-XXX-13", None), ("00-JAN-10", None),
        ("8 x-AUG-13", None), ("", None), (None, None),
    ],
)
def test_date(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string").select(parsing.to_date_coerce(F.col("t")))
    assert values(df) == [(day,)]


def test_missing_tokens(spark):
    rows = [("NA", 1.0), ("none", float("nan")), ("None", None), ("", 2.0), ("null", 3.0), ("x", 4.0)]
    df = parsing.normalize_missing(spark.createDataFrame(rows, "t string, v double"))
    assert values(df) == [(None, 1.0), ("none", None), (None, None), (None, 2.0), (None, 3.0), ("x", 4.0)]


def test_missing_tokens_in_chosen_columns(spark):
    df = spark.createDataFrame([("NA", "NA")], "a string, b string")
    assert values(parsing.normalize_missing(df, cols=["a"])) == [(None, "NA")]
    assert values(parsing.normalize_missing(df, tokens=["-"])) == [("NA", "NA")]
