from conftest import values

from perilake.operators import cleaning, encoding
from perilake.sources.schemas import MOTOR


def test_dedup_takes_null_as_equal(spark):
    rows = [("a", None), ("a", None), (None, None), (None, None), ("a", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    assert sorted(values(cleaning.dedup(df)), key=str) == sorted([("a", None), (None, None), ("a", 1.0)], key=str)


def test_one_row_copied_many_times(spark):
    rows = [("hot", 1)] * 5000 + [(f"k{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(8)
    assert cleaning.dedup(df).count() == 101


def test_drop_missing(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4), (None, None)], "a int, b int")
    assert values(cleaning.drop_missing(df)) == [(3, 4)]
    assert sorted(values(cleaning.drop_missing(df, ["b"])), key=str) == [(3, 4), (None, 2)]


def test_silver_motor_judges_copies_on_raw_text(spark):
    row = ("Bus", None, "Own", "10.0", "1.0", None, "2010", "01-JAN-15", "bad")
    other = row[:3] + ("10.00",) + row[4:]
    unusable = row[:3] + ("n/a",) + row[4:]
    df = spark.createDataFrame([row, row, other, unusable], MOTOR)
    silver = cleaning.silver_motor(df)
    assert values(silver, "INSURED_VALUE", "CLAIM_PAID", "INSR_END") == [(10.0, 0.0, None)] * 2


def test_empty_input(spark):
    empty = spark.createDataFrame([], MOTOR)
    assert cleaning.silver_motor(empty).count() == 0


def test_codes_are_sorted_dense_and_kept(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None), ("b", "y")], "p string, q string")
    mapping = encoding.fit_encoder(df, ["p", "q"])
    assert sorted(values(mapping)) == [("p", "a", 0), ("p", "b", 1), ("p", "c", 2), ("q", "x", 0), ("q", "y", 1)]
    later = spark.createDataFrame([("c", "z"), ("zz", None)], "p string, q string")
    assert values(encoding.apply_encoder(later, mapping, ["p", "q"])) == [(2, 2), (3, None)]


def test_range_ranks_equal_window_ranks(spark):
    values_ = [(f"c{i % 3}", f"v{(i * 7919) % 1000:04d}") for i in range(3000)]
    pairs = spark.createDataFrame(values_, "column_name string, value string").distinct()
    assert set(values(encoding.rank_by_range(pairs))) == set(values(encoding.rank_in_window(pairs)))
