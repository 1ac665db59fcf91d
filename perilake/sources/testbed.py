"""Raw claims and motor frames derived from the order/lineitem test tables."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from perilake.sources.tables import spread

# Rows of a larger table that one task of a join holds, however many partitions the session asks for.
JOINED_AT_ONCE = 250_000
# Parts or customers up to this number are broadcast, about 130 MB; more are joined by key.
BROADCAST_PARTS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table is one file of one row group: without this, one task's work."""
    return spread(table(spark, sf_dir, name))


def _dec(col: Column, precision: int, scale: int = 2) -> Column:
    return col.cast(T.DecimalType(precision, scale))


def _short_date(col: Column) -> Column:
    return F.upper(F.date_format(col, "dd-MMM-yy"))


def motor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per lineitem, every column as raw text.

    Lines of a large table are dealt out once, by the key of the join, over as many
    tasks as there are rows for; a task's sorts do not grow with the table.
    """
    line, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    pieces = ceil(line.count() / JOINED_AT_ONCE)
    large = pieces > spark.sparkContext.defaultParallelism
    line = line.repartition(pieces, "l_orderkey") if large else spread(line)
    orders = orders.repartition(pieces, "o_orderkey") if large else orders
    policies = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if large and part.count() > BROADCAST_PARTS:
        policies, part = policies.repartition(pieces, "l_partkey"), part.repartition(pieces, "p_partkey")
    elif large:
        part = F.broadcast(part)
    joined = policies.join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = _dec(F.col("l_extendedprice"), 12)
    rate = F.lit("0.01").cast(T.DecimalType(4, 2)) + _dec(F.col("l_tax"), 4)
    return joined.select(
        F.col("p_type").alias("TYPE_VEHICLE"),
        F.when(F.col("p_partkey") % 37 != 0, F.col("p_brand")).alias("MAKE"),
        F.col("o_orderpriority").alias("USAGE"),
        F.when(F.col("l_quantity") == 1, "0")
        .when(F.col("l_partkey") % 53 == 0, "n/a")
        .otherwise(price.cast("string"))
        .alias("INSURED_VALUE"),
        F.when(F.col("l_suppkey") % 41 != 0, (price * rate).cast("string")).alias("PREMIUM"),
        F.when(F.col("l_returnflag") == "R", (price * _dec(F.col("l_discount"), 4)).cast("string")).alias("CLAIM_PAID"),
        F.when(F.col("p_size") != 50, (F.lit(1990) + F.col("p_size") % 29).cast("string")).alias("PROD_YEAR"),
        _short_date(F.least("o_orderdate", "l_shipdate")).alias("INSR_BEGIN"),
        _short_date(F.greatest("o_orderdate", "l_shipdate")).alias("INSR_END"),
    )


def _choose(code: Column, *names: str) -> Column:
    chain = F.when(code == 0, names[0])
    for value, name in enumerate(names[1:-1], start=1):
        chain = chain.when(code == value, name)
    return chain.otherwise(names[-1])


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One driver per order; rows with ``ID % 97 = 0`` arrive twice.

    Lines and orders of large tables are dealt out by order key as in ``motor_raw``.
    """
    line, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    pieces = ceil(line.count() / JOINED_AT_ONCE)
    large = pieces > spark.sparkContext.defaultParallelism
    flags = line.select(
        "l_orderkey",
        (F.col("l_returnflag") == "R").alias("acc"),
        (F.col("l_discount") > 0.085).alias("spd"),
        (F.col("l_tax") > 0.075).alias("dui"),
    )
    flags = flags.repartition(pieces, "l_orderkey") if large else flags
    orders = orders.repartition(pieces, "o_orderkey") if large else orders
    # Lines are counted per order before the join, so the join is one-to-one.
    counts = flags.groupBy("l_orderkey").agg(*[F.count_if(c).alias(c) for c in ("acc", "spd", "dui")])
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    acc, spd, dui = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("acc", "spd", "dui"))
    counted = orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if large and customer.count() > BROADCAST_PARTS:
        counted, customer = counted.repartition(pieces, "o_custkey"), customer.repartition(pieces, "c_custkey")
    elif large:
        customer = F.broadcast(customer)
    joined = counted.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    priority, segment = F.col("o_orderpriority"), F.col("c_mktsegment")
    rows = joined.select(
        key.alias("ID"),
        _choose(cust % 4, "16-25", "26-39", "40-64", "65+").alias("AGE"),
        _choose(cust % 2, "female", "male").alias("GENDER"),
        F.when(F.col("c_nationkey") < 20, "majority").otherwise("minority").alias("RACE"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "0-9y")
        .when(priority == "3-MEDIUM", "10-19y")
        .when(priority == "4-NOT SPECIFIED", "20-29y")
        .otherwise("30y+")
        .alias("DRIVING_EXPERIENCE"),
        _choose(cust % 3, "high school", "none", "university").alias("EDUCATION"),
        F.when(segment == "AUTOMOBILE", "poverty")
        .when(segment == "BUILDING", "working class")
        .when(segment == "FURNITURE", "middle class")
        .otherwise("upper class")
        .alias("INCOME"),
        F.when(~(F.col("c_acctbal") < -900), (F.col("c_acctbal") + 1000) / 11000).alias("CREDIT_SCORE"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(1.0).alias("VEHICLE_OWNERSHIP"),
        F.when(key % 10 < 3, "after 2015").otherwise("before 2015").alias("VEHICLE_YEAR"),
        (key % 2).cast("double").alias("MARRIED"),
        ((key % 3) % 2).cast("double").alias("CHILDREN"),
        (F.lit(10000) + F.col("c_nationkey")).cast("int").alias("POSTAL_CODE"),
        F.when(key % 29 != 0, (F.lit(5000) + (key * 7919) % 25 * 1000).cast("double")).alias("ANNUAL_MILEAGE"),
        F.when(key % 20 == 0, "sports car").otherwise("sedan").alias("VEHICLE_TYPE"),
        spd.alias("SPEEDING_VIOLATIONS"),
        dui.alias("DUIS"),
        acc.alias("PAST_ACCIDENTS"),
        F.when(acc * 2 + spd + dui * 3 + (key * 31) % 7 > 8, 1.0).otherwise(0.0).alias("OUTCOME"),
    )
    copies = F.when(F.col("ID") % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("*", F.explode(copies).alias("_copy")).drop("_copy")
