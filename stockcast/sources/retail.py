"""Daily sales panels from the order tables: one series per key, summed by ship date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("dense", "sparse", "mid")
#: The state of a dense series, and of a region by its key modulo 3.
FLAG_STATES = {"A": "CA", "N": "TX", "R": "WI"}
STATES = ("CA", "TX", "WI")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    return F.col(column).cast("date")


def date_span(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """The first and the last day with a sale, in one scan of one column."""
    return tuple(table(spark, sf_dir, "lineitem").agg(F.min(day("l_shipdate")), F.max(day("l_shipdate"))).first())


def last_date(spark: SparkSession, sf_dir: str) -> date:
    return date_span(spark, sf_dir)[1]


def _state(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), (key % 3 + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Order lines with their series: id, item_id, store_id, state_id, date, quantity, value."""
    if kind not in KINDS:
        raise ValueError(f"unknown panel {kind!r}")
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey", day("l_shipdate").alias("date"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("value"))
    flag_state = F.create_map(*[F.lit(x) for pair in FLAG_STATES.items() for x in pair])[F.col("l_returnflag")]
    if kind != "dense":
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        li = li.join(part, "l_partkey")
    if kind == "sparse":
        nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
        region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        li = li.join(supplier.join(F.broadcast(nation.join(region, "r_regionkey")), "s_nationkey"), "l_suppkey")
        keys = (F.concat_ws("_", "p_type", "r_name"), F.col("p_type"), F.col("r_name"), _state(F.col("r_regionkey")))
    elif kind == "mid":
        keys = (F.concat_ws("_", "p_type", "l_returnflag"), F.col("p_type"), F.col("l_returnflag"), flag_state)
    else:
        keys = (F.col("l_returnflag"), F.lit("ALL"), F.col("l_returnflag"), flag_state)
    names = ("id", "item_id", "store_id", "state_id")
    return li.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), "date", "quantity", "value")


def daily_sales(rows: DataFrame) -> DataFrame:
    """(id, item_id, store_id, state_id, date, sales): days with a sale only."""
    return rows.groupBy("id", "item_id", "store_id", "state_id", "date").agg(F.sum("quantity").alias("sales"))


def weekly_prices(rows: DataFrame) -> DataFrame:
    """(id, week, sell_price): mean unit value by series and week, which begins on Monday, to four digits.

    Unit values are summed as decimals, so the price doesn't depend on the order of the rows.
    """
    unit = F.try_divide("value", "quantity").cast("decimal(18,8)")
    mean = F.try_divide(F.sum(unit).cast("double"), F.count(unit))
    return rows.groupBy("id", F.trunc("date", "week").alias("week")).agg((F.floor(mean * 10000 + 0.5) / 10000).alias("sell_price"))
