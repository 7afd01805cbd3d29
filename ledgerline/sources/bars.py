"""Bars (code, date, open, high, low, close, volume, amount) from tables of single events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import dealt

#: Of a table, at most.
ROWS_A_TASK = 250_000


def parts(spark: SparkSession, d: str, table: str = "lineitem") -> int | None:
    """Into how many partitions to deal a table's rows, so that a task's share doesn't grow with the table; a number that is given isn't cut by adaptive
    execution, which goes by compressed bytes, not by rows. None: one task's share or less. The rows are counted from the files' footers."""
    n = -(-spark.read.parquet(f"{d}/{table}.parquet").count() // ROWS_A_TASK)
    return max(n, spark.sparkContext.defaultParallelism) if n > 1 else None


def bars(rows: DataFrame, code: Column, at: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    """One aggregation; order must be total within a code and date, or include the price."""
    r = rows.select(code.cast("long").alias("code"), F.to_date(at).alias("date"), price.cast("double").alias("p"), volume.cast("double").alias("v"), order.alias("o"))
    return r.groupBy("code", "date").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"), F.sum(F.col("p") * F.col("v")).alias("amount"))


def supplier_bars(spark: SparkSession, d: str) -> DataFrame:
    """A supplier has few lines a day, so lines are dealt by supplier as they are: less to shuffle than sums of each day, and windows of a code find its bars in
    one place and in order."""
    c = F.col
    t = dealt(spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey").withColumn("l_suppkey", c("l_suppkey").cast("long")), "l_suppkey", parts(spark, d))
    return bars(t, c("l_suppkey"), c("l_shipdate"), c("l_extendedprice"), c("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))


def user_bars(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet")
    return bars(t, F.col("user_id"), F.col("ts"), F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))


SUPPLIER_SQL = """select l_suppkey as code, cast(l_shipdate as date) as date, arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as open, max(l_extendedprice) as high,
 min(l_extendedprice) as low, arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as close, sum(l_quantity) as volume, sum(l_extendedprice * l_quantity) as amount
 from lineitem group by all"""
USER_SQL = """select user_id as code, cast(ts as date) as date, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close,
 cast(count(*) as double) as volume, sum(value * 1.0) as amount from events group by all"""


def adjusted(raw: DataFrame) -> DataFrame:
    """Forward-adjusted bars: prices times adj_factor over the code's latest positive factor; a NULL factor gives NULL prices."""
    base = raw.filter(F.col("adj_factor") > 0).groupBy("code").agg(F.max_by("adj_factor", "date").alias("base"))
    ratio = F.try_divide("adj_factor", "base")
    return raw.join(base, "code", "left").withColumns({c: F.col(c) * ratio for c in ("open", "high", "low", "close")}).drop("base")


def back_adjusted(raw: DataFrame) -> DataFrame:
    return raw.withColumns({c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")})
