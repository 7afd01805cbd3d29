"""Queries whose rows come through the feed data source, by day, by range and key, as a snapshot and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.catalogue import query
from ledgerline.plans.streams import _folder
from ledgerline.sources.feeds import register


def _feed(spark: SparkSession, d: str, feed: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("feed").options(feed=feed, path=d, wait="0.1", **options).load()


def _stream(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    folder = _folder(spark)
    days = spark.readStream.format("feed").options(feed="events", path=d, at="ts", whole="true", wait="0.1").load()
    kept = days.filter("event_type <> 'error'").select(F.to_date("ts").alias("date"), "event_id", "value")
    kept.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/rows").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


query("feed_days", lambda spark, d: _feed(spark, d, "events", at="ts").groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")),
    "select cast(ts as date) as date, event_type, count(*) as n, round(sum(value), 6) + 0.0 as total from events group by all")
query("feed_ranges", lambda spark, d: _feed(spark, d, "orders", at="o_orderdate", grain="range", span="180", by="o_orderpriority", keys='["1-URGENT", "2-HIGH", "5-LOW"]').groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most")),
    "select o_orderpriority, extract(year from o_orderdate) as year, count(*) as n, round(max(o_totalprice), 6) + 0.0 as most from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW') group by all")
query("feed_snapshot", lambda spark, d: _feed(spark, d, "supplier", grain="snapshot").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "select s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, round(s_acctbal, 6) + 0.0 as s_acctbal from supplier")
query("feed_stream", _stream, "select cast(ts as date) as date, count(*) as n, round(sum(value), 6) + 0.0 as total from events where event_type <> 'error' group by 1")
