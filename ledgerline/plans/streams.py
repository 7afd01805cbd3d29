"""Queries that run a stream over a table to its end and return what it keeps. The SQL is written apart from the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import div, lag, roll
from ledgerline.plans.catalogue import B, query, r, sup
from ledgerline.streaming.ingest import MONTH, closed_days, read_table, recompute_stream, upsert_stream
from ledgerline.streaming.retries import OUTPUT, retry_stream
from ledgerline.streaming.table import Table


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one; a session on one machine may have none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The table of events as a stream: a stream reads folders, so the file is picked from its folder by its whole name."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _streamed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Each user's last event of a day by an upsert of the stream of events; values under 10 are dead."""
    folder = _folder(spark)
    stream = _events(spark, d)
    rows = stream.select("user_id", F.to_date("ts").alias("date"), "ts", "event_id", "value")
    upsert_stream(rows, f"{folder}/table", ["user_id", "date"], "date", ["ts", "event_id"], f"{folder}/log", F.col("value") >= 10, f"{folder}/dead").awaitTermination()
    return read_table(spark, f"{folder}/table", rows.schema, "date").drop(MONTH), f"{folder}/dead"


def _dead(spark: SparkSession, d: str) -> DataFrame:
    table, dead = _streamed(spark, d)
    kept = table.groupBy("date").agg(F.count(F.lit(1)).alias("n_kept"))
    lost = spark.read.schema(table.schema).parquet(dead).groupBy("date").agg(F.count(F.lit(1)).alias("n_dead"))
    both = kept.join(lost, "date", "full")
    return both.select("date", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("n_dead", F.lit(0)).alias("n_dead"))


query("stream_upsert", lambda spark, d: _streamed(spark, d)[0].select("user_id", "date", "event_id", "value"),
    "select user_id, date, event_id, round(value, 6) + 0.0 as value from (select user_id, cast(ts as date) as date, event_id, value, row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as k from events where value >= 10 and ts is not null) where k = 1")
query("stream_dead_letters", _dead,
    "select cast(ts as date) as date, count(distinct case when value >= 10 then user_id end) as n_kept, count(case when value < 10 or value is null then 1 end) as n_dead from events where ts is not null group by 1")


# -- retries with deadlines ------------------------------------------------------------------------------------------------
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _retries(spark: SparkSession, d: str) -> DataFrame:
    """Events as outcomes of fetches: a type is a source, values from 60 on are good."""
    folder, key = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    outcomes = _events(spark, d).select(F.col("event_type").alias("source"), F.to_date("ts").alias("date"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at"), (F.col("value") >= 60).alias("ok"))
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKSDB)
    try:
        retry_stream(outcomes).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(OUTPUT).parquet(f"{folder}/rows").select("source", "date", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("fired_at"), "attempts")


query("stream_retries", _retries,
    """with o as (select event_type as source, cast(ts as date) as date, date_trunc('millisecond', ts) as t_at, coalesce(value >= 60, false) as ok from events where ts is not null),
g as (select *, lead(t_at) over w as next_at, row_number() over w as n, coalesce(sum(case when ok then 1 else 0 end) over (partition by source, date order by t_at, ok rows between unbounded preceding and 1 preceding), 0) as streak
      from o window w as (partition by source, date order by t_at, ok)),
f as (select *, row_number() over (partition by source, date, streak order by n) as k, date + interval 21 hour as deadline from g),
due as (select source, date, k, deadline, unnest(list_append(list_filter(list_transform(range(1, 8), lambda j: t_at + j * interval 30 minute), lambda t: t < deadline), deadline)) as t_at, least(coalesce(next_at, deadline), (select max(t_at) from o)) as until
        from f where not ok and k < 5 and t_at >= date + interval 17 hour and t_at < deadline),
fired as (select * from due where t_at <= until)
select source, date, kind, strftime(t_at, '%Y-%m-%d %H:%M:%S.') || right(strftime(t_at, '%f'), 6)[1:3] as fired_at, attempts from (
    select source, date, 'failed' as kind, t_at, k as attempts from f where not ok
    union all select source, date, 'cleared', t_at, k - 1 from f where ok and k > 1
    union all select source, date, 'dead', t_at, k from f where not ok and k = 5
    union all select source, date, 'retry', t_at, k from fired
    union all select source, date, 'left', t_at, k from fired where t_at = deadline)""")  # fmt: skip


# -- days that are closed, and what has changed ------------------------------------------------------------------------------
def _closed(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    days = closed_days(_events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "ts", ["event_type"], "value", "36 hours")
    days.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{folder}/rows")


query("stream_closed_days", _closed,
    "with e as (select cast(ts as date) as date, event_type, value, max(ts) over () as high from events) select date, event_type, count(*) as n, round(sum(value), 6) + 0.0 as total from e where date + interval 1 day <= high - interval 36 hour group by all")

_AGAIN = [{"return_5d": f"{div('close', lag('close', 5))} - 1", "mean_20d": roll("avg", "close", 20, 20)}]
_BARS = "code long, date date, close double"


def _again(spark: SparkSession, d: str) -> DataFrame:
    """Supplier bars come in as two batches of files, those of the last year second, when the stream goes on from its checkpoint; what it has computed is the
    whole table."""
    folder = _folder(spark)
    rows = sup(spark, d).select("code", "date", "close")
    schema = rows.schema
    history, out = (Table(spark, f"{folder}/{n}", s, ["code", "date"], "date", []) for n, s in (("history", schema), ("out", staged_schema(spark))))
    for k, part in enumerate(("date < date '2001-01-01'", "date >= date '2001-01-01'")):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in/part={k}")
        changes = spark.readStream.schema(schema).parquet(f"{folder}/in/part=*")
        recompute_stream(changes, history, out, 260, _AGAIN, ["return_5d", "mean_20d"], f"{folder}/log").awaitTermination()
    return out.read().drop(MONTH)


def staged_schema(spark: SparkSession):  # noqa: ANN201
    return spark.createDataFrame([], "code long, date date, return_5d double, mean_20d double").schema


_BYC = "over (partition by code order by date)"
query("stream_recomputed", _again,
    f"""with {B}, x as (select code, date, close / nullif(lag(close, 5) {_BYC}, 0) - 1 as return_5d, case when count(close) over w = 20 then avg(close) over w end as mean_20d from b window w as (partition by code order by date rows 19 preceding))
    select code, date, {r('return_5d', 'mean_20d')} from x""")  # fmt: skip
