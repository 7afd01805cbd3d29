"""Queries of the daily run. The SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import div, lag, roll
from ledgerline.operators import panel, serving
from ledgerline.plans.catalogue import _TAIL, B, U, _scte, _slast, query, r, scored, sup, usr
from ledgerline.plans.upkeep import _BYC, _D, _GONE, delisted, masks, read

_TODAY = "2024-01-25"
_SOURCES = {"click": "trading", "view": "calendar", "purchase": "event", "error": "trading"}


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").filter("value > 100").select(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("date"))


query("fetch_dates", lambda spark, d: serving.fetch_dates(usr(spark, d), _pending(spark, d), _D(_TODAY), _SOURCES),
      f"""with {U}, o as (select distinct date from b where date <= date '{_TODAY}' order by date desc limit 5),
      p as (select event_type as source, cast(ts as date) as date from events where value > 100 and event_type in ('click', 'error', 'view') and cast(ts as date) <= date '{_TODAY}')
      select source, date from (values ('click'), ('error')) s(source), o union select 'view', date '{_TODAY}' - cast(k as integer) from range(7) g(k) union select source, date from p""")  # fmt: skip
query("announced_rows", lambda spark, d: serving.announced(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("at")), "at", _D("1997-03-31")),
      "select o_orderkey as id, cast(o_orderdate as date) as at from orders where cast(o_orderdate as date) between date '1997-03-31' - 90 and date '1997-03-31'")
query("with_factor", lambda spark, d: serving.with_factor(sup(spark, d).select("code", "date", "close"), sup(spark, d).filter("day(date) % 9 > 0").select("code", "date", (1 + F.col("code") % 4 / 2).alias("adj_factor"))),
      f"with {B} select code, date, {r('close')}, case when extract(day from date) % 9 > 0 then 1 + (code % 4) / 2.0e0 end as adj_factor from b")
query("unknown_codes", lambda spark, d: serving.unknown_codes(usr(spark, d), read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"))),
      f"with {U} select distinct code from b where code not in (select s_suppkey from supplier)")

_AGAIN = [{"return_5d": f"{div('close', lag('close', 5))} - 1", "mean_20d": roll("avg", "close", 20, 20)}]
_DAYS = "select distinct date from b order by date desc limit 15"
query("recomputed", lambda spark, d: serving.recomputed(sup(spark, d), sup(spark, d).select("date").distinct().orderBy(F.desc("date")).limit(15), 260, _AGAIN, ["return_5d", "mean_20d"]),
      f"""with {B}, t as ({_DAYS}), a as (select min(date) as a from (select distinct date from b where date <= (select min(date) from t) order by date desc limit 260)),
      x as (select code, date, close / nullif(lag(close, 5) {_BYC}, 0) - 1 as return_5d, case when count(close) over w = 20 then avg(close) over w end as mean_20d from b where date >= (select a from a) window w as (partition by code order by date rows 19 preceding))
      select code, date, {r('return_5d', 'mean_20d')} from x where date in (select date from t)""")  # fmt: skip

query("live_scores", lambda spark, d: serving.live_scores(scored(spark, d).filter("date >= date '2024-01-20'").select("code", "date", "score"), panel.calibration(scored(spark, d), "score", "label", _D("2024-12-31"))),
      f"{_scte}, {_TAIL.format(s=_slast)} select code, date, round(score * slope, 6) + 0.0 as score from {_slast}, z where date >= date '2024-01-20'")
query("aligned_masks", lambda spark, d: serving.aligned(scored(spark, d).select("code", "date", "score"), masks(spark, d), ["limited", "is_st"]),
      f"{_scte} select code, date, {r('score')}, extract(day from date) % 3 > 0 and code % 7 = 0 as limited, extract(day from date) % 3 > 0 and code % 5 = 0 as is_st from {_slast}")
_held = lambda spark, d: usr(spark, d).filter("(code + day(date)) % 4 = 0")
query("candidates", lambda spark, d: serving.candidates(scored(spark, d), _held(spark, d), masks(spark, d), delisted(spark, d), 10).select("date", "rank", "code", "score"),
      f"""{_scte}, {_GONE}, q as (select s.code, date, score from {_slast} s left join de using (code) where (delist_date is null or delist_date > date) and (s.code + extract(day from date)) % 4 <> 0 and not (extract(day from date) % 3 > 0 and s.code % 5 = 0) and score is not null),
      k as (select *, row_number() over (partition by date order by score desc, code) as rank from q) select date, rank, code, {r('score')} from k where rank <= 10""")  # fmt: skip


def _parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s = scored(spark, d).select("code", "date", "score")
    return {"a": s, "b": s.filter("day(date) % 2 = 0"), "c": s.filter("day(date) % 3 = 0")}


query("day_levels", lambda spark, d: serving.day_levels(_parts(spark, d)),
      f"{_scte}, q as (select date, 1 + (extract(day from date) % 2 = 0)::integer + (extract(day from date) % 3 = 0)::integer as n_parts from {_slast} where score is not null group by date) select date, cast(n_parts as bigint) as n_parts, case when n_parts = 3 then 'full' else 'partial' end as level from q")
query("target_date", lambda spark, d: serving.target_date([p.filter("date < date '2024-01-28'") for p in _parts(spark, d).values()], usr(spark, d)),
      f"with {U} select max(date) as target, case when max(date) < date '2024-01-28' then 'stored' else 'live' end as level from b")
