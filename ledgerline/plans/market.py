"""Queries of cost distributions, order statistics, as-of joins and the universe builder. The SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import dealt, div, frame
from ledgerline.operators import panel, universe
from ledgerline.operators.asof import asof
from ledgerline.operators.codewise import Rolling, cost_distribution, cost_factors, entropy_of, euclidean, rolling
from ledgerline.plans.catalogue import B, calendar, query, r, snapshots, sup, usr
from ledgerline.plans.catalogue import _CAL, _SNAP, U
from ledgerline.plans.upkeep import _LISTED, listings, read
from ledgerline.sources import bars

# -- costs -----------------------------------------------------------------------------------------------------------------
_TURN = "volume / (volume + 37.3D + code % 7)"
_COSTS = ("winner_rate", "weight_avg", "cost_5pct", "cost_15pct", "cost_50pct", "cost_85pct", "cost_95pct")
# sums of weights over years differ in the last digits; widths of 0 give numbers around 1e13, which the query leaves out
query("chip_costs", lambda spark, d: cost_factors(cost_distribution(sup(spark, d).withColumn("turn", F.expr(_TURN)))).selectExpr("code", "date", "round(winner_rate, 4) as winner_rate", "round(weight_avg, 2) as weight_avg", *_COSTS[2:], "round(case when cost_95pct > cost_5pct then cost_position end, 4) as cost_position", "chip_dispersion", "round(case when cost_85pct > cost_15pct then chip_skew end, 4) as chip_skew"),
      f"""with {B}, t as (select code, date, close, {_TURN} as turn, sum(ln(1 - {_TURN})) over (partition by code order by date) as l from b),
      p as (select n.code, n.date, n.close as now, s.close as p, s.turn * exp(n.l - s.l) as w from t n join t s on s.code = n.code and s.date <= n.date),
      c as (select *, sum(w) over (partition by code, date order by p range between unbounded preceding and current row) as upto, sum(w) over (partition by code, date) as total from p),
      q as (select code, date, sum(w) filter (where p <= now) / sum(w) as winner_rate, sum(w * p) / sum(w) as weight_avg, {', '.join(f"min(p) filter (where upto >= {s}e0 * total) as cost_{k}pct" for s, k in ((0.05, 5), (0.15, 15), (0.5, 50), (0.85, 85), (0.95, 95)))} from c group by code, date)
      select code, date, round(winner_rate, 4) + 0.0 as winner_rate, round(weight_avg, 2) + 0.0 as weight_avg, {r(*_COSTS[2:])}, round(case when cost_95pct > cost_5pct then (cost_50pct - weight_avg) / (cost_95pct - cost_5pct + 1e-10) end, 4) + 0.0 as cost_position, round((cost_85pct - cost_15pct) / (cost_50pct + 1e-10), 6) + 0.0 as chip_dispersion,
             round(case when cost_85pct > cost_15pct then (cost_50pct - weight_avg) / (cost_85pct - cost_15pct + 1e-10) end, 4) + 0.0 as chip_skew from q""")  # fmt: skip

# -- order statistics ------------------------------------------------------------------------------------------------------
_W5 = "over (partition by code order by date rows between 4 preceding and current row)"
_SPECS = [Rolling("ts_percentile_252", "mean_5d", 252, "rank", least=60), Rolling("ts_rank_32", "close", 32, "rank"), Rolling("median_60", "close", 60, "quantile", 0.5), Rolling("quantile_60", "close", 60, "quantile", 0.8, 20)]
query("rolling_orders", lambda spark, d: rolling(sup(spark, d).select("code", "date", "close", F.expr(f"case when count(volume) {_W5} = 5 then avg(volume) {_W5} end").alias("mean_5d")), _SPECS).select("code", "date", *(s.name for s in _SPECS)),
      f"""with {B}, m as (select code, date, close, case when count(volume) {_W5} = 5 then avg(volume) {_W5} end as mean_5d from b),
      l as (select *, list(mean_5d) over (partition by code order by date rows 251 preceding) as a, list(close) over (partition by code order by date rows 31 preceding) as c, list(close) over (partition by code order by date rows 59 preceding) as e from m)
      select code, date, round(case when mean_5d is not null and len(list_filter(a, lambda x: x is not null)) >= 60 then len(list_filter(a, lambda x: x <= mean_5d)) / len(list_filter(a, lambda x: x is not null)) end, 6) + 0.0 as ts_percentile_252,
             round(case when len(c) = 32 then len(list_filter(c, lambda x: x <= close)) / 32.0e0 end, 6) + 0.0 as ts_rank_32, round(case when len(e) = 60 then list_median(e) end, 6) + 0.0 as median_60,
             round(case when len(e) >= 20 then list_aggregate(e, 'quantile_cont', 0.8) end, 6) + 0.0 as quantile_60 from l""")  # fmt: skip


def _moments(spark: SparkSession, d: str) -> DataFrame:
    """Excess kurtosis of the volume over 60 rows, entropy of how often the bar opened higher, alike or lower over 60 rows, and how far a bar is from the
    middle of its day in three measures."""
    w, day, so_far = panel.over(60), Window.partitionBy("date"), panel.by_code().rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("open") / F.lag("close").over(panel.by_code()) - 1
    counted = {"n": F.col("gap").isNotNull(), "up": F.col("gap") > 0.05, "down": F.col("gap") < -0.05, "same": F.abs("gap") <= 0.05}
    b = sup(spark, d).withColumns({"gap": gap, "range": F.expr(div("high - low", "close"))})
    b = b.withColumns({k: F.count(F.when(c, 1)).over(so_far) for k, c in counted.items()})
    b = b.withColumns({k: F.col(k) - F.coalesce(F.lag(k, 60).over(panel.by_code()), F.lit(0)) for k in counted})  # whole numbers: exact
    b = b.withColumn("ts_kurt_60", F.when(F.count("volume").over(w) == 60, F.round(F.kurtosis("volume").over(w), 3)))
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(day), F.stddev_samp(c).over(day))
    s = dealt(b.select("code", "date", "volume", "close", "range", "ts_kurt_60", *(F.when(F.col("n") == 60, F.col(k) / 60).alias(k) for k in ("up", "same", "down"))), "date", bars.parts(spark, d))
    return s.select("code", "date", "ts_kurt_60", entropy_of([F.col(c) for c in ("up", "same", "down")]).alias("gap_entropy_60"), (-euclidean([z("volume"), z("close"), z("range")])).alias("normality"))


_K = "avg(pow(volume, {0})) over w"
query("rolling_moments", _moments,
      f"""with {B}, g as (select *, open / nullif(lag(close) over (partition by code order by date), 0) - 1 as gap, (high - low) / nullif(close, 0) as rng from b),
      f as (select *, count(gap) over w as n, count(*) over w as k, count(*) filter (where gap > 0.05) over w / 60.0e0 as up, count(*) filter (where gap < -0.05) over w / 60.0e0 as down, count(*) filter (where abs(gap) <= 0.05) over w / 60.0e0 as same,
                   list(volume) over w as v, avg(volume) over w as m, (volume - avg(volume) over (partition by date)) / nullif(stddev_samp(volume) over (partition by date), 0) as z1,
                   (close - avg(close) over (partition by date)) / nullif(stddev_samp(close) over (partition by date), 0) as z2, (rng - avg(rng) over (partition by date)) / nullif(stddev_samp(rng) over (partition by date), 0) as z3
            from g window w as (partition by code order by date rows 59 preceding))
      select code, date, round(case when k = 60 then list_avg(list_transform(v, lambda x: pow(x - m, 4))) / nullif(pow(list_avg(list_transform(v, lambda x: pow(x - m, 2))), 2), 0) - 3 end, 3) + 0.0 as ts_kurt_60,
             round(case when n = 60 then -(case when up > 0 then up * ln(up) else 0 end + case when down > 0 then down * ln(down) else 0 end + case when same > 0 then same * ln(same) else 0 end) end, 6) + 0.0 as gap_entropy_60,
             round(-sqrt(z1 * z1 + z2 * z2 + z3 * z3), 6) + 0.0 as normality from f""")  # fmt: skip

# -- as-of joins -----------------------------------------------------------------------------------------------------------
_ev = lambda spark, d: read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's last purchase before it."""
    bought = _ev(spark, d).filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("paid"))
    return asof(_ev(spark, d), bought, ["user_id"], "ts", ["purchase_id", "paid"], strict=True, bucket=F.weekofyear("ts")).select("event_id", "purchase_id", "paid")


query("asof_purchases", _purchases, "select e.event_id, p.event_id as purchase_id, round(p.value, 6) + 0.0 as paid from events e asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts > p.ts")


def _busy(spark: SparkSession, d: str) -> DataFrame:
    """Each bar with its code's next busy bar, if that is at most 30 days ahead."""
    b = sup(spark, d).select("code", "date", "close", "volume")
    busy = b.filter("volume >= 60").select("code", "date", F.col("date").alias("busy"), F.col("close").alias("busy_close"))
    return asof(b.drop("volume"), busy, ["code"], "date", ["busy", "busy_close"], "forward", F.datediff("_on", "date") <= 30)


query("asof_busy_bars", _busy,
      f"with {B}, q as (select code, date as busy, close as busy_close from b where volume >= 60), j as (select b.code, b.date, b.close, q.busy, q.busy_close from b asof left join q on b.code = q.code and b.date <= q.busy) select code, date, {r('close')}, case when busy - date <= 30 then busy end as busy, round(case when busy - date <= 30 then busy_close end, 6) + 0.0 as busy_close from j")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Bars of members: the snapshot in force on a date is looked up once a date, then codes are compared for equality."""
    s = snapshots(spark, d)
    eff = s.select(F.col("effective_date").alias("date")).distinct().withColumn("effective_date", F.col("date"))
    dates = asof(sup(spark, d).select("date").distinct(), eff, [], "date", ["effective_date"])
    return sup(spark, d).select("code", "date", "close").join(dates, "date").join(s, ["effective_date", "code"], "left_semi").select("code", "date", "close", "effective_date")


query("asof_members", _members,
      f"with {B}, {_SNAP}, i as (select distinct effective_date as eff from s), j as (select eff, lead(eff) over (order by eff) as nx from i) select b.code, b.date, {r('b.close')}, j.eff as effective_date from b join j on b.date >= eff and (nx is null or b.date < nx) join s on s.effective_date = j.eff and s.code = b.code")

# -- the universe ------------------------------------------------------------------------------------------------------------
_RULES = universe.Universe(board="board 1", prefixes=("00000000", "00000005"), low=0.001, high=0.08, base_year=2002, ratio=11 / 20, years=11.0, seasoned=252, per_unit=10000)
_basics = lambda spark, d: sup(spark, d).select("code", "date", F.expr("volume * 10").alias("size"))
_info = lambda spark, d: listings(spark, d).select("code", "market", F.substring("name", 10, 9).alias("mark"), "list_date")
query("universe_snapshots", lambda spark, d: universe.build_snapshots(calendar(spark, d), _basics(spark, d), _info(spark, d), _RULES, 1996),
      f"""with {B}, {_CAL}, {_LISTED}, z as (select code, date, volume * 10 as size from b),
      e as (select cast(date_trunc('month', date) as date) as m, min(date) as eff from c where extract(month from date) in (6, 12) and extract(year from date) >= 1996 group by 1),
      t as (select m, eff, (select max(date) from c where cast(date_trunc('month', c.date) as date) = cast(e.m - interval 1 month as date)) as cut from e),
      y as (select eff, cut, extract(year from cut) + (extract(doy from cut) - 1) / (case when date_part('day', make_date(extract(year from cut), 2, 1) + interval 1 month - interval 1 day) = 29 then 366.0e0 else 365.0e0 end) as y from t where cut is not null),
      f as (select eff, cut, pow(11.0e0 / 20, greatest(0, 2002 - y) / 11.0e0) as f from y)
      select distinct eff as effective_date, cut as cutoff_date, z.code from f join z on z.date = f.cut join li on li.code = z.code
      where coalesce(market, case when name like 'Supplier#00000000%' or name like 'Supplier#00000005%' then 'board 1' end) = 'board 1' and size > round(0.001e0 * f * 10000, 0) and size < round(0.08e0 * f * 10000, 0) and list_date is not null
            and (select count(*) from c where date > list_date and date <= cut) >= 252""")  # fmt: skip
