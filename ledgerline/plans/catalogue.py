"""All queries over the driver's tables, with the same in DuckDB's SQL. Doubles are rounded on both sides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import ewm, frame, mean_rank, shrunk_corr, staged
from ledgerline.operators import alphas, factors, grids, panel
from ledgerline.sources import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
B, U = f"b as ({bars.SUPPLIER_SQL})", f"b as ({bars.USER_SQL})"
DIGITS = 6


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*((F.round(c, DIGITS) + F.lit(0.0)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in rows.dtypes))


def duck(text: str) -> str:
    """Double literals as DuckDB writes them."""
    return re.sub(r"\b(\d+\.\d+)D\b", r"\1e0", text)


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE_SQL[name] = duck(sql)


def r(*names: str) -> str:
    """Rounded columns in SQL."""
    return ", ".join(f"round({n}, {DIGITS}) + 0.0 as {n.split('.')[-1]}" for n in names)


def chain(stages: list[dict[str, str]], base: str = B, last: str = "b") -> tuple[str, str]:
    """CTEs that add the stages one by one, and the name of the last."""
    parts = [base]
    for k, stage in enumerate(stages):
        parts.append(f"s{k} as (select *, {', '.join(f'{e} as {n}' for n, e in stage.items())} from {last})")
        last = f"s{k}"
    return "with " + ", ".join(parts), last


def sup(spark: SparkSession, d: str) -> DataFrame:
    return bars.supplier_bars(spark, d)


def usr(spark: SparkSession, d: str) -> DataFrame:
    return bars.user_bars(spark, d)


OHLC = ("open", "high", "low", "close", "volume", "amount")
query("bars_supplier", sup, f"with {B} select code, date, {r(*OHLC)} from b")
query("bars_user", usr, f"with {U} select code, date, {r(*OHLC)} from b")


# -- the formula catalogue -------------------------------------------------------------------------------------------
def _factor(group: str) -> None:
    """Mean amounts as logarithms: means of cents over powers of two lie on the borders of rounding."""
    stages, portable, out = factors.stages_of(group), factors.stages_of(group, True), factors.emitted(group)
    if means := [c for c in out if c.startswith("avg_amount")]:
        logs = {f"ln_{c}": f"ln({c})" for c in means}
        stages, portable, out = [*stages, logs], [*portable, logs], [f"ln_{c}" if c in means else c for c in out]
    cte, last = chain(portable)
    query(f"factor_{group}", lambda spark, d: staged(sup(spark, d), stages, bars.parts(spark, d)).select("code", "date", *out), f"{cte} select code, date, {r(*out)} from {last}")


for _group in factors.GROUPS:
    _factor(_group)

_SKEW = "case when count({x}) {f} >= 5 then (avg(pow({x}, 3)) {f} - 3 * avg({x}) {f} * avg({x} * {x}) {f} + 2 * pow(avg({x}) {f}, 3)) / nullif(pow(greatest(avg({x} * {x}) {f} - pow(avg({x}) {f}, 2), 0), 1.5), 0) end"
_cte, _last = chain([factors.FIRST, factors.BASE])
query("factor_skew", lambda spark, d: staged(sup(spark, d), [factors.FIRST, factors.BASE]).selectExpr("code", "date", f"round(case when count(r1) {frame(20)} >= 5 then skewness(r1) {frame(20)} end, 3) as return_skew_20d", f"round(case when count(iret) {frame(60)} >= 5 then skewness(iret) {frame(60)} end, 3) as intraday_skew_60d"),
      f"{_cte} select code, date, round({_SKEW.format(x='r1', f=frame(20))}, 3) as return_skew_20d, round({_SKEW.format(x='iret', f=frame(60))}, 3) as intraday_skew_60d from {_last}")


def _macd(spark: SparkSession, d: str) -> DataFrame:
    dif = ewm(ewm(usr(spark, d).select("code", "date", "close"), "close", 12, "fast"), "close", 26, "slow").withColumn("dif", F.col("fast") - F.col("slow"))
    return ewm(dif, "dif", 9, "signal").select("code", "date", F.try_divide(F.col("dif") - F.col("signal"), "close").alias("macd_hist_pct"))


def _ewm_sql(x: str, span: int, to: str, source: str) -> str:
    k = 1 - 2 / (span + 1)
    return f"(select a.code, a.date, sum(b.{x} * pow({k!r}, a.n - b.n)) / sum(pow({k!r}, a.n - b.n)) as {to} from {source} a join {source} b on a.code = b.code and b.n <= a.n group by all)"


query("factor_macd", _macd, f"with {U}, n as (select *, row_number() over (partition by code order by date) as n from b), e12 as {_ewm_sql('close', 12, 'e12', 'n')}, e26 as {_ewm_sql('close', 26, 'e26', 'n')}, d as (select n.*, e12 - e26 as dif from n join e12 using (code, date) join e26 using (code, date)), e9 as {_ewm_sql('dif', 9, 'e9', 'd')} select code, date, round((dif - e9) / nullif(close, 0), 6) + 0.0 as macd_hist_pct from d join e9 using (code, date)")

# -- adjusted bars ---------------------------------------------------------------------------------------------------
_FACTOR = "case when code % 7 = 0 and extract(month from date) = 2 then null else 1 + (extract(year from date) - 1995) * 0.1D end"
raw = lambda spark, d: sup(spark, d).withColumn("adj_factor", F.expr(_FACTOR).cast("double"))
query("adj_kline", lambda spark, d: bars.adjusted(raw(spark, d)).select("code", "date", "open", "high", "low", "close", "volume"),
      f"with {B}, f as (select *, cast({_FACTOR} as double) as a from b), m as (select code, arg_max(a, date) as base from f where a > 0 group by code) select code, date, round(open * a / base, 6) + 0.0 as open, round(high * a / base, 6) + 0.0 as high, round(low * a / base, 6) + 0.0 as low, round(close * a / base, 6) + 0.0 as close, {r('volume')} from f left join m using (code)")
query("gap_target", lambda spark, d: bars.back_adjusted(raw(spark, d)).select("code", "date", (F.try_divide(F.lead("open").over(panel.by_code()), "close") - 1).alias("gap_target")),
      f"with {B}, f as (select *, cast({_FACTOR} as double) as a from b) select code, date, round(lead(open * a) over (partition by code order by date) / nullif(close * a, 0) - 1, 6) + 0.0 as gap_target from f")

# -- market, calendar and status -------------------------------------------------------------------------------------
_INDEX = "select date, avg(close) as close from b group by date"
_O = "over (order by date)"


def _market(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("date")
    m = sup(spark, d).groupBy("date").agg(F.avg("close").alias("close"))  # one row a date
    lagged = lambda n: F.try_divide("close", F.lag("close", n).over(w)) - 1
    m = m.withColumns({"return_1d": lagged(1), "return_20d": lagged(20), "return_252d": lagged(252)}).withColumn("volatility_20d", F.stddev_samp("return_20d").over(w.rowsBetween(-19, 0)))
    return sup(spark, d).select("code", "date").join(m.drop("close"), "date").select("code", "date", "return_1d", "return_20d", "return_252d", "volatility_20d")


query("index_features", _market, f"with {B}, m as ({_INDEX}), x as (select date, close / lag(close, 1) {_O} - 1 as return_1d, close / lag(close, 20) {_O} - 1 as return_20d, close / lag(close, 252) {_O} - 1 as return_252d from m), v as (select *, stddev_samp(return_20d) over (order by date rows between 19 preceding and current row) as volatility_20d from x) select code, date, {r('return_1d', 'return_20d', 'return_252d', 'volatility_20d')} from b join v using (date)")
query("size_spread", lambda spark, d: (lambda m: m.select("date", (F.try_divide("s", F.lag("s", 20).over(Window.orderBy("date"))) - F.try_divide("l", F.lag("l", 20).over(Window.orderBy("date")))).alias("size_spread_20d")))(sup(spark, d).groupBy("date").agg(F.avg(F.when(F.col("code") % 2 == 0, F.col("close"))).alias("s"), F.avg(F.when(F.col("code") % 2 == 1, F.col("close"))).alias("l"))),
      f"with {B}, m as (select date, avg(close) filter (where code % 2 = 0) as s, avg(close) filter (where code % 2 = 1) as l from b group by date) select date, round(s / lag(s, 20) {_O} - l / lag(l, 20) {_O}, 6) + 0.0 as size_spread_20d from m")


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("date")).distinct().filter(F.dayofweek("date").between(2, 6))


_CAL = "c as (select distinct cast(l_shipdate as date) as date from lineitem where dayofweek(cast(l_shipdate as date)) between 1 and 5)"


def _calendar_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days to the next open day, and calendar days until the next third Friday rolled forward to an open day."""
    c, w = calendar(spark, d), Window.orderBy("date")
    third = c.select(F.year("date").alias("y")).distinct().select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"), "y").select(F.make_date("y", "m", F.lit(1)).alias("m")).select(F.expr("date_add(m, (6 - dayofweek(m) + 7) % 7 + 14)").alias("date"))
    # on one axis of open days and third Fridays, an open day is a delivery if a third Friday lies after the open day before it, up to it
    axis = c.withColumn("open", F.lit(True)).unionByName(third.withColumn("open", F.lit(False))).groupBy("date").agg(F.max("open").alias("open"), F.count(F.when(~F.col("open"), 1)).alias("fridays"))
    so_far = F.sum("fridays").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = axis.withColumn("k", so_far).filter("open").withColumn("delivery", F.col("k") > F.coalesce(F.lag("k").over(w), F.lit(0)))
    nxt = F.min(F.when(F.col("delivery"), F.col("date"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    return n.select("date", (F.datediff(F.lead("date").over(w), "date") - 1).cast("long").alias("days_to_next_trading"), F.datediff(nxt, "date").cast("long").alias("days_to_delivery"))


query("calendar_gaps_ahead", _calendar_gaps, f"with {_CAL}, m as (select distinct make_date(extract(year from date), k, 1) as m from c, range(1, 13) t(k)), f as (select m + cast((5 - dayofweek(m) + 7) % 7 + 14 as integer) as f from m), r as (select distinct (select min(date) from c where date >= f) as date from f) select date, date_diff('day', date, lead(date) over (order by date)) - 1 as days_to_next_trading, date_diff('day', date, (select min(r.date) from r where r.date >= c.date)) as days_to_delivery from c")


def st_events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.filter("event_type in ('error', 'signup')").select(F.col("user_id").alias("code"), F.to_date("ts").alias("start_date"), F.when(F.col("event_type") == "error", "open").otherwise("lift").alias("kind")).distinct()


def _st(spark: SparkSession, d: str) -> DataFrame:
    """1 on days inside [open, end): the earliest lift on or after the opening, or the next opening. Joined on code, so each
    code's few intervals meet only its own days."""
    e = st_events(spark, d)
    # a lift of the same day is one on or after the opening; an opening of the same day isn't the next
    later = lambda least: Window.partitionBy("code").orderBy(F.datediff("start_date", F.lit("1970-01-01").cast("date"))).rangeBetween(least, Window.unboundedFollowing)
    only = lambda kind: F.when(F.col("kind") == kind, F.col("start_date"))
    both = e.withColumns({"next_open": F.min(only("open")).over(later(1)), "lift": F.min(only("lift")).over(later(0))})
    spans = both.filter("kind = 'open'").withColumn("end", F.coalesce(F.least("next_open", "lift"), F.lit("9999-12-31").cast("date")))
    inside = [F.col("b.code") == F.col("s.code"), F.col("b.date") >= F.col("s.start_date"), F.col("b.date") < F.col("s.end")]
    hit = usr(spark, d).alias("b").join(spans.alias("s"), inside).select("b.code", "b.date").distinct().withColumn("is_st", F.lit(1).cast("long"))
    return usr(spark, d).select("code", "date").join(hit, ["code", "date"], "left").withColumn("is_st", F.coalesce("is_st", F.lit(0).cast("long")))


query("st_intervals", _st, f"with {U}, e as (select distinct user_id as code, cast(ts as date) as start_date, case when event_type = 'error' then 'open' else 'lift' end as kind from events where event_type in ('error', 'signup')), o as (select *, lead(start_date) over (partition by code order by start_date) as nx from e where kind = 'open'), s as (select o.*, coalesce(least(nx, (select min(r.start_date) from e r where r.kind = 'lift' and r.code = o.code and r.start_date >= o.start_date)), date '9999-12-31') as fin from o) select code, date, cast(case when exists (select 1 from s where s.code = b.code and b.date >= s.start_date and b.date < s.fin) then 1 else 0 end as bigint) as is_st from b")

# -- formula vocabulary ------------------------------------------------------------------------------------------------
_BYD, _BYC = "over (partition by date)", "over (partition by code order by date)"
query("xs_neutral_scale_zscore", lambda spark, d: usr(spark, d).withColumn("g", F.col("code") % 5).select("code", "date", panel.neutral("close", "g").alias("neutral"), panel.scaled("close").alias("scaled"), panel.zscore("close").alias("zscore"), panel.residual("close", "amount").alias("residual")),
      f"with {U} select code, date, round(close - avg(close) over (partition by date, code % 5), 6) + 0.0 as neutral, round(close / nullif(sum(abs(close)) {_BYD}, 0), 6) + 0.0 as scaled, round((close - avg(close) {_BYD}) / nullif(stddev_samp(close) {_BYD}, 0), 6) + 0.0 as zscore, round(close - (regr_intercept(close, amount) {_BYD} + regr_slope(close, amount) {_BYD} * amount), 6) + 0.0 as residual from b")
query("ts_rank_argmax", lambda spark, d: usr(spark, d).select("code", "date", panel.ts_rank("close", 5).alias("ts_rank_5"), panel.ts_argmax("close", 5).alias("ts_argmax_5"), F.max("close").over(panel.over(5)).alias("ts_max_5"), F.min("close").over(panel.over(5)).alias("ts_min_5")),
      f"with {U}, l as (select code, date, close, list(close) {frame(5)} as l, arg_max(date, row(close, date)) {frame(5)} as m from b) select code, date, round(case when len(l) = 5 then len(list_filter(l, lambda x: x <= close)) / 5.0D end, 6) + 0.0 as ts_rank_5, case when len(l) = 5 then m end as ts_argmax_5, round(list_max(l), 6) + 0.0 as ts_max_5, round(list_min(l), 6) + 0.0 as ts_min_5 from l")
_DECAY = " + ".join(f"{5 - k} * lag(close, {k}) {_BYC}" for k in range(5))
query("decay_linear_delta", lambda spark, d: usr(spark, d).selectExpr("code", "date", f"({_DECAY}) / 15.0D as decay_5", f"close - lag(close, 2) {_BYC} as delta_2", "sign(close - open) * pow(abs(close - open), 0.5D) as signedpower"),
      f"with {U} select code, date, round(({_DECAY}) / 15.0D, 6) + 0.0 as decay_5, round(close - lag(close, 2) {_BYC}, 6) + 0.0 as delta_2, round(sign(close - open) * pow(abs(close - open), 0.5D), 6) + 0.0 as signedpower from b")
query("streaks_and_days_since", lambda spark, d: panel.longest_run(usr(spark, d).withColumn("rise", F.coalesce(F.col("close") > F.lag("close").over(panel.by_code()), F.lit(False))), F.col("rise"), "run").select("code", "date", F.col("run").cast("long").alias("run"), panel.days_since(F.col("rise")).alias("days_since_rise")),
      f"with {U}, x as (select *, coalesce(close > lag(close) {_BYC}, false) as rise from b), y as (select *, sum(case when rise then 0 else 1 end) over (partition by code order by date rows unbounded preceding) as g from x) select code, date, cast(sum(case when rise then 1 else 0 end) over (partition by code, g order by date rows unbounded preceding) as bigint) as run, date_diff('day', max(case when rise then date end) over (partition by code order by date rows unbounded preceding), date) as days_since_rise from y")
query("xs_moments", lambda spark, d: usr(spark, d).groupBy("date").agg(F.median("close").alias("cs_median"), F.avg("close").alias("cs_mean"), F.stddev_samp("close").alias("cs_std"), F.kurtosis("close").alias("cs_kurt")),
      f"with {U} select date, round(median(close), 6) + 0.0 as cs_median, round(avg(close), 6) + 0.0 as cs_mean, round(stddev_samp(close), 6) + 0.0 as cs_std, round(kurtosis_pop(close), 6) + 0.0 as cs_kurt from b group by date")


def _alpha(name: str, stages: list[dict[str, str]], portable: list[dict[str, str]]) -> None:
    cte, last = chain(portable, U)
    query(name, lambda spark, d: staged(usr(spark, d), stages).select("code", "date", *stages[-1]), f"{cte} select code, date, {r(*stages[-1])} from {last}")


def _simple(rank: Callable[[str], tuple[str, str]]) -> list[dict[str, str]]:
    """Some published formulas; rank: the mean rank within a date and the number of values. What has no value has no rank and isn't counted."""
    ranked = lambda x: "case when {0} is not null then {1} / {2} end".format(x, *rank(x))
    return [{"vwap": "amount / volume", "adv": f"avg(volume) {frame(20)}"}, {"ret": f"close / nullif(lag(close, 1) {_BYC}, 0) - 1"}, {
        "alpha_012": f"sign(volume - lag(volume, 1) {_BYC}) * -(close - lag(close, 1) {_BYC})", "alpha_033": ranked("round(open / nullif(close, 0), 9)"), "alpha_041": "sqrt(high * low) - vwap",
        "alpha_042": f"({ranked('round(vwap - close, 9)')}) / ({ranked('round(vwap + close, 9)')})", "alpha_053": f"-(((close - low) - (high - close)) / nullif(close - low, 0) - lag(((close - low) - (high - close)) / nullif(close - low, 0), 9) {_BYC})",
        "alpha_101": "(close - open) / (high - low + 0.001D)"}]


_rank = lambda x: (f"(rank() over (partition by date order by {x} nulls last) + (count(*) over (partition by date, {x}) - 1) / 2.0D)", f"count({x}) over (partition by date)")
_alpha("alpha_simple", _simple(mean_rank), _simple(_rank))


def _formulas(name: str, numbers: list[int]) -> None:
    """Half up to six decimals by the same steps in both engines: products of ranks lie on the borders of rounding."""
    portable, out = alphas.stages_of(numbers, phased=False)
    portable[-1] = {n: f"floor(({e}) * 1000000.0D + 0.5D) / 1000000.0D" for n, e in portable[-1].items()}
    cte, last = chain(portable)
    half_up = lambda x: alphas.fn("floor", x * 1000000 + 0.5) / 1000000
    query(name, lambda spark, d: grids.formulas(sup(spark, d), numbers, half_up, bars.parts(spark, d)), f"{cte} select code, date, {r(*out)} from {last}")


for _k in range(0, len(alphas.FORMULAS), 6):
    _formulas(f"formulas_{_k // 6 + 1}", list(alphas.FORMULAS)[_k : _k + 6])

# -- labels, masks, splits ---------------------------------------------------------------------------------------------
_MED = lambda s, e: f"list_median(list_filter([{', '.join(f'lead(open, {k}) {_BYC}' for k in range(s, e + 1))}], lambda x: x is not null))"
query("forward_labels", lambda spark, d: sup(spark, d).select("code", "date", panel.forward_label(2, 2).alias("label_2d"), panel.forward_label(4, 6).alias("label_6d"), panel.forward_label(16, 20).alias("label_20d"), panel.forward_label(2, 4, "close").alias("label_close")),
      f"with {B}, n as (select *, lead(open, 1) {_BYC} as nx, {_MED(2, 2)} as a, {_MED(4, 6)} as m, {_MED(16, 20)} as l, {_MED(2, 4)} as c from b) select code, date, round(a / nullif(nx, 0) - 1, 6) + 0.0 as label_2d, round(m / nullif(nx, 0) - 1, 6) + 0.0 as label_6d, round(l / nullif(nx, 0) - 1, 6) + 0.0 as label_20d, round(c / nullif(close, 0) - 1, 6) + 0.0 as label_close from n")
query("limit_mask", lambda spark, d: sup(spark, d).select("code", "date", panel.limit_mask(F.col("code") % 3 == 0).alias("limited")),
      f"with {B}, n as (select *, lead(open, 1) {_BYC} / case when close > 0 then close end as x from b) select code, date, coalesce(x >= 1.0995D or x <= 0.9005D or (code % 3 = 0 and (x >= 1.0495D or x <= 0.9505D)), false) as limited from n")
_TS = "date '2000-01-01'"
query("far_reference", lambda spark, d: sup(spark, d).select("code", "date", panel.reaches(6, F.expr(_TS)).alias("reaches")),
      f"with {B} select code, date, coalesce(greatest({', '.join(f'lead(date, {k}) {_BYC}' for k in range(1, 7))}) >= {_TS}, false) as reaches from b")
query("buffered_train_end", lambda spark, d: (lambda a: a.join(a.filter(F.col("date") < F.expr(_TS)).agg((F.count(F.lit(1)) - 20).alias("p")), F.col("pos") == F.greatest("p", F.lit(0))).select(F.col("date").alias("train_end")))(panel.date_axis(sup(spark, d))),
      f"with {B}, a as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from b)) select date as train_end from a where pos = (select greatest(count(*) - 20, 0) from a where date < {_TS})")
query("validation_tail", lambda spark, d: (lambda a: a.join(a.agg((F.count(F.lit(1)) - F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 0.15))).alias("p")), F.col("pos") >= F.col("p")).select("date"))(panel.date_axis(sup(spark, d))),
      f"with {B}, a as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from b)) select date from a where pos >= (select count(*) - greatest(1, floor(count(*) * 0.15)) from a)")


# -- membership --------------------------------------------------------------------------------------------------------
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """First ship day of each June and December; members: suppliers whose amount of the month before is within a band."""
    b = sup(spark, d)
    eff = b.filter(F.month("date").isin(6, 12)).groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("effective_date")).withColumn("p", F.add_months("m", -1))
    size = b.groupBy("code", F.trunc("date", "month").alias("p")).agg(F.sum("volume").alias("v"))
    return eff.join(size, "p").filter((F.col("v") > 100) & (F.col("v") < 600)).select("effective_date", "code")


_SNAP = "e as (select cast(date_trunc('month', date) as date) as m, min(date) as effective_date from b where extract(month from date) in (6, 12) group by 1), z as (select code, cast(date_trunc('month', date) as date) as p, sum(volume) as v from b group by all), s as (select effective_date, code from e join z on z.p = cast(e.m - interval 1 month as date) where v > 100 and v < 600)"
query("pool_snapshots", snapshots, f"with {B}, {_SNAP} select effective_date, code from s")
query("member_rows", lambda spark, d: panel.members_only(sup(spark, d).select("code", "date", "close"), snapshots(spark, d)),
      f"with {B}, {_SNAP}, i as (select distinct effective_date as eff from s), j as (select eff, lead(eff) over (order by eff) as nx from i) select b.code, b.date, {r('b.close')} from b where exists (select 1 from s join j on j.eff = s.effective_date where s.code = b.code and b.date >= eff and (nx is null or b.date < nx))")
query("reset_points", lambda spark, d: snapshots(spark, d).filter(F.col("effective_date") > F.expr(_TS)).select(F.col("effective_date").alias("date")).union(spark.range(1).select(F.expr(_TS).alias("date"))).distinct(),
      f"with {B}, {_SNAP} select distinct effective_date as date from s where effective_date > {_TS} union select {_TS} as date")
query("listed_open_days", lambda spark, d: (lambda b: b.groupBy("code").agg(F.min("date").alias("list_date")).join(panel.date_axis(b).withColumnRenamed("date", "list_date"), "list_date").crossJoin(panel.date_axis(b).agg(F.max("pos").alias("last"))).select("code", (F.col("last") - F.col("pos")).cast("long").alias("open_days")))(sup(spark, d)),
      f"with {B}, c as (select distinct date from b), l as (select code, min(date) as ld from b group by code) select code, (select count(*) from c where c.date > l.ld) as open_days from l")

# -- tables ------------------------------------------------------------------------------------------------------------
K = ["code", "date"]
# the table as it stood before each code's latest week, and an arrival that overlaps it by two weeks: every bar is in one or both
_LAST = "max(date) over (partition by code)"
old_rows = lambda spark, d: usr(spark, d).withColumn("l", F.expr(_LAST)).filter("date < l - interval 7 day").select("code", "date", "close", "volume")
new_rows = lambda spark, d: usr(spark, d).withColumn("l", F.expr(_LAST)).filter("date >= l - interval 21 day").select("code", "date", (F.col("close") * 2).alias("close"), F.col("high").alias("extra"))
_OLD, _NEW = f"o as (select code, date, close, volume from (select *, {_LAST} as l from b) where date < l - interval 7 day)", f"n as (select code, date, close * 2 as close, high as extra from (select *, {_LAST} as l from b) where date >= l - interval 21 day)"
query("upsert_replace", lambda spark, d: panel.upsert(old_rows(spark, d), new_rows(spark, d), K).select("code", "date", "close", "volume"),
      f"with {U}, {_OLD}, {_NEW} select code, date, round(close, 6) + 0.0 as close, null::double as volume from n union all select code, date, {r('close', 'volume')} from o where not exists (select 1 from n where n.code = o.code and n.date = o.date)")
query("upsert_panel", lambda spark, d: panel.upsert_columns(old_rows(spark, d), new_rows(spark, d), K),
      f"with {U}, {_OLD}, {_NEW} select code, date, round(case when n.code is not null then n.close else o.close end, 6) + 0.0 as close, {r('volume', 'extra')} from o full join n using (code, date)")
query("fill_nulls", lambda spark, d: panel.fill_nulls(old_rows(spark, d).withColumn("close", F.when(F.col("volume") > 1, F.col("close"))), new_rows(spark, d), K, "close").select("code", "date", "close"),
      f"with {U}, {_OLD}, {_NEW} select o.code, o.date, round(coalesce(case when o.volume > 1 then o.close end, n.close), 6) + 0.0 as close from o left join n using (code, date)")
query("dedup_events", lambda spark, d: panel.latest_events(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("code"), F.to_date("ts").alias("start_date"), "ts", "event_type"), ["code", "start_date"], "ts").select("code", "start_date", "event_type"),
      "select code, start_date, event_type from (select user_id as code, cast(ts as date) as start_date, event_type, row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_type) as n from events) where n = 1")
_PANEL = "p as (select * from b where date >= date '1997-01-01' and extract(day from date) <> 13)"
panel_rows = lambda spark, d: sup(spark, d).filter("date >= date '1997-01-01' and day(date) <> 13")
query("missing_dates", lambda spark, d: panel.missing_dates(sup(spark, d), panel_rows(spark, d)), f"with {B}, {_PANEL} select distinct date from b where date >= (select min(date) from p) except select date from p")
query("stock_coverage", lambda spark, d: sup(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("k")).join(sup(spark, d).filter("day(date) % 20 <> 1 or code % 2 = 0").groupBy("code").agg(F.count(F.lit(1)).alias("f")), "code", "left").withColumn("f", F.coalesce("f", F.lit(0).cast("long"))).filter("f < 0.95 * k"),
      f"with {B}, k as (select code, count(*) as k from b group by code), f as (select code, count(*) as f from b where extract(day from date) % 20 <> 1 or code % 2 = 0 group by code) select code, k, coalesce(f, 0) as f from k left join f using (code) where coalesce(f, 0) < 0.95 * k")
query("lookback_start", lambda spark, d: sup(spark, d).select("date").distinct().orderBy(F.desc("date")).limit(260).agg(F.min("date").alias("lookback_start")),
      f"with {B} select min(date) as lookback_start from (select distinct date from b order by date desc limit 260)")
query("row_drift", lambda spark, d: (lambda c: c.withColumn("l", F.sort_array(F.collect_list("n").over(Window.orderBy("date").rowsBetween(-20, -1)))).withColumn("usual", F.try_element_at("l", (F.size("l") / 2).cast("int") + 1)).filter(F.abs(F.col("n") - F.col("usual")) > 0.3 * F.col("usual")).select("date", "n", "usual"))(sup(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"))),
      f"with {B}, c as (select date, count(*) as n from b group by date), l as (select *, list_sort(list(n) over (order by date rows between 20 preceding and 1 preceding)) as l from c), u as (select date, n, l[len(l) // 2 + 1] as usual from l) select date, n, usual from u where abs(n - usual) > 0.3 * usual")
query("null_rates", lambda spark, d: staged(sup(spark, d), [factors.FIRST, factors.BASE]).agg(*((1 - F.count(c) / F.count(F.lit(1))).alias(c) for c in ("lc", "r1", "cpos", "us"))),
      f"{_cte} select {', '.join(f'round(1 - count({c}) / count(*), 6) + 0.0 as {c}' for c in ('lc', 'r1', 'cpos', 'us'))} from {_last}")
query("null_frontiers", lambda spark, d: staged(sup(spark, d), [factors.FIRST]).groupBy("code").agg(F.min(F.when(F.col("lc").isNotNull(), F.col("date"))).alias("first_lc"), F.max(F.when(F.col("lc").isNotNull(), F.col("date"))).alias("last_lc")),
      f"with {B}, x as (select *, lag(close) {_BYC} as lc from b) select code, min(date) filter (where lc is not null) as first_lc, max(date) filter (where lc is not null) as last_lc from x group by code")
query("pending_queue", lambda spark, d: (lambda e: e.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("attempts")).filter("attempts > 0").withColumn("status", F.when(F.col("attempts") >= 5, "dead").otherwise("pending")).withColumnRenamed("user_id", "source"))(spark.read.parquet(f"{d}/events.parquet")),
      "select user_id as source, count(*) as attempts, case when count(*) >= 5 then 'dead' else 'pending' end as status from events where event_type = 'error' group by 1")

# -- evaluation ----------------------------------------------------------------------------------------------------------
_SCORED = [factors.FIRST, {"score": "round(close / nullif(lc, 0) - 1, 9)", "label": f"round(lead(open, 1) {_BYC} / nullif(close, 0) - 1, 9)"}]
scored = lambda spark, d: staged(usr(spark, d), _SCORED).select("code", "date", "score", "label")
_scte, _slast = chain(_SCORED, U)
_AVG = lambda x: f"rank() over (partition by date order by {x}) + (count(*) over (partition by date, {x}) - 1) / 2.0D"
_IC = f"{_scte}, q as (select date, {_AVG('score')} as x, {_AVG('label')} as y from {_slast} where score is not null and label is not null), i as (select date, count(*) as n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as ic from q group by date having count(*) >= 5)"
query("rank_ic", lambda spark, d: panel.rank_ic(scored(spark, d), "score", "label"), f"{_IC} select date, n, {r('ic')} from i where ic is not null")
query("ic_summary", lambda spark, d: panel.ic_summary(panel.rank_ic(scored(spark, d), "score", "label")),
      f"{_IC} select count(ic) as n_periods, round(avg(ic), 6) + 0.0 as mean, round(stddev_samp(ic), 6) + 0.0 as std, round(avg(case when ic > 0 then 1.0D else 0.0D end), 6) + 0.0 as hit_rate, round(min(ic), 6) + 0.0 as min, round(max(ic), 6) + 0.0 as max, round(coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0), 6) + 0.0 as ir from i where ic is not null")
query("deciles", lambda spark, d: panel.deciles(scored(spark, d), "score", "label"),
      f"{_scte}, q as (select label, least(floor((({_AVG('score')}) / count(*) over (partition by date)) * 10), 9) as decile from {_slast} where score is not null and label is not null), m as (select cast(decile as bigint) as decile, avg(label) as mean_label, count(*) as n from q group by decile), k as (select *, rank() over (order by mean_label) + (count(*) over (partition by mean_label) - 1) / 2.0 as rk from m) select decile, round(mean_label, 6) + 0.0 as mean_label, n, round(case when (select count(*) from k) = 10 then (select corr(decile, rk) from k) end, 6) + 0.0 as rho from k")
query("top_daily", lambda spark, d: panel.top_per_date(scored(spark, d), "score", 3).select("date", "rank", "code", "score"),
      f"{_scte}, q as (select date, code, score, row_number() over (partition by date order by score desc, code) as rank from {_slast} where score is not null) select date, rank, code, {r('score')} from q where rank <= 3")
_TAIL = "t as (select distinct date from {s} where date < date '2024-12-31' order by date desc limit 60), u as (select label / score as k, abs(score) as w, score from {s} where abs(score) > 1e-12 and label is not null and date in (select date from t)), v as (select k, sum(w) over (order by k) as cw, sum(w) over () / 2 as half from u), z as (select case when (select count(*) from t) < 20 then 1.0e0 when min(k) > 0 then min(k) else 1.0e0 end as slope from v where cw >= half)"
query("calibration_tail", lambda spark, d: panel.calibration(scored(spark, d), "score", "label", F.expr("date '2024-12-31'")),
      f"{_scte}, {_TAIL.format(s=_slast)} select (select count(*) from t) as n_days, round(slope, 6) + 0.0 as slope, round(case when (select count(*) from t) >= 20 then (select median(score) from u) * slope end, 6) + 0.0 as median from z")
query("calibration_slope", lambda spark, d: panel.l1_slope(scored(spark, d), "score", "label"),
      f"{_scte}, q as (select round(label / score, 12) as r, label / score as k, abs(score) as w from {_slast} where abs(score) > 1e-12 and label is not null), c as (select k, sum(w) over (order by k) as cw, sum(w) over () / 2 as half from q) select round(case when min(k) > 0 then min(k) else 1.0D end, 6) + 0.0 as slope from c where cw >= half")
query("blend_scores", lambda spark, d: panel.blend({"a": (scored(spark, d).filter("score is not null and code % 2 = 0"), 0.3), "b": (scored(spark, d).filter("score is not null and code % 3 = 0"), 0.4), "c": (scored(spark, d).filter("score is not null and code % 5 <> 0").withColumn("score", F.col("score") * 2), 0.3)}).select("code", "date", "blend"),
      f"{_scte}, s as (select code, date, case when code % 2 = 0 then score end as a, case when code % 3 = 0 then score end as b, case when code % 5 <> 0 then score * 2 end as c from {_slast} where score is not null) select code, date, round((coalesce(a * 0.3D, 0) + coalesce(b * 0.4D, 0) + coalesce(c * 0.3D, 0)) / ((case when a is null then 0 else 0.3D end) + (case when b is null then 0 else 0.4D end) + (case when c is null then 0 else 0.3D end)), 6) + 0.0 as blend from s where coalesce(a, b, c) is not null")
query("score_quantiles", lambda spark, d: scored(spark, d).agg(*(F.percentile("score", q).alias(n) for n, q in (("q01", 0.01), ("q50", 0.5), ("q99", 0.99), ("q999", 0.999)))),
      f"{_scte} select {', '.join(f'round(quantile_cont(score, {q}), 6) + 0.0 as {n}' for n, q in (('q01', 0.01), ('q50', 0.5), ('q99', 0.99), ('q999', 0.999)))} from {_slast}")
_EQ = f"q as (select date, avg(close) as value from b group by date), w as (select *, value / lag(value) {_O} - 1 as x, max(value) over (order by date rows unbounded preceding) as top from q), t as (select arg_min(value, date) as v0, arg_max(value, date) as v1, count(x) as n, avg(x) as mean, stddev_samp(x) as sd, min((value - top) / top) as dd, count(*) filter (where x > 0) as wins, stddev_samp(x) filter (where x < 0) as down from w), z as (select *, pow(v1 / v0, 252.0D / n) - 1 as an from t where n >= 5)"
query("equity_stats", lambda spark, d: panel.equity_stats(sup(spark, d).groupBy("date").agg(F.avg("close").alias("value"))),
      f"with {B}, {_EQ} select round(v1 / v0 - 1, 6) + 0.0 as total_return, round(an, 6) + 0.0 as annual_return, round((252 * mean - 0.025D) / (sd * sqrt(252.0D)), 6) + 0.0 as sharpe, round(mean / down * sqrt(252.0D), 6) + 0.0 as sortino, round(dd, 6) + 0.0 as max_drawdown, round(an / nullif(abs(dd), 0), 6) + 0.0 as calmar, round(wins / n, 6) + 0.0 as win_rate, n as n_days from z")


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    """Bars to returns, a rank and a label, and the day's three best."""
    stages = factors.stages_of("momentum")
    b = staged(sup(spark, d), stages).withColumn("label", panel.forward_label(2, 4))
    return panel.top_per_date(b, "return_5d", 3).select("date", "rank", "code", "return_5d", "label")


_fcte, _flast = chain([*factors.stages_of("momentum"), {"m": _MED(2, 4), "nx": f"lead(open, 1) {_BYC}"}])
query("flagship_slice", _flagship, f"{_fcte}, q as (select *, m / nullif(nx, 0) - 1 as label, row_number() over (partition by date order by return_5d desc, code) as rank from {_flast} where return_5d is not null) select date, rank, code, {r('return_5d', 'label')} from q where rank <= 3")
