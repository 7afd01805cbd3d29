"""Queries of scans, table upkeep, universes, audits and reports. The SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import frame
from ledgerline.operators import audits, panel, universe, upkeep
from ledgerline.plans.catalogue import B, U, K, _SNAP, query, r, scored, snapshots, sup, usr
from ledgerline.plans.catalogue import _scte, _slast
from ledgerline.sources import scans

_BYC = "over (partition by code order by date)"
_D = lambda text: F.expr(f"date '{text}'")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listings(spark: SparkSession, d: str) -> DataFrame:
    """code, name, market (NULL for a fifth), list_date (NULL for a seventh) of suppliers."""
    return read(spark, d, "supplier").selectExpr("s_suppkey as code", "s_name as name", "case when s_suppkey % 5 > 0 then concat('board ', s_nationkey % 3) end as market", "case when s_suppkey % 7 > 0 then date_add(date '1994-01-01', cast(s_suppkey * 13 % 2500 as int)) end as list_date")


def delisted(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").filter("s_acctbal < 3000").selectExpr("s_suppkey as code", "date_add(date '1999-01-01', cast(s_suppkey * 31 % 700 as int)) as delist_date")


_LISTED = "li as (select s_suppkey as code, s_name as name, case when s_suppkey % 5 > 0 then 'board ' || (s_nationkey % 3) end as market, case when s_suppkey % 7 > 0 then date '1994-01-01' + cast(s_suppkey * 13 % 2500 as integer) end as list_date from supplier)"
_GONE = "de as (select s_suppkey as code, date '1999-01-01' + cast(s_suppkey * 31 % 700 as integer) as delist_date from supplier where s_acctbal < 3000)"

# -- scans -----------------------------------------------------------------------------------------------------------------
some_codes = lambda spark, d: read(spark, d, "supplier").filter("s_nationkey < 10").select(F.col("s_suppkey").alias("code"))
query("panel_scan", lambda spark, d: scans.panel_scan(sup(spark, d), some_codes(spark, d), ["close", "volume"], _D("1996-01-01"), _D("1998-06-30")),
      f"with {B} select code, date, {r('close', 'volume')} from b where date between date '1996-01-01' and date '1998-06-30' and code in (select s_suppkey from supplier where s_nationkey < 10)")
query("panel_keys", lambda spark, d: scans.panel_scan(sup(spark, d), columns=[], start=_D("1997-01-01")), f"with {B} select code, date from b where date >= date '1997-01-01'")
query("label_scan", lambda spark, d: scans.label_scan(sup(spark, d), _D("1997-01-01"), _D("1997-12-31"), 20),
      f"with {B}, c as (select distinct date from b where date > date '1997-12-31' order by date limit 20) select code, date, {r('open')} from b where date >= date '1997-01-01' and date <= (select coalesce(max(date), date '1997-12-31') from c)")
_values = lambda spark, d: sup(spark, d).filter("day(date) % 2 = 0").selectExpr("code", "date", "amount * 2 as total_mv", "amount as circ_mv")
query("market_values", lambda spark, d: scans.market_values(sup(spark, d), _values(spark, d)).selectExpr("code", "date", "case when total_mv > 0 then ln(total_mv) end as ln_cap", "case when circ_mv > 0 then ln(circ_mv) end as ln_float_cap"),
      f"with {B} select code, date, round(case when extract(day from date) % 2 = 0 then ln(amount * 2) end, 6) + 0.0 as ln_cap, round(case when extract(day from date) % 2 = 0 then ln(amount) end, 6) + 0.0 as ln_float_cap from b")
query("calendar_days", lambda spark, d: scans.calendar_days(sup(spark, d).agg(F.min("date").alias("start"), F.max("date").alias("end"))), f"with {B} select cast(unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day)) as date) as date from b")
query("industry_codes", lambda spark, d: scans.looked_up(read(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), read(spark, d, "nation").join(scans.encoded(read(spark, d, "nation").filter("n_nationkey % 6 <> 1"), "n_name", "industry"), "n_name"), "n_nationkey", "industry").select(F.col("s_suppkey").alias("code"), "industry"),
      "select s_suppkey as code, case when n.n_name is null then -1 else (select count(*) from nation o where o.n_name < n.n_name and o.n_nationkey % 6 <> 1) end as industry from supplier left join (select * from nation where n_nationkey % 6 <> 1) n on n_nationkey = s_nationkey")
query("industry_levels", lambda spark, d: read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(read(spark, d, "region").filter("r_regionkey > 0"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("s_suppkey").alias("code"), F.substring("s_name", 1, 8).alias("name"), F.col("n_name").alias("level_2"), F.col("r_name").alias("level_1")),
      "select s_suppkey as code, substr(s_name, 1, 8) as name, n_name as level_2, r_name as level_1 from supplier left join nation on n_nationkey = s_nationkey left join (select * from region where r_regionkey > 0) on r_regionkey = n_regionkey")
query("event_props", lambda spark, d: read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long")).groupBy(F.col("user_id").alias("code")).agg(F.sum("k").alias("k"), F.count_distinct("event_type").alias("kinds")),
      "select user_id as code, cast(sum(try_cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k, count(distinct event_type) as kinds from events group by 1")

# -- upkeep ----------------------------------------------------------------------------------------------------------------
_L = "max(date) over (partition by code)"
arrived = lambda spark, d: usr(spark, d).withColumn("l", F.expr(_L)).filter("date >= l - interval 10 day and day(date) % 5 > 0").select("code", "date", (F.col("close") + 1).alias("close"))
stored = lambda spark, d: usr(spark, d).select("code", "date", "close", "volume")
_ARRIVED = f"n as (select code, date, close + 1 as close from (select *, {_L} as l from b) where date >= l - interval 10 day and extract(day from date) % 5 > 0)"
query("replace_range", lambda spark, d: upkeep.replace_range(stored(spark, d).drop("volume"), arrived(spark, d)),
      f"with {U}, {_ARRIVED} select code, date, round(close, 6) + 0.0 as close from n union all select code, date, round(close, 6) + 0.0 as close from b where not exists (select 1 from n where n.code = b.code and n.date <= b.date)")
query("update_columns", lambda spark, d: upkeep.update_columns(stored(spark, d), arrived(spark, d).withColumn("extra", F.col("close") * 2), K),
      f"with {U}, {_ARRIVED} select b.code, b.date, round(coalesce(n.close, b.close), 6) + 0.0 as close, {r('b.volume')}, round(n.close * 2, 6) + 0.0 as extra from b left join n on n.code = b.code and n.date = b.date")
query("rebuild_table", lambda spark, d: upkeep.rebuild(stored(spark, d), arrived(spark, d).withColumn("v", F.lit(1)).unionByName(arrived(spark, d).withColumns({"close": F.col("close") * 3, "v": F.lit(2)})), K, "v"),
      f"with {U}, {_ARRIVED} select n.code, n.date, round(n.close * 3, 6) + 0.0 as close, {r('b.volume')} from n join b on n.code = b.code and n.date = b.date")
query("delete_keys", lambda spark, d: upkeep.delete_keys(stored(spark, d), arrived(spark, d), K), f"with {U}, {_ARRIVED} select code, date, {r('close', 'volume')} from b where (code, date) not in (select code, date from n)")
_errors = lambda spark, d, test: read(spark, d, "events").filter(f"event_type = 'error' and {test}").select(F.col("user_id").alias("source"), F.to_date("ts").alias("date"))
query("count_attempts", lambda spark, d: upkeep.count_attempts(_errors(spark, d, "ts < timestamp '2024-01-16'").groupBy("source").agg(F.count(F.lit(1)).alias("attempts")), _errors(spark, d, "ts >= timestamp '2024-01-16'"), ["source"], 3),
      "select user_id as source, count(*) as attempts, case when count(*) >= 3 then 'dead' else 'pending' end as status from events where event_type = 'error' group by 1")
ends = lambda spark, d: read(spark, d, "events").filter("event_type like '%purch%'").select(F.col("user_id").alias("code"), F.to_date("ts").alias("start_date"))
query("delist_dates", lambda spark, d: upkeep.delist_dates(ends(spark, d), delisted(spark, d)),
      f"with {_GONE}, f as (select user_id as code, min(cast(ts as date)) as found from events where event_type like '%purch%' group by 1) select code, coalesce(delist_date, found) as delist_date from de full join f using (code)")
query("listed_and_delisted", lambda spark, d: upkeep.prioritised(delisted(spark, d).select("code", F.lit("D").alias("status")), listings(spark, d).select("code", F.lit("L").alias("status")), ["code"]),
      f"with {_GONE} select s_suppkey as code, case when s_suppkey in (select code from de) then 'D' else 'L' end as status from supplier")
query("row_set_difference", lambda spark, d: upkeep.row_set_difference(usr(spark, d).filter("day(date) > 3"), arrived(spark, d), K),
      f"with {U}, {_ARRIVED}, a as (select code, date from b where extract(day from date) > 3) select (select count(*) from (select * from a intersect select code, date from n)) as common, (select count(*) from (select * from a except select code, date from n)) as extra, (select count(*) from (select code, date from n except select * from a)) as missing")
some_days = lambda spark, d: sup(spark, d).filter("day(date) <> 13 and date > '1996-02-01'")
query("calendar_gaps", lambda spark, d: upkeep.calendar_gaps(sup(spark, d).select("date").distinct(), some_days(spark, d)),
      f"with {B}, p as (select date from b where extract(day from date) <> 13 and date > date '1996-02-01') select distinct date from b where date between (select min(date) from p) and (select max(date) from p) and date not in (select date from p)")
query("target_dates", lambda spark, d: upkeep.target_dates(sup(spark, d).filter("month(date) = 5"), sup(spark, d).select("date").distinct().orderBy(F.desc("date")).limit(30)),
      f"with {B} select date from b where extract(month from date) = 5 union (select date from (select distinct date from b) order by date desc limit 30)")
query("every_nth_date", lambda spark, d: upkeep.every_nth_date(sup(spark, d), 7, 40),
      f"with {B}, c as (select date, row_number() over (order by date desc) - 1 as k from (select distinct date from b)) select date from c where k % 7 = 0 order by date desc limit 40")

# -- audits ----------------------------------------------------------------------------------------------------------------
fresh = lambda spark, d: sup(spark, d).selectExpr("code", "date", "case when code % 11 = 0 then close * 1.01D else close end as close", "case when day(date) = 2 then cast(null as double) else volume end as volume", "amount * (1 + 0.00001D) as amount")
query("stale_cells", lambda spark, d: audits.stale_cells(sup(spark, d).select("code", "date", "close", "volume", "amount"), fresh(spark, d), ["close", "volume", "amount"]),
      f"with {B} select 'close' as column, count(*) as cells, count(*) filter (where code % 11 = 0 and abs(close * 0.01) > 1e-12 + 1e-4 * abs(close)) as stale from b union all select 'volume', count(*), count(*) filter (where extract(day from date) = 2) from b union all select 'amount', count(*), 0 from b")
drifted = lambda spark, d: sup(spark, d).selectExpr("code", "date", "case when code % 11 = 0 then close * (1 + day(date) * 1e-5D) else close end as close", "case when month(date) = 3 and code % 3 = 0 then null else volume end as volume", "amount * 2 as amount_rank")
query("staleness_audit", lambda spark, d: audits.staleness_audit(sup(spark, d).selectExpr("code", "date", "close", "volume", "amount as amount_rank"), drifted(spark, d), sup(spark, d).filter("date >= date '1997-03-04' and code % 4 > 0").select("code", "date"), ["close", "volume", "amount_rank"], 25),
      f"""with {B}, e as (select distinct date from b where date >= (select min(date) from b where date >= date '1997-03-04' and code % 4 > 0)), n as (select date, row_number() over (order by date) - 1 as k, count(*) over () as n from e), s as (select date from n where k % greatest(1, n // 25) = 0 and k < greatest(1, n // 25) * 25),
      c as (select code, date, code % 11 = 0 and abs(close - close * (1 + extract(day from date) * 1e-5)) > 1e-12 + 1e-4 * abs(close) as c, extract(month from date) = 3 and code % 3 = 0 as v from b where date in (select date from s) and code % 4 > 0 and date >= date '1997-03-04')
      select date, count(*) as rows, count(*) filter (where c or v) as drifted_rows, count(distinct case when c or v then code end) as drifted_codes, count(*) filter (where c) as drifted_close, count(*) filter (where v) as drifted_volume from c group by date""")  # fmt: skip
# a panel without every 13th, with few rows on its last day, a column that ends in 1998 and one that is never there
_PANEL = "day(date) <> 13 and (code % 9 > 0 or day(date) > 20) and code % 17 > 0 and (date < date '2001-10-30' or code % 2 = 0)"
audited = lambda spark, d: sup(spark, d).filter(_PANEL).selectExpr("code", "date", "close", "case when year(date) < 1998 then volume end as volume", "cast(null as double) as empty")
factored = lambda spark, d: sup(spark, d).selectExpr("code", "date", "case when code % 50 <> 7 then 1.0D end as adj_factor")
query("integrity_report", lambda spark, d: audits.integrity_report(audited(spark, d), sup(spark, d).select("date").distinct().filter("dayofweek(date) > 1").union(spark.sql("select date '2001-12-03' as date")), factored(spark, d), ["close", "volume", "empty"], ["close", "empty"]),
      f"""with {B}, p as (select code, date, close, case when extract(year from date) < 1998 then volume end as volume, cast(null as double) as empty from b where {_PANEL.replace('day(date)', 'extract(day from date)')}),
      c as (select distinct date from b where dayofweek(date) > 0 union select date '2001-12-03'), l as (select max(date) as now from c), pd as (select date, count(*) as n from p group by 1), bd as (select date, count(*) as n from b group by 1),
      r as (select min(date) as lo, max(date) as hi from pd), w as (select * from p where date in (select date from pd order by date desc limit 250)),
      dr as (select 'panel drift' as t, n, row_number() over (order by date desc) as k from pd union all select 'bars drift', n, row_number() over (order by date desc) from bd),
      us as (select t, list_sort(list(n)) as l from dr where k between 2 and 21 group by t), dv as (select dr.t, abs(n - l[len(l) // 2 + 1]) > 0.3 * l[len(l) // 2 + 1] as far from dr join us using (t) where k = 1),
      k as (select code, count(*) as k from b, r where date between lo and hi group by code), f as (select code, count(*) as f from p group by 1), s as (select count(*) as codes, coalesce(sum(k - coalesce(f, 0)), 0) as lack from k left join f using (code) where coalesce(f, 0) < 0.95 * k)
      select 'latest day, panel' as "check", 'hard' as severity, (select count(*) from l where now not in (select date from pd) and now in (select date from bd)) as found
      union all select 'latest day, bars', 'hard', (select count(*) from l where now not in (select date from pd) and now not in (select date from bd))
      union all select 'holes', 'soft', (select count(*) from bd, r where date >= lo and date not in (select date from pd))
      union all select t, 'soft', cast(far as int) from dv
      union all select 'factor nulls', 'soft', (select count(*) from (select count(*) as n, count(*) filter (where code % 50 = 7) as x from b where date = (select now from l)) where x > 0.01 * n)
      union all select 'panel calendar', 'soft', (select count(*) from c, r where date between lo and hi and date not in (select date from pd))
      union all select 'bars calendar', 'soft', (select count(*) from c where date between (select min(date) from bd) and (select max(date) from bd) and date not in (select date from bd))
      union all select 'value health', 'soft', (select case when count(*) = 0 then 0 else cast(count(close) < 0.5 * count(*) as int) + cast(count(empty) < 0.5 * count(*) as int) end from p where date = (select now from l))
      union all select 'null rate', 'soft', (select cast(count(close) < 0.7 * count(*) as int) + cast(count(volume) < 0.7 * count(*) as int) + cast(count(empty) < 0.7 * count(*) as int) from w)
      union all select 'short codes', 'soft', codes from s union all select 'short rows', 'soft', lack from s""")  # fmt: skip
_thin = "not (day(date) = 9 and code % 3 > 0) and day(date) <> 28"
query("pull_checks", lambda spark, d: audits.pull_checks(sup(spark, d).filter(_thin).withColumn("adj_factor", F.expr("case when code % 50 <> 7 then 1.0D end")), sup(spark, d).select("date"), "adj_factor"),
      f"""with {B}, x as (select * from b where {_thin.replace('day(date)', 'extract(day from date)')}), n as (select date, count(*) as n, count(*) filter (where code % 50 = 7) as n_null from x group by 1), a as (select distinct date from b),
      u as (select a.date, (select median(n) from (select n from n m where m.date < a.date order by m.date desc limit 20)) as usual from a), j as (select date, coalesce(n, 0) as n, usual, n_null from u left join n using (date)),
      w as (select *, case when n = 0 then 'empty' when n < 0.7 * usual then 'rows' when n_null > 0.01 * n then 'nulls' end as wrong from j) select date, n, round(usual, 6) + 0.0 as usual, wrong from w where wrong is not null""")  # fmt: skip
featured = lambda rows: rows.selectExpr("code", "date", f"avg(close) {frame(20)} as past", f"lead(close) {_BYC} as ahead")
query("look_ahead", lambda spark, d: audits.look_ahead(featured(sup(spark, d)), featured(sup(spark, d).filter("date < '1998-01-01'")), ["past", "ahead"]),
      f"with {B}, c as (select *, lead(date) {_BYC} as nx from b) select 'past' as column, count(*) as cells, 0 as leaks from c where date < date '1998-01-01' union all select 'ahead', count(*), count(*) filter (where nx >= date '1998-01-01') from c where date < date '1998-01-01'")

# -- universes -------------------------------------------------------------------------------------------------------------
def _spans(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("code"), F.to_date("ts").alias("start_date")).agg(F.max("event_type").alias("reason"), F.max(F.expr("case when event_id % 4 = 0 then date_add(to_date(ts), 5) end")).alias("end_date"))
    return universe.status_spans(e, universe.is_opening(F.col("reason"), "r", ("pur", "sig"), ("sign",)), F.col("reason").startswith("pur"))


query("status_spans", _spans, "with e as (select user_id as code, cast(ts as date) as start_date, max(event_type) as reason, max(case when event_id % 4 = 0 then cast(ts as date) + 5 end) as end_date from events group by all), o as (select *, lead(start_date) over (partition by code order by start_date) as nx from e) select code, start_date, least(coalesce(end_date + 1, nx, date '9999-12-31'), coalesce((select min(l.start_date) from e l where l.code = o.code and l.reason like 'pur%' and l.start_date >= o.start_date), date '9999-12-31')) as end_excl from o where reason like '%r%' and not ((reason like 'pur%' or reason like 'sig%') and reason not like 'sign%')")
query("board_members", lambda spark, d: listings(spark, d).filter(universe.on_board(F.col("market"), F.substring("name", 10, 9), "board 1", ("00000000", "00000005"))).select("code"),
      f"with {_LISTED} select code from li where coalesce(market, case when name like 'Supplier#00000000%' or name like 'Supplier#00000005%' then 'board 1' end) = 'board 1'")
cuts = lambda spark, d: sup(spark, d).groupBy(F.year("date").alias("y")).agg(F.min("date").alias("cut"))
query("seasoned_codes", lambda spark, d: universe.seasoned(listings(spark, d), sup(spark, d).select("date"), cuts(spark, d), 252),
      f"with {B}, {_LISTED}, c as (select distinct date from b), q as (select min(date) as cut from b group by extract(year from date)) select cut, code from li, q where list_date is not null and (select count(*) from c where date > list_date and date <= cut) >= 252")
query("codes_on", lambda spark, d: universe.codes_on(snapshots(spark, d), _D("1998-03-01")), f"with {B}, {_SNAP} select code from s where effective_date = (select max(effective_date) from s where effective_date <= date '1998-03-01')")
query("latest_codes", lambda spark, d: universe.latest_codes(snapshots(spark, d)), f"with {B}, {_SNAP} select code from s where effective_date = (select max(effective_date) from s)")
query("union_codes", lambda spark, d: universe.union_codes(snapshots(spark, d), _D("1998-03-01")), f"with {B}, {_SNAP} select distinct code from s where effective_date >= (select max(effective_date) from s where effective_date <= date '1998-03-01')")
query("member_lists", lambda spark, d: universe.member_lists(snapshots(spark, d)).select("effective_date", "n", F.concat_ws(",", "codes").alias("codes")), f"with {B}, {_SNAP} select effective_date, count(distinct code) as n, string_agg(code, ',' order by code) as codes from s group by 1")
labelled = lambda spark, d: sup(spark, d).select("code", "date", panel.forward_label(2, 4).alias("label"))
_LAB = f"la as (select code, date, list_median(list_filter([lead(open, 2) {_BYC}, lead(open, 3) {_BYC}, lead(open, 4) {_BYC}], lambda x: x is not null)) / nullif(lead(open, 1) {_BYC}, 0) - 1 as label from b)"
query("trained_rows", lambda spark, d: universe.trained_rows(sup(spark, d).select("code", "date", "close"), labelled(spark, d), snapshots(spark, d), delisted(spark, d), _D("1996-01-01")),
      f"with {B}, {_SNAP}, {_GONE}, {_LAB}, i as (select *, (select min(effective_date) from s t where t.effective_date > s.effective_date) as nx from s) select b.code, b.date, {r('close')}, round(label, 6) + 0.0 as label from b join la using (code, date) where label is not null and date >= date '1996-01-01' and exists (select 1 from i where i.code = b.code and b.date >= effective_date and (nx is null or b.date < nx)) and not exists (select 1 from de where de.code = b.code and delist_date <= b.date)")
query("walk_forward", lambda spark, d: universe.walk_forward(sup(spark, d), 90, _D("1998-01-01"), _D("1998-02-01"), _D("1998-12-31"), 252),
      f"with {B}, c as (select date, row_number() over (order by date) as k from (select distinct date from b)), t as (select date, 'train' as part from c where k > 90 and date < date '1998-01-01') select * from t where (select count(*) from t) >= 252 union all select date, 'test' from c where date between date '1998-02-01' and date '1998-12-31' and (select count(*) from t) >= 252")
with_st = lambda spark, d: sup(spark, d).select("code", "date", "close", F.expr("case when (code + day(date)) % 13 = 0 then 1 else 0 end").alias("is_st"))
query("benchmark", lambda spark, d: universe.benchmark(with_st(spark, d), snapshots(spark, d), delisted(spark, d)),
      f"""with recursive {B}, {_SNAP}, {_GONE}, v as (select code, date, close, (code + extract(day from date)) % 13 = 0 as st from b), q as (select distinct date from v),
      g as (select effective_date as eff, lead(effective_date) over (order by effective_date) as nx, row_number() over (order by effective_date) as k from (select distinct effective_date from s)),
      x as (select q.date, g.eff, min(q.date) over (partition by g.eff) as d0 from q join g on q.date >= g.eff and (g.nx is null or q.date < g.nx)),
      m as (select x.eff, v.code, arg_min(v.close, v.date) as base, arg_min(v.st, v.date) as st from v join x using (date) join s on s.effective_date = x.eff and s.code = v.code left join de on de.code = v.code where delist_date is null or d0 < delist_date group by all),
      p as (select * from m where not st and base > 0), cnt as (select eff, count(*) as n from p group by 1),
      day as (select x.eff, x.date, p.code, p.base, (select arg_max(v.close, v.date) from v join x y on y.date = v.date and y.eff = x.eff where v.code = p.code and v.date <= x.date) as last from x join p on p.eff = x.eff),
      nav as (select day.eff, day.date, sum(case when delist_date is null or day.date < delist_date then coalesce(last / base, 0) else 0 end) / any_value(n) as nav from day join cnt using (eff) left join de on de.code = day.code group by all),
      fin as (select eff, arg_max(nav, date) as fin, row_number() over (order by eff) as k from nav group by eff), ch as (select eff, k, fin, 1.0::double as before from fin where k = 1 union all select fin.eff, fin.k, fin.fin, ch.before * ch.fin from ch join fin on fin.k = ch.k + 1)
      , held as (select date, nav * before as nav from nav join ch using (eff)) select date, round(nav / nullif(first_value(nav) over (order by date), 0), 6) + 0.0 as nav, round(nav / nullif(lag(nav) over (order by date), 0) - 1, 6) + 0.0 as ret from held""")  # fmt: skip
query("excluded_on", lambda spark, d: universe.excluded_on(sup(spark, d), with_st(spark, d), delisted(spark, d), _D("1999-06-10")),
      f"with {B}, {_GONE} select code, case when exists (select 1 from b x where x.code = c.code and x.date = date '1999-06-10' and (x.code + 10) % 13 = 0) then 'st' else 'delisted' end as layer from (select distinct code from b) c where exists (select 1 from b x where x.code = c.code and x.date = date '1999-06-10' and (x.code + 10) % 13 = 0) or code in (select code from de where delist_date <= date '1999-06-10')")
query("day_report", lambda spark, d: universe.day_report(scored(spark, d), read(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name")), read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("code")), _D("2024-01-20"), 0.0, 10),
      f"{_scte}, q as (select * from {_slast} where date = date '2024-01-20' and code not in (select c_custkey from customer where c_acctbal < 0)), k as (select *, row_number() over (order by score desc, code) as rank from q where score is not null) select rank, code, c_name as name, {r('score')}, (select count(*) from q where score > 0) as above, (select count(*) from q where score <= 0) as below from k left join customer on c_custkey = code where rank <= 10")
_RIC = f"{_scte}, q as (select date, rank() over (partition by date order by score) + (count(*) over (partition by date, score) - 1) / 2.0e0 as x, rank() over (partition by date order by label) + (count(*) over (partition by date, label) - 1) / 2.0e0 as y from {_slast} where score is not null and label is not null), i as (select date, corr(x, y) as ic from q group by date having count(*) >= 5 and stddev_pop(x) > 0 and stddev_pop(y) > 0)"
query("ic_t_stat", lambda spark, d: universe.ic_t_stat(panel.rank_ic(scored(spark, d), "score", "label")), f"{_RIC} select round(avg(ic), 6) + 0.0 as mean, round(avg(ic) / stddev_pop(ic) * sqrt(count(*)), 6) + 0.0 as t, count(*) as n from i")
query("fold_summary", lambda spark, d: universe.fold_summary(panel.rank_ic(scored(spark, d), "score", "label").groupBy(F.weekofyear("date").alias("fold")).agg(F.avg("ic").alias("ic"), F.max("n").cast("double").alias("names")), ["ic", "names"]),
      f"{_RIC}, m as (select date, count(*) as n from q group by 1), w as (select extract(week from date) as fold, avg(ic) as ic, max(n) as names from i join m using (date) group by 1) select 'ic' as metric, round(avg(ic), 6) + 0.0 as mean, round(min(ic), 6) + 0.0 as worst, count(*) as n from w union all select 'names', round(avg(names), 6) + 0.0, round(min(names), 6) + 0.0, count(*) from w")
query("score_guard", lambda spark, d: universe.guarded(scored(spark, d)), f"{_scte} select round(quantile_cont(abs(score), 0.999), 6) + 0.0 as magnitude, quantile_cont(abs(score), 0.999) <= 0.35 as sound from {_slast}")
masks = lambda spark, d: usr(spark, d).filter("day(date) % 3 > 0").select("code", "date", F.expr("code % 7 = 0").alias("limited"), F.expr("code % 5 = 0").cast("int").alias("is_st"))
query("safe_error", lambda spark, d: universe.safe_rows(scored(spark, d), masks(spark, d)).agg(F.count("error").alias("n"), F.avg("error").alias("mae")),
      f"{_scte} select count(abs(score - label)) as n, round(avg(abs(score - label)), 6) + 0.0 as mae from {_slast} where extract(day from date) % 3 = 0 or (code % 7 <> 0 and code % 5 <> 0)")

# -- more columns ----------------------------------------------------------------------------------------------------------
aged = lambda spark, d: sup(spark, d).join(listings(spark, d).select("code", "list_date"), "code", "left")
query("factor_age", lambda spark, d: aged(spark, d).select("code", "date", F.expr("case when datediff(date, list_date) > 0 then ln(datediff(date, list_date)) end").alias("ln_age")),
      f"with {B}, {_LISTED} select code, date, round(case when date > list_date then ln(date_diff('day', list_date, date)) end, 6) + 0.0 as ln_age from b left join li using (code)")
_BAND = universe.Universe("", (), 1.0, 40.0, 2000, 11 / 20, 11.0, 252)
_limits = lambda day: [F.round(F.lit(x) * universe.decay(F.col(day), _BAND) * 10000, 0).cast("double") for x in (1.0, 40.0)]
query("size_band", lambda spark, d: sup(spark, d).select("date").distinct().select("date", universe.decimal_year(F.col("date")).alias("year"), universe.decay(F.col("date"), _BAND).alias("factor"), _limits("date")[0].alias("low"), _limits("date")[1].alias("high")),
      f"with {B}, y as (select distinct date, extract(year from date) + (extract(doy from date) - 1) / case when extract(year from date) % 4 = 0 and (extract(year from date) % 100 <> 0 or extract(year from date) % 400 = 0) then 366.0e0 else 365.0e0 end as y from b), f as (select date, y, pow(0.55e0, greatest(0, 2000 - y) / 11.0e0) as f from y) select date, round(y, 6) + 0.0 as year, round(f, 6) + 0.0 as factor, round(f * 10000, 0) + 0.0 as low, round(40 * f * 10000, 0) + 0.0 as high from f")


def _regressions(spark: SparkSession, d: str) -> DataFrame:
    """Slope of the close by row and its t value, beta to the day's mean, and rows since the close last rose, over 20 rows."""
    w = panel.over(20)
    b = usr(spark, d).withColumns({"n": F.row_number().over(panel.by_code()).cast("double"), "m": F.avg("close").over(Window.partitionBy("date")), "up": F.col("close") > F.lag("close").over(panel.by_code())})
    full, slope, r2 = F.count("close").over(w) == 20, F.regr_slope("close", "n").over(w), F.regr_r2("close", "n").over(w)
    held = F.max(F.when(F.col("up"), F.col("n"))).over(panel.by_code().rowsBetween(Window.unboundedPreceding, 0))
    return b.select("code", "date", F.when(full, slope).alias("ts_slope"), F.when(full, F.signum(slope) * F.sqrt(F.try_divide(r2 * 18, 1 - r2))).alias("ts_tstat"), F.when(full, F.try_divide(F.covar_pop("close", "m").over(w), F.var_pop("m").over(w))).alias("beta"), (F.col("n") - held).cast("long").alias("bars_since_rise"))


_F = frame(20)
query("ts_regressions", _regressions, f"with {U}, x as (select *, cast(row_number() {_BYC} as double) as n, avg(close) over (partition by date) as m, close > lag(close) {_BYC} as up from b), y as (select *, count(*) {_F} as c, regr_sxy(close, n) {_F} as sxy, regr_sxx(close, n) {_F} as sxx, regr_syy(close, n) {_F} as syy from x) select code, date, round(case when c = 20 then sxy / sxx end, 6) + 0.0 as ts_slope, round(case when c = 20 then (sxy / sxx) / nullif(sqrt((syy - sxy * sxy / sxx) / 18 / sxx), 0) end, 6) + 0.0 as ts_tstat, round(case when c = 20 then regr_slope(close, m) {_F} end, 6) + 0.0 as beta, cast(n - max(case when up then n end) over (partition by code order by date rows unbounded preceding) as bigint) as bars_since_rise from y")
query("xs_more", lambda spark, d: usr(spark, d).withColumn("g", F.col("code") % 5).select("code", "date", F.avg("close").over(Window.partitionBy("date", "g")).alias("ind_mean"), (panel.average_rank("close", "date", "g") / F.count("close").over(Window.partitionBy("date", "g"))).alias("rank_in_industry"), F.greatest(F.lit(20.0), F.least(F.lit(80.0), "close")).alias("clipped"), F.percent_rank().over(Window.partitionBy("date").orderBy("close")).alias("percentile")),
      f"with {U} select code, date, round(avg(close) over (partition by date, code % 5), 6) + 0.0 as ind_mean, round((select (count(*) filter (where o.close < b.close) + (count(*) filter (where o.close = b.close) + 1) / 2.0e0) / count(*) from b o where o.date = b.date and o.code % 5 = b.code % 5), 6) + 0.0 as rank_in_industry, round(case when close < 20 then 20 when close > 80 then 80 else close end, 6) + 0.0 as clipped, round(percent_rank() over (partition by date order by close), 6) + 0.0 as percentile from b")
query("xs_skew", lambda spark, d: usr(spark, d).groupBy("date").agg(F.skewness("close").alias("cs_skew"), F.count(F.lit(1)).alias("n")).filter("n >= 3").select("date", "cs_skew"),
      f"with {U}, m as (select date, close - avg(close) over (partition by date) as x from b) select date, round(avg(x * x * x) / pow(avg(x * x), 1.5), 6) + 0.0 as cs_skew from m group by 1 having count(*) >= 3")
trades = lambda spark, d: read(spark, d, "events").filter("event_type in ('purchase', 'error')").selectExpr("user_id as code", "ts as at", "to_date(ts) as date", "case when event_type = 'purchase' then 'BUY' else 'SELL' end as action", "event_id % 5 + 1 as shares", "value as price").drop("at")
query("fifo_trips", lambda spark, d: panel.fifo_trips(trades(spark, d), endless=True),
      """with t as (select user_id as code, cast(ts as date) as date, event_type = 'purchase' as buy, event_id % 5 + 1 as shares, value as price from events where event_type in ('purchase', 'error')),
      h as (select *, sum(shares) over (partition by code, buy order by date, price, shares rows unbounded preceding) as hi from t)
      select b.code, b.date as bought, s.date as sold, cast(least(b.hi, s.hi) - greatest(b.hi - b.shares, s.hi - s.shares) as bigint) as shares, date_diff('day', b.date, s.date) as days, round(s.price / b.price - 1, 6) + 0.0 as trip_return
      from h b join h s on b.code = s.code and b.buy and not s.buy and b.hi - b.shares < s.hi and s.hi - s.shares < b.hi""")  # fmt: skip
