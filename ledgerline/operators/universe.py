"""Universes at a point in time: status events, boards, listing age, members, training rows, benchmark and day report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import sdiv
from ledgerline.operators.asof import asof
from ledgerline.operators.panel import date_axis, intervals, members_only, top_per_date


# -- status ----------------------------------------------------------------------------------------------------------------
def is_opening(reason: Column, mark: str, lifts: tuple[str, ...], not_lifts: tuple[str, ...] = ()) -> Column:
    """The reason holds the mark and begins like no lift, unless like one of not_lifts."""
    begins = lambda xs: F.lit(False) if not xs else _any(reason.startswith(x) for x in xs)
    return F.coalesce(reason.contains(mark) & ~(begins(lifts) & ~begins(not_lifts)), F.lit(False))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def status_spans(events: DataFrame, opening: Column, lift: Column) -> DataFrame:
    """events: code, start_date, end_date. Half-open spans of the openings: to the day after end_date, or else the code's next
    event, and at most to its first lift on or after the start."""
    day = F.datediff("start_date", F.lit("1970-01-01").cast("date"))
    later = lambda least: Window.partitionBy("code").orderBy(day).rangeBetween(least, Window.unboundedFollowing)
    far = F.lit("9999-12-31").cast("date")
    w = Window.partitionBy("code").orderBy("start_date", F.col("end_date").asc_nulls_last())
    d = events.withColumns({"_next": F.lead("start_date").over(w), "_lift": F.min(F.when(lift, F.col("start_date"))).over(later(0)), "_open": opening})
    return d.filter("_open").select("code", "start_date", F.least(F.coalesce(F.date_add("end_date", 1), "_next", far), F.coalesce("_lift", far)).alias("end_excl"))


# -- members ---------------------------------------------------------------------------------------------------------------
def on_board(market: Column, code: Column, board: str, prefixes: tuple[str, ...]) -> Column:
    """Of the board by the market's name, or, where that is NULL, by how the code begins."""
    return F.coalesce(market == board, _any(code.startswith(p) for p in prefixes))


def seasoned(listings: DataFrame, calendar: DataFrame, cuts: DataFrame, least: int) -> DataFrame:
    """cut, code: listed at least so many open days after list_date up to the cut. Open days are counted by their positions."""
    axis = date_axis(calendar)
    upto = lambda rows, c: rows.join(axis.withColumnRenamed("date", "_d"), F.col("_d") <= F.col(c), "left").groupBy(*rows.columns).agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias(f"_{c}"))
    days = listings.select("list_date").filter("list_date is not null").distinct()
    return listings.join(upto(days, "list_date"), "list_date").crossJoin(upto(cuts.select("cut"), "cut")).filter(F.col("_cut") - F.col("_list_date") >= least).select("cut", "code")


@dataclass(frozen=True)
class Universe:
    """Who belongs to a universe: a board, by market or by how a code's mark begins; a band of sizes that shrinks by `ratio` over `years` before
    base_year, in units of 1 / per_unit (low None: no band); at least `seasoned` open days since listing."""

    board: str
    prefixes: tuple[str, ...]
    low: float | None
    high: float | None
    base_year: int
    ratio: float
    years: float
    seasoned: int
    per_unit: int = 10000


def decimal_year(day: Column) -> Column:
    """The year and how much of it has gone by."""
    days = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    return F.year(day) + (F.dayofyear(day) - F.lit(1)) / days


def decay(day: Column, u: Universe) -> Column:
    """What the band's limits are times on the day; 1 from the base year on."""
    return F.pow(F.lit(u.ratio), F.greatest(F.lit(0.0), F.lit(u.base_year) - decimal_year(day)) / F.lit(u.years))


def build_snapshots(calendar: DataFrame, basics: DataFrame, info: DataFrame, u: Universe, from_year: int) -> DataFrame:
    """effective_date (the first open day of a June or December), cutoff_date (the last one of the month before), code. Chosen on the cutoff from the rows
    that basics (code, date, size) has then, so what is gone by then isn't in; info: code, market, mark, list_date."""
    axis = date_axis(calendar)
    months = axis.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("first"), F.max(F.struct("date", "pos")).alias("last"))
    eff = months.filter(F.month("m").isin(6, 12) & (F.year("m") >= from_year)).select(F.add_months("m", -1).alias("m"), F.col("first").alias("effective_date"))
    cuts = eff.join(months, "m").select("effective_date", F.col("last.date").alias("cutoff_date"), F.col("last.pos").alias("_cut"))
    low, high = (None if x is None else F.round(F.lit(x) * decay(F.col("cutoff_date"), u) * u.per_unit, 0) for x in (u.low, u.high))
    own = info.filter(on_board(F.col("market"), F.col("mark"), u.board, u.prefixes) & F.col("list_date").isNotNull()).select("code", F.col("list_date").alias("date"))
    # the open days up to the listing, by one lookup for each listing date
    listed = asof(own.select("date").distinct(), axis.withColumn("_listed", F.col("pos")).select("date", "_listed"), [], "date", ["_listed"])
    aged = own.join(listed, "date").select("code", F.coalesce("_listed", F.lit(-1)).alias("_listed"))
    there = basics.select("code", F.col("date").alias("cutoff_date"), "size").join(cuts, "cutoff_date").join(aged, "code")
    kept = there.filter(F.col("_cut") - F.col("_listed") >= u.seasoned)
    if low is not None:
        kept = kept.filter((F.col("size") > low) & (F.col("size") < high))
    return kept.select("effective_date", "cutoff_date", "code").distinct()


def codes_on(snapshots: DataFrame, day: Column) -> DataFrame:
    """Members of the newest snapshot in force on the day."""
    return intervals(snapshots).filter((F.col("effective_date") <= day) & (F.col("next_eff").isNull() | (F.col("next_eff") > day))).select("code")


def latest_codes(snapshots: DataFrame) -> DataFrame:
    return snapshots.join(F.broadcast(snapshots.agg(F.max("effective_date").alias("effective_date"))), "effective_date", "left_semi").select("code")


def union_codes(snapshots: DataFrame, since: Column) -> DataFrame:
    """Members at any time from the day on."""
    return intervals(snapshots).filter(F.col("next_eff").isNull() | (F.col("next_eff") > since)).select("code").distinct()


def member_lists(snapshots: DataFrame) -> DataFrame:
    """Per effective date the members in order, and how many."""
    return snapshots.groupBy("effective_date").agg(F.array_sort(F.collect_set("code")).alias("codes")).withColumn("n", F.size("codes").cast("long"))


def trained_rows(panel: DataFrame, labels: DataFrame, snapshots: DataFrame, delisted: DataFrame, start: Column) -> DataFrame:
    """Panel rows with a label, from start on, of members on their date, before the code's delist date."""
    both = panel.join(labels.filter(F.col("label").isNotNull()), ["code", "date"]).filter(F.col("date") >= start)
    alive = members_only(both, snapshots).join(delisted.select("code", "delist_date"), "code", "left")
    return alive.filter(F.col("delist_date").isNull() | (F.col("date") < F.col("delist_date"))).drop("delist_date")


def walk_forward(dates: DataFrame, warm_up: int, train_end: Column, start: Column, end: Column, least: int) -> DataFrame:
    """date, part: train after the first warm_up dates and before train_end, test from start to end; no rows if train has
    fewer than `least` dates."""
    pos = date_axis(dates)
    part = F.when((F.col("pos") >= warm_up) & (F.col("date") < train_end), "train").when((F.col("date") >= start) & (F.col("date") <= end), "test")
    d = pos.withColumn("part", part).filter("part is not null")
    n = F.count(F.when(F.col("part") == "train", 1)).over(Window.partitionBy())  # one row a date
    return d.withColumn("_n", n).filter(F.col("_n") >= least).select("date", "part")


def walk_forward_rows(rows: DataFrame, excluded: DataFrame, warm_up: int, train_end: Column, start: Column, end: Column, least: int, label: str = "label") -> DataFrame:
    """rows with part: train before train_end after the warm-up, if labelled and not excluded (code, date); test from start to end, excluded or not and labelled
    or not. No rows if fewer than `least` distinct dates are left to train on."""
    axis = date_axis(rows).withColumnRenamed("pos", "_pos")
    part = F.when((F.col("_pos") >= warm_up) & (F.col("date") < train_end), "train").when((F.col("date") >= start) & (F.col("date") <= end), "test")
    d = rows.join(axis, "date").withColumn("part", part).filter("part is not null").join(excluded.select("code", "date").distinct().withColumn("_out", F.lit(True)), ["code", "date"], "left")
    d = d.filter((F.col("part") == "test") | (F.col("_out").isNull() & F.col(label).isNotNull())).drop("_pos", "_out")
    n = d.filter("part = 'train'").agg(F.count_distinct("date").alias("_n"))
    return d.crossJoin(n).filter(F.col("_n") >= least).drop("_n")


# -- benchmark -------------------------------------------------------------------------------------------------------------
def benchmark(bars: DataFrame, resets: DataFrame, delisted: DataFrame) -> DataFrame:
    """date, nav of equal weights bought at each reset and held to the next, segments chained, over the first day's; ret, its change from the day before.

    bars: code, date, close, is_st; resets: effective_date, code; delisted: code, delist_date. A code enters if its first bar of
    the segment isn't st and has a price, and it isn't delisted by then; without a bar a day it keeps its last close, from its
    delist date on it is worth 0, and before its first bar it adds nothing. Fewer than two days give no rows; after a worth
    of 0 a change is NULL.

    Bars are sorted once by segment and code; what they say is summed up by date, and everything after that has one row a date."""
    eff = resets.select("effective_date").distinct().withColumn("date", F.col("effective_date"))
    of_day = asof(bars.select("date").distinct(), eff, [], "date", ["effective_date"]).filter("effective_date is not null").withColumn("_first_day", F.min("date").over(Window.partitionBy("effective_date")))
    members = resets.join(delisted.select("code", "delist_date"), "code", "left")
    own = bars.join(of_day, "date").join(members, ["effective_date", "code"]).filter(F.col("delist_date").isNull() | (F.col("_first_day") < F.col("delist_date")))
    seg = Window.partitionBy("effective_date", "code").orderBy("date")
    own = own.withColumns({"_base": F.first("close").over(seg), "_st": F.first(F.coalesce("is_st", F.lit(0))).over(seg), "_k": F.row_number().over(seg)}).filter((F.col("_st") != 1) & (F.col("_base") > 0))
    # a bar is worth its close until the code's next bar, so a day's worth is the running sum of the changes up to it; the last one before a delisting goes with it
    worth = F.when(F.col("delist_date").isNull() | (F.col("date") < F.col("delist_date")), F.col("close") / F.col("_base"))
    own = own.withColumn("_v", worth)
    change = F.when(F.col("_v").isNotNull(), F.col("_v") - F.coalesce(F.lag("_v").over(seg), F.lit(0.0)))
    last = F.col("_v").isNotNull() & F.lead("_v").over(seg).isNull() & F.col("delist_date").isNotNull()
    entry = lambda d, v, n: F.struct(d.alias("date"), v.alias("d"), n.alias("n"))
    told = own.withColumns({"_d": change, "_last": last})
    events = told.select("effective_date", F.explode(F.array_compact(F.array(entry(F.col("date"), F.col("_d"), (F.col("_k") == 1).cast("long")), F.when(F.col("_last"), entry(F.col("delist_date"), -F.col("_v"), F.lit(0).cast("long")))))).alias("e"))
    per = events.groupBy("effective_date", F.col("e.date").alias("date")).agg(F.sum("e.d").alias("_d"), F.sum("e.n").alias("_n"))
    axis = of_day.select("effective_date", "date").withColumn("_day", F.lit(True)).join(per, ["effective_date", "date"], "full")
    days, whole = Window.partitionBy("effective_date").orderBy("date"), Window.partitionBy("effective_date")
    worths = axis.withColumns({"_s": F.sum(F.coalesce("_d", F.lit(0.0))).over(days.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_n").over(whole)}).filter("_day and _n > 0").select("effective_date", "date", (F.col("_s") / F.col("_n")).alias("_nav"))
    ends = worths.withColumn("_end", F.when(F.col("date") == F.max("date").over(whole), F.col("_nav")))
    every = Window.orderBy("date")  # one row a date
    nav = ends.withColumn("_nav", F.col("_nav") * F.coalesce(F.product("_end").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    out = nav.withColumns({"nav": sdiv(F.col("_nav"), F.first("_nav").over(every)), "ret": sdiv(F.col("_nav"), F.lag("_nav").over(every)) - 1, "_rows": F.count(F.lit(1)).over(Window.partitionBy())})
    return out.filter("_rows > 1").select("date", "nav", "ret")


# -- reports ---------------------------------------------------------------------------------------------------------------
def excluded_on(rows: DataFrame, st: DataFrame, delisted: DataFrame, day: Column) -> DataFrame:
    """code, layer of the rows' codes: st on the day, or delisted by it; st counts first."""
    a = st.filter((F.col("date") == day) & (F.col("is_st") == 1)).select("code", F.lit("st").alias("layer"))
    b = delisted.filter(F.col("delist_date") <= day).select("code", F.lit("delisted").alias("layer"))
    both = a.unionByName(b).groupBy("code").agg(F.max("layer").alias("layer"))
    return rows.select("code").distinct().join(both, "code")


def excluded_counts(rows: DataFrame, st: DataFrame, delisted: DataFrame, day: Column) -> DataFrame:
    """How many of the rows' codes each layer takes out, a code in both counting in both, how many go in all and how many stay."""
    a = st.filter((F.col("date") == day) & (F.col("is_st") == 1)).select("code").distinct().withColumn("_st", F.lit(1))
    b = delisted.filter(F.col("delist_date") <= day).select("code").distinct().withColumn("_gone", F.lit(1))
    both = rows.select("code").distinct().join(a, "code", "left").join(b, "code", "left")
    n = lambda *cs: F.count(F.when(F.coalesce(*cs).isNotNull(), 1))
    return both.agg(n("_st").alias("st"), n("_gone").alias("delisted"), n("_st", "_gone").alias("excluded"), (F.count(F.lit(1)) - n("_st", "_gone")).alias("kept"))


def day_report(scores: DataFrame, names: DataFrame, out: DataFrame, day: Column, zero: float, k: int) -> DataFrame:
    """The day's k best with names, and how many of the day's scores lie above the zero and at or below it."""
    own = scores.filter(F.col("date") == day).join(out.select("code"), "code", "left_anti")
    n = own.agg(F.count(F.when(F.col("score") > zero, 1)).alias("above"), F.count(F.when(F.col("score") <= zero, 1)).alias("below"))
    return top_per_date(own, "score", k).join(names, "code", "left").crossJoin(n).select("rank", "code", "name", "score", "above", "below")


def sell_zero(medians: dict[str, float | None], weights: dict[str, float]) -> float:
    """The blended zero of the models that are there: their calibrated medians, 0 where one lacks, by weights that sum to one."""
    total = sum(weights[m] for m in medians)
    if not total:
        raise ValueError("no model")
    return sum(weights[m] / total * (x or 0.0) for m, x in medians.items())


def guarded(scores: DataFrame, most: float = 0.35, share: float = 0.999) -> DataFrame:
    """magnitude, sound: the quantile of |score|, and whether it is at most `most`."""
    return scores.agg(F.percentile(F.abs("score"), share).alias("magnitude")).withColumn("sound", F.coalesce(F.col("magnitude") <= most, F.lit(False)))


def ic_t_stat(ics: DataFrame) -> DataFrame:
    """mean, t: the mean over the population deviation by the root of the count; 0 for none."""
    a = ics.agg(F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("sd"), F.count("ic").alias("n"))
    return a.select("mean", F.coalesce(sdiv(F.col("mean") * F.sqrt("n"), F.col("sd")), F.lit(0.0)).alias("t"), "n")


def fold_summary(folds: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean, worst over folds; NULLs and NaNs don't count."""
    good = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    a = folds.agg(*(F.struct(F.lit(c).alias("metric"), F.avg(g).alias("mean"), F.min(g).alias("worst"), F.count(g).alias("n")).alias(c) for c, g in good.items()))
    return a.select(F.explode(F.array(*columns)).alias("m")).select("m.*")


def safe_rows(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Rows without a price limit and without st on their date, and the absolute error of score to label; no mask is no limit."""
    m = rows.join(masks, ["code", "date"], "left")
    return m.filter(~F.coalesce("limited", F.lit(False)) & (F.coalesce("is_st", F.lit(0)) == 0)).withColumn("error", F.abs(F.col("score") - F.col("label"))).drop("limited", "is_st")
