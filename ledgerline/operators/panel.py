"""Operators over panels (code, date, ...): cross-section, labels, splits, membership, table upkeep, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import ieee_div, sdiv

#: Of the ratios of a weighted median.
RANGES = 64
#: Rows of a date with a rank correlation.
LEAST = 5


def by_code():
    return Window.partitionBy("code").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def over(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def average_rank(x: str, *by: str) -> Column:
    """Ranks from 1, ties averaged; NULLs apart. One window: one sort, and rows dealt by `by` only."""
    w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2)


# -- cross-section -----------------------------------------------------------------------------------------------
def top_per_date(rows: DataFrame, score: str, k: int) -> DataFrame:
    w = by_date().orderBy(F.col(score).desc_nulls_last(), "code")
    return rows.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def neutral(x: str, *group: str) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy("date", *group))


def scaled(x: str, to: float = 1.0) -> Column:
    return sdiv(F.col(x) * to, F.sum(F.abs(x)).over(by_date()))


def zscore(x: str) -> Column:
    return sdiv(F.col(x) - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date()))


def residual(y: str, x: str) -> Column:
    """Of the cross-sectional regression of y on x."""
    slope = sdiv(F.covar_pop(y, x).over(by_date()), F.var_pop(F.when(F.col(y).isNotNull(), F.col(x))).over(by_date()))
    both = lambda c: F.avg(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.col(c))).over(by_date())
    return F.col(y) - both(y) - slope * (F.col(x) - both(x))


def ts_rank(x: str, n: int) -> Column:
    """Share of the last n values that are at most this one; NULL before n rows."""
    w = over(n)
    seen = F.collect_list(F.col(x)).over(w)
    return F.when(F.count(x).over(w) == n, F.size(F.filter(seen, lambda v: v <= F.col(x))) / F.lit(n))


def ts_argmax(x: str, n: int) -> Column:
    """Date of the greatest of the last n values, the latest of equals; NULL before n rows."""
    w = over(n)
    return F.when(F.count(x).over(w) == n, F.max_by("date", F.struct(x, "date")).over(w))


def longest_run(rows: DataFrame, cond: Column, name: str) -> DataFrame:
    """Rows so far without a break for which cond holds, this one included."""
    broke = F.sum(F.when(cond, 0).otherwise(1)).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    with_break = rows.withColumn("_b", broke)
    hit = F.when(cond, 1).otherwise(0)
    return with_break.withColumn(name, F.sum(hit).over(Window.partitionBy("code", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def days_since(cond: Column) -> Column:
    """Calendar days since cond last held; NULL before."""
    held = F.last(F.when(cond, F.col("date")), ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return F.datediff("date", held).cast("long")


# -- labels and splits ----------------------------------------------------------------------------------------------
def forward_label(first: int, last: int, base: str = "next_open") -> Column:
    """Median of the opens first to last rows ahead over a base price, less one; rows that lack are left out of the median."""
    bases = {"next_open": F.lead("open", 1).over(by_code()), "open": F.col("open"), "close": F.col("close")}
    if base not in bases:
        raise ValueError(f"unknown base {base!r}")
    ahead = F.sort_array(F.array_compact(F.array(*(F.lead("open", k).over(by_code()) for k in range(first, last + 1)))))
    n = F.size(ahead)
    lower, upper = F.try_element_at(ahead, ((n + 1) / 2).cast("int")), F.try_element_at(ahead, (n / 2).cast("int") + 1)
    return F.when(n > 0, sdiv((lower + upper) / 2, bases[base]) - 1)


def limit_mask(st: Column, wide: float = 0.10, narrow: float = 0.05, tol: float = 0.0005) -> Column:
    """The next open is at a price limit: within the tolerance of the wide band, or of the narrow one for st rows."""
    r = sdiv(F.lead("open", 1).over(by_code()), F.when(F.col("close") > 0, F.col("close")))
    out = lambda b: (r >= 1 + b - tol) | (r <= 1 - b + tol)
    return F.coalesce(out(wide) | (st & out(narrow)), F.lit(False))


def reaches(rows: int, start: Column) -> Column:
    """One of the code's next rows lies at or after start."""
    return F.coalesce(F.greatest(*(F.lead("date", k).over(by_code()) for k in range(1, rows + 1))) >= start, F.lit(False))


def date_axis(rows: DataFrame) -> DataFrame:
    """Distinct dates with positions from 0, one row a date."""
    return rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


# -- membership ------------------------------------------------------------------------------------------------------
def intervals(snapshots: DataFrame) -> DataFrame:
    """Snapshots (effective_date, code) as half-open intervals [eff, next_eff)."""
    eff = snapshots.select("effective_date").distinct().withColumn("next_eff", F.lead("effective_date").over(Window.orderBy("effective_date")))
    return snapshots.join(eff, "effective_date")


def members_only(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows whose code is a member on their date: equal codes, and the date within the interval."""
    i = intervals(snapshots).select(F.col("code").alias("_c"), "effective_date", "next_eff")
    inside = (F.col("date") >= F.col("effective_date")) & (F.col("next_eff").isNull() | (F.col("date") < F.col("next_eff")))
    return rows.join(i, (F.col("code") == F.col("_c")) & inside, "left_semi")


# -- tables ----------------------------------------------------------------------------------------------------------
def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of new that old lacks become rows; of keys in both, only the columns that new has change."""
    own = [c for c in new.columns if c not in keys]
    n = new.withColumns({f"_n_{c}": F.col(c) for c in own}).drop(*own).withColumn("_in", F.lit(True))
    both = old.join(n, keys, "full")
    kept = [F.when(F.col("_in"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in old.columns if c not in keys]
    added = [F.col(f"_n_{c}").alias(c) for c in own if c not in old.columns]
    return both.select(*keys, *kept, *added)


def fill_nulls(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    n = new.select(*keys, F.col(column).alias("_new"))
    return old.join(n, keys, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def missing_dates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Dates of the source, from the target's first on, that the target lacks."""
    first = target.agg(F.min("date").alias("_first"))
    return source.select("date").distinct().join(target.select("date").distinct(), "date", "left_anti").join(first, F.col("date") >= F.col("_first")).select("date")


def latest_events(events: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of the greatest `by` for each key; of equal ones the least by the other columns, so that reruns agree."""
    rest = [F.col(c).asc_nulls_last() for c in events.columns if c not in (*keys, by)]
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *rest)
    return events.distinct().withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


# -- evaluation ------------------------------------------------------------------------------------------------------
def rank_ic(rows: DataFrame, x: str, y: str, least: int = LEAST) -> DataFrame:
    """Per date the correlation of average ranks, over rows with both; dates with fewer than least rows or with constant
    ranks are left out."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("date", x, y)
    ranked = both.withColumns({"_x": average_rank(x, "date"), "_y": average_rank(y, "date")})
    ic = sdiv(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), ic.alias("ic")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ics: DataFrame) -> DataFrame:
    out = ics.agg(F.count("ic").alias("n_periods"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.min("ic").alias("min"), F.max("ic").alias("max"))
    return out.withColumn("ir", F.coalesce(sdiv(F.col("mean"), F.col("std")), F.when(F.col("n_periods") > 0, F.lit(0.0))))


def deciles(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mean label of each tenth of a date's rows by score; rows that lack either are left out before the ranking. rho: the rank
    correlation of tenth and mean label, where there are all ten."""
    both = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    pct = average_rank(score, "date") / F.count(F.lit(1)).over(by_date())
    means = both.withColumn("decile", F.least(F.floor(pct * 10), F.lit(9)).cast("long")).groupBy("decile").agg(F.avg(label).alias("mean_label"), F.count(F.lit(1)).alias("n"))
    ten = Window.partitionBy()  # ten rows
    ranked = means.withColumn("_r", average_rank("mean_label"))
    rho = sdiv(F.covar_pop("decile", "_r").over(ten), F.stddev_pop("decile").over(ten) * F.stddev_pop("_r").over(ten))
    return ranked.select("decile", "mean_label", "n", F.when(F.count(F.lit(1)).over(ten) == 10, rho).alias("rho"))


def blend(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of the scores that are present, over the union of the rows; the weights must sum to one."""
    if abs(sum(w for _, w in parts.values()) - 1) > 1e-9:
        raise ValueError("the weights don't sum to one")
    out = None
    for name, (rows, _) in parts.items():
        part = rows.select("code", "date", F.col("score").alias(name))
        out = part if out is None else out.join(part, ["code", "date"], "full")
    total = sum(F.coalesce(F.col(n) * w, F.lit(0.0)) for n, (_, w) in parts.items())
    weight = sum(F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, (_, w) in parts.items())
    return out.withColumn("blend", F.try_divide(total, F.when(weight > 0, weight)))


def finite(c: str) -> Column:
    """Neither NULL nor NaN nor infinite."""
    return F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))


def l1_slope(rows: DataFrame, p: str, y: str) -> DataFrame:
    """The slope through the origin of least absolute error: the first ratio y / p by size at which the running |p| reaches half;
    1 where it isn't above 0. Rows of which either isn't finite are left out. Running sums meet by RANGES of ratios of about equal weight, from a sketch of their quantiles,
    so one row a range meets in one task, whatever the ratios."""
    r = rows.filter(finite(p) & finite(y) & (F.abs(p) > 1e-12)).select((F.col(y) / F.col(p)).alias("r"), F.abs(p).alias("w")).filter("r is not null")
    per = r.groupBy("r").agg(F.sum("w").alias("w"))
    cuts = per.agg(F.percentile_approx("r", [k / RANGES for k in range(1, RANGES)], 10_000).alias("cuts"))
    b = per.crossJoin(F.broadcast(cuts)).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("r")))).select("r", "w", "b")
    sums = b.groupBy("b").agg(F.sum("w").alias("bw"))
    sums = sums.withColumns({"before": F.coalesce(F.sum("bw").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "half": F.sum("bw").over(Window.partitionBy()) / 2})
    at = sums.filter((F.col("before") < F.col("half")) & (F.col("before") + F.col("bw") >= F.col("half")))
    inside = b.join(F.broadcast(at), "b").withColumn("cw", F.col("before") + F.sum("w").over(Window.partitionBy("b").orderBy("r")))
    return inside.filter("cw >= half").agg(F.min("r").alias("k")).select(F.when(F.col("k") > 0, F.col("k")).otherwise(1.0).alias("slope"))


def calibration(rows: DataFrame, p: str, y: str, end: Column, tail: int = 60, least: int = 20) -> DataFrame:
    """The slope over the last `tail` dates before end, 1 if they are fewer than `least`, and the median of the scores times it."""
    dates = rows.select("date").distinct().filter(F.col("date") < end).orderBy(F.desc("date")).limit(tail)
    used = rows.join(F.broadcast(dates), "date", "left_semi").filter(finite(p) & finite(y) & (F.abs(p) > 1e-12))
    enough = dates.agg(F.count(F.lit(1)).alias("n_days"))
    k = l1_slope(used, p, y).crossJoin(enough).select("n_days", F.when(F.col("n_days") >= least, F.col("slope")).otherwise(1.0).alias("slope"))
    return used.agg(F.median(p).alias("m")).crossJoin(k).select("n_days", "slope", F.when(F.col("n_days") >= least, F.col("m") * F.col("slope")).alias("median"))


def equity_stats(equity: DataFrame, rf: float = 0.025, year: float = 252.0, least: int = 5) -> DataFrame:
    """equity: date, value; one row a date. Sharpe and Sortino from the mean daily return, Calmar from the compound annual return;
    0 where a denominator is 0. Fewer than `least` returns give n_days only."""
    w = Window.orderBy("date")
    d = equity.withColumns({"r": sdiv(F.col("value"), F.lag("value").over(w)) - 1, "top": F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    a = d.agg(F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"), F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min(sdiv(F.col("value"), F.col("top")) - 1).alias("dd"), F.count(F.when(F.col("r") > 0, 1)).alias("wins"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"))
    or_zero = lambda x: F.coalesce(x, F.lit(0.0))
    annual = F.pow(F.col("v1") / F.col("v0"), F.lit(year) / F.col("n")) - 1
    root = F.sqrt(F.lit(year))
    out = {
        "total_return": F.col("v1") / F.col("v0") - 1, "annual_return": annual,
        "sharpe": or_zero(sdiv(F.col("mean") * year - rf, F.col("sd") * root)), "sortino": or_zero(sdiv(F.col("mean"), F.col("down")) * root),
        "max_drawdown": or_zero(F.col("dd")), "calmar": or_zero(sdiv(annual, F.abs("dd"))), "win_rate": sdiv(F.col("wins"), F.col("n")),
    }
    return a.select(*(F.when(F.col("n") >= least, c).alias(n) for n, c in out.items()), F.col("n").alias("n_days"))


def fifo_trips(trades: DataFrame, endless: bool = False) -> DataFrame:
    """Trades (code, date, action, shares, price) as trips: each sold share against the oldest held one, by the overlap of the
    running share counts of buys and sells. Trades of a date go by price, then by shares; a trip that was bought for nothing has no return,
    or, if endless, an infinite one (NaN if it was sold for nothing), as the SQL has it."""
    w = Window.partitionBy("code", "action").orderBy("date", "price", "shares").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("hi", F.sum("shares").over(w)).withColumn("lo", F.col("hi") - F.col("shares"))
    b, s = t.filter("action = 'BUY'").alias("b"), t.filter("action = 'SELL'").alias("s")
    both = b.join(s, [F.col("b.code") == F.col("s.code"), F.col("b.lo") < F.col("s.hi"), F.col("s.lo") < F.col("b.hi")])
    shares = F.least("b.hi", "s.hi") - F.greatest("b.lo", "s.lo")
    return both.select("b.code", F.col("b.date").alias("bought"), F.col("s.date").alias("sold"), shares.alias("shares"), F.datediff("s.date", "b.date").alias("days"), ((ieee_div if endless else sdiv)(F.col("s.price"), F.col("b.price")) - 1).alias("trip_return"))


def trip_summary(trips: DataFrame) -> DataFrame:
    """Trips, the mean and median of the days that they were held, their mean return, how often it was above 0, and its t value: the mean by its standard
    error, NULL for fewer than two trips; as floating point has it, an endless return makes the mean endless and leaves no t (NaN), and neither do returns that are all 0."""
    a = trips.agg(F.count(F.lit(1)).alias("n"), F.avg("days").alias("mean_days"), F.median("days").alias("median_days"), F.avg("trip_return").alias("mean_return"), F.avg((F.col("trip_return") > 0).cast("double")).alias("win_rate"), F.stddev_samp("trip_return").alias("_sd"))
    return a.withColumn("t", ieee_div(F.col("mean_return") * F.sqrt("n"), F.col("_sd"))).drop("_sd")
