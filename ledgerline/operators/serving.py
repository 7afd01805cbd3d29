"""What a daily run needs: which dates to fetch and to compute again, and scores from frozen models down to a day's candidates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import staged
from ledgerline.operators.panel import top_per_date

GRAINS = ("trading", "calendar", "event", "snapshot")


# -- fetching --------------------------------------------------------------------------------------------------------------
def retried(call: Callable[[], Any], tries: int = 3, wait: float = 2.0, pause: Callable[[float], None] = time.sleep) -> Any:
    """The call's value; after a failure it pauses wait, 2 * wait, 4 * wait and so on, and the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k + 1 == tries:
                raise
            pause(wait * 2**k)


def fetch_dates(calendar: DataFrame, pending: DataFrame, today: Column, grains: dict[str, str], open_days: int = 5, days: int = 7) -> DataFrame:
    """source, date to fetch: a trading source's last open_days open days, a calendar source's last `days` days, and their pending
    dates, up to today. Sources of events and snapshots are fetched without dates and give no row. calendar: date; pending:
    source, date."""
    if bad := set(grains.values()) - set(GRAINS):
        raise ValueError(f"no such grain: {sorted(bad)}")
    dated = calendar.sparkSession.createDataFrame([(s, g) for s, g in sorted(grains.items()) if g in GRAINS[:2]], "source string, grain string")
    opens = calendar.select("date").distinct().filter(F.col("date") <= today).orderBy(F.desc("date")).limit(open_days)
    trading = dated.filter("grain = 'trading'").crossJoin(opens).select("source", "date")
    plain = dated.filter("grain = 'calendar'").select("source", F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("date"))
    late = pending.filter(F.col("date") <= today).join(dated, "source", "left_semi").select("source", "date")
    return trading.unionByName(plain).unionByName(late).distinct()


def announced(rows: DataFrame, at: str, today: Column, days: int = 90) -> DataFrame:
    """Rows announced in the last `days` days, to be fetched and written again as late ones still come in."""
    return rows.filter((F.col(at) >= F.date_sub(today, days)) & (F.col(at) <= today))


def with_factor(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """daily with its adj_factor; NULL where none has come in."""
    return daily.join(factors.select("code", "date", "adj_factor"), ["code", "date"], "left")


def unknown_codes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows' distinct codes that `known` lacks; its codes are never NULL."""
    return rows.select("code").distinct().join(known.select("code"), "code", "left_anti")


# -- computing again -------------------------------------------------------------------------------------------------------
def recomputed(rows: DataFrame, targets: DataFrame, dates_back: int, stages: list[dict[str, str]], columns: list[str]) -> DataFrame:
    """code, date and staged columns of the target dates only, from the rows since the look-back's first date: the earliest of
    the last dates_back distinct dates up to the first target."""
    first = targets.agg(F.min("date").alias("_first"))
    upto = rows.select("date").distinct().join(first, F.col("date") <= F.col("_first"))
    anchor = upto.orderBy(F.desc("date")).limit(dates_back).agg(F.min("date").alias("_anchor"))
    used = rows.join(F.broadcast(anchor), F.col("date") >= F.col("_anchor")).drop("_anchor")
    return staged(used, stages).join(targets.select("date").distinct(), "date", "left_semi").select("code", "date", *columns)


# -- scores ----------------------------------------------------------------------------------------------------------------
def live_scores(raw: DataFrame, slope: DataFrame) -> DataFrame:
    """Scores of a frozen model times its slope, the one row of `slope`."""
    return raw.crossJoin(F.broadcast(slope.select("slope"))).withColumn("score", F.col("score") * F.col("slope")).drop("slope")


def aligned(rows: DataFrame, flags: DataFrame, names: list[str]) -> DataFrame:
    """rows with the named flags by code and date; false where there is none."""
    joined = rows.join(flags.select("code", "date", *names), ["code", "date"], "left")
    return joined.withColumns({n: F.coalesce(F.col(n).cast("boolean"), F.lit(False)) for n in names})


def candidates(scores: DataFrame, held: DataFrame, st: DataFrame, delisted: DataFrame, k: int) -> DataFrame:
    """The k best of each date, ties to smaller codes, but for codes held or st on the date or delisted by it."""
    out = held.select("code", "date").unionByName(st.filter("is_st = 1").select("code", "date"))
    free = scores.join(out, ["code", "date"], "left_anti").join(delisted, "code", "left")
    return top_per_date(free.filter(F.col("delist_date").isNull() | (F.col("delist_date") > F.col("date"))), "score", k)


def day_levels(parts: dict[str, DataFrame], dates: DataFrame | None = None) -> DataFrame:
    """date, n_parts, level: full where all parts have a score of the date, partial where some have, placeholder where none has, of the dates asked for (or
    else of those that any part has). parts: code, date, score."""
    seen = reduce(DataFrame.unionByName, (p.filter("score is not null").select("date", F.lit(n).alias("part")) for n, p in parts.items()))
    n = seen.groupBy("date").agg(F.count_distinct("part").alias("n_parts"))
    if dates is not None:
        n = dates.select("date").distinct().join(n, "date", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))
    return n.withColumn("level", F.when(F.col("n_parts") == len(parts), "full").when(F.col("n_parts") > 0, "partial").otherwise("placeholder"))


def target_date(artefacts: list[DataFrame], panel: DataFrame, asked: Column | None = None) -> DataFrame:
    """target, level: the date asked for, else the latest of the artefacts and the panel. stored where an artefact has the date,
    live where only the panel's last date is it, else placeholder."""
    stored = reduce(DataFrame.unionByName, (a.select("date") for a in artefacts)).distinct()
    want = F.coalesce(asked, F.greatest("_a", "_p")) if asked is not None else F.greatest("_a", "_p")
    ends = stored.agg(F.max("date").alias("_a")).crossJoin(panel.agg(F.max("date").alias("_p"))).select(want.alias("target"), "_p")
    at = ends.join(stored, F.col("date") == F.col("target"), "left")
    return at.select("target", F.when(F.col("date").isNotNull(), "stored").when(F.col("target") == F.col("_p"), "live").otherwise("placeholder").alias("level"))


def builders_of(factors: Iterable[str], prefixes: Iterable[str], builders: dict[str, Callable]) -> dict[str, Callable]:
    """The builders of the factors that begin with one of the prefixes; an error where one has none."""
    made = sorted({f for f in factors if f.startswith(tuple(prefixes))})
    if lacking := [f for f in made if f not in builders]:
        raise ValueError(f"no builder for {lacking}")
    return {f: builders[f] for f in made}
