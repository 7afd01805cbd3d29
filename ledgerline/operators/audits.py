"""Audits of what tables hold: values that went stale, days that came in short, and one report of a panel's state.

Each reads a table once by date, and once by code where codes are asked for; what is left to compare has one row a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.asof import asof

KEYS = ["code", "date"]


def differs(stored: Column, fresh: Column, rtol: float, atol: float) -> Column:
    """The fresh value isn't within atol + rtol * |stored| of the stored one. NULL and NaN equal each other; an infinity equals itself only."""
    s, f = stored.cast("double"), fresh.cast("double")
    no = lambda c: c.isNull() | F.isnan(c)
    endless = lambda c: F.abs(c) == float("inf")
    return F.when(no(s) | no(f), ~(no(s) & no(f))).when(endless(s) | endless(f), s != f).otherwise(F.abs(s - f) > atol + rtol * F.abs(s))


def _compared(stored: DataFrame, fresh: DataFrame, columns: list[str], rtol: float, atol: float) -> DataFrame:
    """One join on the keys; a flag for each column."""
    s, f = (rows.select(*KEYS, F.struct(*(F.col(c).cast("double").alias(c) for c in columns)).alias(n)) for rows, n in ((stored, "_s"), (fresh, "_f")))
    return s.join(f, KEYS).select(*KEYS, *(differs(F.col(f"_s.{c}"), F.col(f"_f.{c}"), rtol, atol).alias(c) for c in columns))


def _by_column(counts: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """One row with columns name_column -> column, name..."""
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{n}_{c}").alias(n) for n in names)) for c in columns))).alias("r")).select("r.*")


def stale_cells(stored: DataFrame, fresh: DataFrame, columns: list[str], rtol: float = 1e-4, atol: float = 1e-12) -> DataFrame:
    """Per column: cells of keys that both have, and those whose fresh value differs from the stored one."""
    flags = _compared(stored, fresh, columns, rtol, atol)
    counts = flags.agg(*(F.count(F.lit(1)).alias(f"cells_{c}") for c in columns), *(F.count(F.when(F.col(c), 1)).alias(f"stale_{c}") for c in columns))
    return _by_column(counts, columns, "cells", "stale")


def sampled_dates(rows: DataFrame, n: int) -> DataFrame:
    """About n dates, evenly: every k-th from the first on, at most n."""
    axis = rows.select("date").distinct().withColumns({"_k": F.row_number().over(Window.orderBy("date")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})  # one row a date
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return axis.filter((F.col("_k") % step == 0) & (F.col("_k") < step * n)).select("date")


def staleness_audit(stored: DataFrame, fresh: DataFrame, members: DataFrame, columns: list[str], n_dates: int = 20, rtol: float = 1e-4, atol: float = 1e-12, left_out: tuple[str, ...] = (), left_out_ends: tuple[str, ...] = ("_rank",)) -> DataFrame:
    """date, rows, drifted_rows, drifted_codes and drifted_<column> for about n_dates dates from the first date of members (code, date) on. Only rows of
    members are compared; columns that depend on who else is in the table are left out. Codes drift in whole: a code counts once a date."""
    used = [c for c in columns if c not in left_out and not c.endswith(left_out_ends)]
    era = members.agg(F.min("date").alias("_era"))
    dates = sampled_dates(stored.join(era, F.col("date") >= F.col("_era")).select("date"), n_dates)
    own = members.join(dates, "date", "left_semi").select(*KEYS).distinct()
    flags = _compared(stored.join(own, KEYS, "left_semi"), fresh.join(own, KEYS, "left_semi"), used, rtol, atol)
    bad = reduce(lambda a, b: a | b, (F.col(c) for c in used))
    return flags.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("drifted_rows"), F.count_distinct(F.when(bad, F.col("code"))).alias("drifted_codes"), *(F.count(F.when(F.col(c), 1)).alias(f"drifted_{c}") for c in used))


def look_ahead(full: DataFrame, cut: DataFrame, columns: list[str]) -> DataFrame:
    """Values on dates of cut that change when later rows are taken away: per column, how many. Anything above 0 leaks."""
    return stale_cells(cut, full, columns, rtol=1e-9).select("column", "cells", F.col("stale").alias("leaks"))


# -- days that came in -------------------------------------------------------------------------------------------------------
def pull_checks(rows: DataFrame, asked: DataFrame, column: str | None = None, drop: float = 0.7, nulls: float = 0.01) -> DataFrame:
    """date, n, usual, wrong for each asked date that is wrong, by the first fault: `empty` (no rows), `rows` (fewer than `drop` times the median of the 20 dates
    with rows before), `nulls` (a larger share of the column is NULL). More rows than usual are no fault. The median of an even number of dates is the mean of
    the middle two; without dates before there is no `rows` fault."""
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(column) if column else F.lit(0)).alias("n_null"))
    last = F.sort_array(F.collect_list("n").over(Window.orderBy("date").rowsBetween(-19, 0)))  # one row a date
    middle = (F.element_at("_l", F.floor((F.size("_l") + 1) / 2).cast("int")) + F.element_at("_l", F.floor(F.size("_l") / 2 + 1).cast("int"))) / 2
    upto = days.withColumn("_l", last).select("date", middle.alias("usual"))
    checked = asof(asked.select("date").distinct(), upto, [], "date", ["usual"], strict=True).join(days, "date", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = F.when(F.col("n") == 0, "empty").when(F.col("n") < drop * F.col("usual"), "rows").when(F.col("n_null") > nulls * F.col("n"), "nulls")
    return checked.select("date", "n", "usual", wrong.alias("wrong")).filter("wrong is not null")


# -- the state of a panel ------------------------------------------------------------------------------------------------------
def integrity_report(panel: DataFrame, calendar: DataFrame, bars: DataFrame, columns: list[str], vital: list[str], factor: str = "adj_factor", evening: bool = True, coverage: float = 0.95, window: int = 250, null_share: float = 0.3) -> DataFrame:
    """check, severity, found, of a panel and the bars it is made from; calendar: the open days up to now.

    `latest day` is hard: the last open day has no rows in the panel though bars have it, or, in the evening, bars lack it too (before that it is soft).
    Soft: `holes` (dates of bars since the panel's first that it lacks), `panel drift` and `bars drift` (the last date's rows differ by over 30 % from the upper
    median of the 20 dates before), `factor nulls` (over 1 % NULL on the last open day), `panel calendar` and `bars calendar` (open days within the table's range that it
    lacks), `value health` (vital columns of which under half is there on the last open day), `short codes` and `short rows` (codes of bars with under `coverage` of their
    rows since the panel's first date, and the rows they lack), `null rate` (columns with over null_share NULL in the panel's last `window` dates). found is a
    count; 0 is good."""
    every = list(dict.fromkeys([*columns, *vital]))
    p = panel.groupBy("date").agg(F.count(F.lit(1)).alias("pn"), *(F.count(c).alias(f"p_{c}") for c in every))
    b = bars.groupBy("date").agg(F.count(F.lit(1)).alias("bn"), (F.count(F.lit(1)) - F.count(factor)).alias("b_null"))
    days = calendar.select("date").distinct().withColumn("open", F.lit(True)).join(p, "date", "full").join(b, "date", "full").withColumn("open", F.coalesce("open", F.lit(False)))
    n = lambda c: F.count(F.when(c, 1))
    back = lambda c: F.row_number().over(Window.orderBy(F.col(c).isNull(), F.desc("date")))  # noqa: E731 - one row a date
    edge = lambda f, c: f(F.when(F.col(c).isNotNull(), F.col("date"))).over(Window.partitionBy())
    d = days.withColumns({"pk": back("pn"), "bk": back("bn"), "p_lo": edge(F.min, "pn"), "p_hi": edge(F.max, "pn"), "b_lo": edge(F.min, "bn"), "b_hi": edge(F.max, "bn"), "now": F.max(F.when(F.col("open"), F.col("date"))).over(Window.partitionBy())})
    today, has_p, has_b, opened = F.col("date") == F.col("now"), F.col("pn").isNotNull(), F.col("bn").isNotNull(), F.col("open")

    def drift(count: str, k: str) -> Column:
        before = F.sort_array(F.collect_list(F.when(F.col(k).between(2, 21), F.col(count))))
        usual, last = F.try_element_at(before, (F.floor(F.size(before) / 2) + 1).cast("int")), F.max(F.when(F.col(k) == 1, F.col(count)))
        return F.coalesce((F.abs(last - usual) > 0.3 * usual).cast("long"), F.lit(0))

    recent = F.col("pk") <= window
    total = F.sum(F.when(recent & has_p, F.col("pn")))
    ill = lambda c: F.coalesce(F.max(F.when(today & has_p, (F.col(f"p_{c}") < 0.5 * F.col("pn")).cast("long"))), F.lit(0))
    rare = lambda c: F.coalesce((F.sum(F.when(recent & has_p, F.col(f"p_{c}"))) < (1 - null_share) * total).cast("long"), F.lit(0))
    found = d.agg(
        n(today & ~has_p & has_b).alias("made"), n(today & ~has_p & ~has_b).alias("pulled"), n(has_b & ~has_p & (F.col("p_lo").isNull() | (F.col("date") >= F.col("p_lo")))).alias("holes"),
        drift("pn", "pk").alias("p_drift"), drift("bn", "bk").alias("b_drift"), n(today & (F.col("b_null") > 0.01 * F.col("bn"))).alias("nulls"),
        n(opened & ~has_p & F.col("date").between(F.col("p_lo"), F.col("p_hi"))).alias("p_cal"), n(opened & ~has_b & F.col("date").between(F.col("b_lo"), F.col("b_hi"))).alias("b_cal"),
        (sum((ill(c) for c in vital), F.lit(0))).alias("ill"), (sum((rare(c) for c in columns), F.lit(0))).alias("rare"), F.min("p_lo").alias("p_lo"), F.max("p_hi").alias("p_hi"),
    )
    since = bars.join(found.select("p_lo", "p_hi"), F.col("date").between(F.col("p_lo"), F.col("p_hi")))
    codes = since.groupBy("code").agg(F.count(F.lit(1)).alias("k")).join(panel.groupBy("code").agg(F.count(F.lit(1)).alias("f")), "code", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    short = codes.filter(F.col("f") < coverage * F.col("k")).agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum(F.col("k") - F.col("f")), F.lit(0)).alias("lack"))
    named = [
        ("latest day, panel", "hard", "made"), ("latest day, bars", "hard" if evening else "soft", "pulled"), ("holes", "soft", "holes"), ("panel drift", "soft", "p_drift"), ("bars drift", "soft", "b_drift"), ("factor nulls", "soft", "nulls"),
        ("panel calendar", "soft", "p_cal"), ("bars calendar", "soft", "b_cal"), ("value health", "soft", "ill"), ("null rate", "soft", "rare"), ("short codes", "soft", "codes"), ("short rows", "soft", "lack"),
    ]
    return found.crossJoin(short).select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.col(v).cast("long").alias("found")) for c, s, v in named))).alias("r")).select("r.*")


def coverage(pool: DataFrame, bars: DataFrame, panel: DataFrame, least: float = 0.95) -> DataFrame:
    """code, due, there: codes of the pool with less than `least` of the rows that they have in bars since the panel's first date; codes without bars are due nothing."""
    n = lambda rows, to: rows.groupBy("code").agg(F.count(F.lit(1)).alias(to))
    since = bars.join(panel.agg(F.min("date").alias("_first")), F.col("date") >= F.col("_first"))
    both = pool.select("code").distinct().join(n(since, "due"), "code", "left").join(n(panel, "there"), "code", "left")
    return both.select("code", F.coalesce("due", F.lit(0)).alias("due"), F.coalesce("there", F.lit(0)).alias("there")).filter((F.col("due") > 0) & (F.col("there") < least * F.col("due")))


# -- leaks of a trained model ----------------------------------------------------------------------------------------------------
def leak_checks(axis: DataFrame, calendar: DataFrame, predictions: DataFrame, expected: DataFrame, meta: dict, column: str, reach: int, buffer: int, tail: int, test_start: object, test_end: object, crossing: DataFrame | None = None) -> DataFrame:
    """check, ok of a model's record against what its data say. axis: the training table's dates; calendar: all dates, by whose places a label of `reach` dates
    ahead is followed; predictions and expected: code, date; crossing: rows left out of training as their label reaches the test period; meta: the record (train_start, train_end, test_start,
    test_end, far_crossing, slope, median, n_pred). train_end is the first date that isn't trained on, `buffer` dates of the axis before the test."""
    start, end = F.lit(test_start).cast("date"), F.lit(test_end).cast("date")
    said = lambda k: F.lit(meta.get(k)).cast("date")
    lined = lambda rows: rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)  # noqa: E731 - one row a date
    a, c = lined(axis), lined(calendar)
    train_end = a.join(a.filter(F.col("date") < start).agg(F.greatest(F.count(F.lit(1)) - buffer, F.lit(0)).alias("_p")), F.col("pos") == F.col("_p")).agg(F.max("date").alias("train_end"))
    used = a.crossJoin(train_end).filter(F.col("date") < F.col("train_end"))
    facts = used.agg(F.max("date").alias("last_trained"), F.max("train_end").alias("train_end"), F.count(F.lit(1)).alias("n_trained")).crossJoin(a.agg(F.min("date").alias("first_trained")))
    place = lambda d, to: c.select(F.col("date").alias(d), F.col("pos").alias(to))
    facts = facts.join(place("last_trained", "_last"), "last_trained", "left").crossJoin(c.filter(F.col("date") >= start).agg(F.min("pos").alias("_test")))
    p = predictions.agg(F.min("date").alias("p_lo"), F.max("date").alias("p_hi"), F.count(F.lit(1)).alias("n_pred"))
    keys = lambda rows, n: rows.select(*KEYS).distinct().withColumn(n, F.lit(1))
    sets = keys(predictions, "_g").join(keys(expected, "_w"), KEYS, "full").agg(F.count(F.when(F.col("_w").isNull(), 1)).alias("extra"), F.count(F.when(F.col("_g").isNull(), 1)).alias("missing"))
    far = (crossing if crossing is not None else predictions.limit(0)).agg(F.count(F.lit(1)).alias("far"))
    one = facts.crossJoin(p).crossJoin(sets).crossJoin(far)
    held = F.least(F.lit(tail), F.col("n_trained"))
    checks = {
        "train starts where the axis does": F.col("first_trained") == said("train_start"), "train ends a buffer before the test": F.col("train_end") == said("train_end"),
        "last label ends before the test": F.col("_last") + reach < F.col("_test"), "buffer covers the label": F.lit(buffer >= reach), "crossing labels were left out": F.col("far") == F.lit(meta.get("far_crossing")),
        "test period is the record's": (start == said("test_start")) & (end == said("test_end")), "calibration lies in training": held > 0, "record has the calibration": F.lit(meta.get("slope") is not None and meta.get("median") is not None),
        "scores are there": F.lit(column in predictions.columns), "scores lie in the test": (F.col("p_lo") >= start) & (F.col("p_hi") <= end), "scored rows are those expected": (F.col("extra") == 0) & (F.col("missing") == 0), "count is the record's": F.col("n_pred") == F.lit(meta.get("n_pred")),
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()))).alias("r")).select("r.*")
