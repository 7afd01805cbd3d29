"""Column helpers for panels: rows keyed by code and date. Formulas are SQL expressions in named stages, so that what several
formulas share is computed once and windows of one shape meet in one operator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY_CODE = "partition by code order by date"


def frame(n: int) -> str:
    """The last n rows of a code, this one included."""
    return f"over ({BY_CODE} rows between {n - 1} preceding and current row)"


def roll(fn: str, x: str, n: int, least: int = 1) -> str:
    """fn over the last n rows, NULL where fewer than least of them have a value."""
    out = f"{fn}({x}) {frame(n)}"
    return out if least <= 1 else f"case when count({x}) {frame(n)} >= {least} then {out} end"


def block(n: int) -> int | None:
    """The length of equal blocks that make up a long window; ten where it can be, so that windows share a sort. None: not worth it."""
    return next((m for m in (10, 12, 9, 14) if n % m == 0), None) if n >= 80 else None


def stride(n: int, m: int, at: str) -> str:
    """The rows that end the blocks of m rows of the last n; at: the number of a row within its code. A function of m rows and then of these n / m
    costs a row m + n / m steps instead of n."""
    return f"over (partition by code, {at} % {m} order by date rows between {n // m - 1} preceding and current row)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({BY_CODE})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) over ({BY_CODE})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def shrunk_corr(x: str, y: str, n: int) -> str:
    """Population covariance over sample deviations: the correlation times (n - 1) / n; all n rows must have both."""
    both = f"case when {x} is not null and {y} is not null then 1 end"
    return f"case when count({both}) {frame(n)} = {n} then {div(f'covar_pop({x}, {y}) {frame(n)}', f'stddev_samp({x}) {frame(n)} * stddev_samp({y}) {frame(n)}')} end"


def centred_rank(x: str, by: str = "date") -> str:
    """(average rank - 0.5) / n - 0.5 within a date; NULL stays NULL and isn't counted. As standard SQL; Spark gets sorted_rank."""
    some = f"case when {x} is null then 1 else 0 end"
    rank = f"(rank() over (partition by {by}, {some} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0D)"
    return f"case when {x} is not null then ({rank} - 0.5D) / count({x}) over (partition by {by}) - 0.5D end"


def mean_rank(x: str) -> tuple[str, str]:
    """The average rank of x within a date, and how many of its values there are, by windows of one shape: one sort, and rows dealt by date only."""
    w = f"over (partition by date order by {x} nulls last"
    return f"((rank() {w}) + count(*) {w} range between unbounded preceding and current row)) / 2.0D)", f"count({x}) {w} rows between unbounded preceding and unbounded following)"


def sorted_rank(x: str) -> str:
    """centred_rank within a date."""
    rank, n = mean_rank(x)
    return f"case when {x} is not null then ({rank} - 0.5D) / {n} - 0.5D end"


def staged(rows: DataFrame, stages: list[dict[str, str]], parts: int | None = None) -> DataFrame:
    """rows with the stages' columns. Of a stage, windows that need the rows where they are come first, so that rows change places once for a change from
    codes to dates or back; parts: into how many, as Spark has it if none are given."""
    at = "code"
    for stage in stages:
        for by in sorted(("code", "date"), key=lambda k: k != at):
            some = {n: e for n, e in stage.items() if ("date" if "partition by date" in e else "code") == by}
            if by != at and some:
                rows, at = dealt(rows, by, parts), by
            if some:
                rows = rows.selectExpr("*", *(f"{e} as {n}" for n, e in some.items()))
    return rows


def dealt(rows: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    return rows.repartition(parts, by) if parts else rows.repartition(by)


def sdiv(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ieee_div(a: Column, b: Column) -> Column:
    """Of doubles: by 0 infinite with the sign of a, NaN for 0 / 0."""
    endless = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, endless).otherwise(F.try_divide(a, b))


def sanitised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities as NULL."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return rows.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})


def ewm(rows: DataFrame, x: str, span: int, to: str) -> DataFrame:
    """rows with the exponentially weighted mean of x over all rows of a code so far, weights normalised; x must not be NULL.

    Rows are dealt into stretches of a code in which the oldest weight is still above 2^-500, so that sums of x / decay^k stay
    exact; what comes before a stretch is the running sum of one row a stretch."""
    decay = 1 - 2 / (span + 1)
    long = max(1, int(500 * math.log(2) / -math.log(decay))) if decay > 0 else 1
    code = Window.partitionBy("code").orderBy("date")
    n = rows.withColumn("_n", F.row_number().over(code) - 1).withColumns({"_s": F.floor(F.col("_n") / long), "_k": F.col("_n") % long})
    within = Window.partitionBy("code", "_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    grown = n.withColumns({"_x": F.sum(F.col(x) * F.pow(F.lit(decay), -F.col("_k"))).over(within) * F.pow(F.lit(decay), F.col("_k")), "_w": F.sum(F.pow(F.lit(decay), -F.col("_k"))).over(within) * F.pow(F.lit(decay), F.col("_k"))})
    # a stretch's last sums reach the next one's rows decayed by a whole stretch or more: 2^-500, so only the next needs them
    last = grown.groupBy("code", "_s").agg(F.max_by("_x", "_k").alias("_bx"), F.max_by("_w", "_k").alias("_bw")).withColumn("_s", F.col("_s") + 1)
    back = F.pow(F.lit(decay), F.col("_k") + 1)
    both = grown.join(last, ["code", "_s"], "left").withColumn(to, (F.col("_x") + F.coalesce(F.col("_bx"), F.lit(0.0)) * back) / (F.col("_w") + F.coalesce(F.col("_bw"), F.lit(0.0)) * back))
    return both.select(*rows.columns, to)
