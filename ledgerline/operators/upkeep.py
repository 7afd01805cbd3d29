"""Upkeep of keyed tables: ranges, columns, counters, rebuilds, and sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["code", "date"]


# -- changes -------------------------------------------------------------------------------------------------------------
def replace_range(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each code of new, its rows replace all old ones from their first date on."""
    first = new.groupBy("code").agg(F.min("date").alias("_from"))
    kept = old.join(first, "code", "left").filter(F.col("_from").isNull() | (F.col("date") < F.col("_from"))).drop("_from")
    return kept.unionByName(new)


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def count_attempts(old: DataFrame, failed: DataFrame, keys: list[str], most: int) -> DataFrame:
    """One more attempt for each key that failed, a first one if it is new; dead from `most` on, else pending."""
    n = failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    both = old.select(*keys, "attempts").join(n, keys, "full")
    total = F.coalesce("attempts", F.lit(0)) + F.coalesce("_more", F.lit(0))
    return both.select(*keys, total.cast("long").alias("attempts"), F.when(total >= most, "dead").otherwise("pending").alias("status"))


def update_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of new on rows that exist; rows that old lacks are not added, columns that it lacks are. Where new has the key,
    its value counts, NULL too."""
    own = [c for c in new.columns if c not in keys]
    n = new.select(*keys, F.struct(*own).alias("_new"))
    both = ensure_columns(old, {c: dict(new.dtypes)[c] for c in own}).join(n, keys, "left")
    columns = [c for c in [*old.columns, *(c for c in own if c not in old.columns)] if c not in keys]
    return both.select(*keys, *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in columns))


def ensure_columns(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns that lack are added as NULL."""
    return rows.select("*", *(F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in rows.columns))


def rebuild(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """new instead of old, of rows of one key the last by order, of equal ones that with the largest other columns; columns that only old has keep their values by
    key."""
    rest = [F.col(c).desc_nulls_last() for c in new.columns if c not in (*keys, order)]
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *rest)
    once = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", order)
    foreign = [c for c in old.columns if c not in new.columns]
    return once.join(old.select(*keys, *foreign), keys, "left")


def prioritised(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both; rows of first win."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_p")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def delist_dates(events: DataFrame, authority: DataFrame) -> DataFrame:
    """code, delist_date: from the authority, or else the first event that ends a listing."""
    found = events.groupBy("code").agg(F.min("start_date").alias("_found"))
    return authority.select("code", F.col("delist_date").alias("_said")).join(found, "code", "full").select("code", F.coalesce("_said", "_found").alias("delist_date")).filter("delist_date is not null")


# -- sets of rows --------------------------------------------------------------------------------------------------------
def row_set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, only in a, only in b."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(n(in_a & in_b).alias("common"), n(in_a & ~in_b).alias("extra"), n(~in_a & in_b).alias("missing"))


def calendar_gaps(calendar: DataFrame, rows: DataFrame) -> DataFrame:
    """Open days between the table's first and last that it lacks."""
    span = rows.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    days = calendar.join(F.broadcast(span), (F.col("date") >= F.col("_lo")) & (F.col("date") <= F.col("_hi"))).select("date")
    return days.join(rows.select("date").distinct(), "date", "left_anti")


def target_dates(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (p.select("date") for p in parts)).distinct()


def every_nth_date(rows: DataFrame, step: int, most: int) -> DataFrame:
    """Of the distinct dates, newest first, every step-th from the newest; `most` of them."""
    w = Window.orderBy(F.desc("date"))
    return rows.select("date").distinct().withColumn("_k", F.row_number().over(w) - 1).filter((F.col("_k") % step == 0) & (F.col("_k") < step * most)).select("date")


# -- cells and codes ---------------------------------------------------------------------------------------------------------
def null_out(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all of the columns are NULL are dropped."""
    return rows.dropna("all", subset=columns)


def with_suffix(code: Column) -> Column:
    """The first six characters of a code with a market suffix."""
    return F.substring(code, 1, 6)
