"""As-of joins: for each row the nearest row of another table at, before or after its time.

Both sides are put on one axis and sorted once; the nearest row is carried along by a window function. There is no range join, so nothing is compared
that isn't neighbouring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, columns: list[str], direction: str = "backward", within: Column | None = None, strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """left with `columns` of its nearest right row of equal `by`, NULL where there is none. backward: the last right row at or before `on`
    (strict: before); forward: the first at or after it. Rows of right with one time: the one with the largest columns counts. NULL is a key; NULL times
    find nothing and aren't found. within: true where a match counts, over `on` and `_on`, the match's time.

    bucket: an expression of `on` that never falls as `on` rises, for keys with more rows than a task should sort: each key's buckets are
    then windows of their own, and the nearest row of other buckets comes from one row a bucket."""
    if direction not in ("backward", "forward"):
        raise ValueError(f"no such direction: {direction}")
    back = direction == "backward"
    found = F.struct(F.col(on).alias("_on"), *columns)
    once = right.filter(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(F.struct(*columns)).alias("_c")).select(*by, on, *(F.col(f"_c.{c}").alias(c) for c in columns)).select(*by, on, found.alias("_match"))
    own = left.select(*by, on, F.struct(*(F.col(f"`{c}`").alias(c) for c in left.columns)).alias("_row"), F.lit(None).cast(once.schema["_match"].dataType).alias("_match"))
    # at equal times a right row is met first, unless only earlier (or later) ones count
    both = own.withColumn("_side", F.lit(0 if strict else 1)).unionByName(once.withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)).withColumn("_side", F.lit(1 if strict else 0)))
    if bucket is not None:
        both = both.withColumn("_bucket", bucket)
    keys = [*by, *(["_bucket"] if bucket is not None else [])]
    order = [F.col(on).asc_nulls_first(), F.col("_side").asc()] if back else [F.col(on).desc_nulls_first(), F.col("_side").asc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_m", F.last("_match", ignorenulls=True).over(w))
    if bucket is not None:
        edge = (F.max_by if back else F.min_by)("_match", "_match._on")
        ends = both.filter("_match is not null").groupBy(*keys).agg(edge.alias("_e"))
        every = both.select(*keys).distinct().alias("k").join(ends, [F.col(f"k.{c}").eqNullSafe(ends[c]) for c in keys], "left").select(*(F.col(f"k.{c}") for c in keys), "_e")
        o = Window.partitionBy(*by).orderBy(F.col("_bucket").asc() if back else F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.last("_e", ignorenulls=True).over(o).alias("_carry"))
        near = near.join(carried, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], "left").withColumn("_m", F.coalesce("_m", "_carry"))
    hit = F.col("_m").isNotNull() & F.col(on).isNotNull()
    near = near.filter("_row is not null").withColumn("_on", F.col("_m._on"))
    hit = hit if within is None else hit & F.coalesce(within, F.lit(False))
    return near.select("_row.*", *(F.when(hit, F.col(f"_m.{c}")).alias(c) for c in columns))
