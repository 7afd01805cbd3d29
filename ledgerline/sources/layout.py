"""Panels as bucketed tables: rows of a code lie together and in order, so windows and joins by code need no exchange.

Tables are in the session's catalogue, under its warehouse or a path that is given; the buckets' number is the table's own and stays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ["code", "date"]


class DuplicateKey(ValueError):
    """Two rows have the same key."""


@dataclass(frozen=True)
class Written:
    rows: int
    inserted: int
    updated: int


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows; raises when they are read if two have the same key. One aggregation by key, which a table bucketed by it has for nothing."""
    if bad := rows.groupBy(*keys).count().filter("count > 1").take(1):
        raise DuplicateKey(", ".join(f"{k}={bad[0][k]}" for k in keys))
    return rows


def save(rows: DataFrame, name: str, buckets: int, keys: list[str] | None = None, path: str | None = None) -> int:
    """Writes the table anew (or for the first time), bucketed and sorted by the first key and sorted by the rest; the number of rows. Keys must be unique."""
    keys = keys or KEYS
    seen = Observation()
    dealt = unique(rows, keys).repartition(buckets, keys[0]).sortWithinPartitions(*keys).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = dealt.write.format("parquet").bucketBy(buckets, keys[0]).sortBy(*keys).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return seen.get["n"]


def buckets_of(spark: SparkSession, name: str) -> int:
    """From the catalogue; 0 for a table without buckets."""
    found = [r.data_type for r in spark.sql(f"describe extended {name}").collect() if r.col_name == "Num Buckets"]
    return int(found[0]) if found else 0


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the columns of new on their keys: keys that old lacks are added, columns that it lacks too; columns that new lacks stay. _was and _is say where a
    key comes from."""
    own = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(F.lit(True).alias("_there"), *(F.col(c) for c in old.columns if c not in keys)).alias("_o"))
    n = new.select(*keys, F.struct(F.lit(True).alias("_there"), *own).alias("_n"))
    columns = [*(c for c in old.columns if c not in keys), *(c for c in own if c not in old.columns)]
    value = lambda c: F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}") if c in old.columns else F.lit(None)) if c in own else F.col(f"_o.{c}")
    return o.join(n, keys, "full").select(*keys, *(value(c).alias(c) for c in columns), F.col("_o._there").alias("_was"), F.col("_n._there").alias("_is"))


def upsert(spark: SparkSession, name: str, new: DataFrame, keys: list[str] | None = None) -> Written:
    """Puts new into the table by key, and says how many keys were new and how many were known. The result is written beside the table and takes its place when it is whole: a
    table under way can't be read, and one that fails leaves the old one as it was."""
    keys = keys or KEYS
    n, seen, beside = buckets_of(spark, name), Observation(), f"{name}__next"
    both = changed(spark.table(name), unique(new, keys), keys)
    count = lambda c: F.count(F.when(c, 1))
    counted = both.observe(seen, F.count(F.lit(1)).alias("rows"), count(F.col("_was").isNull()).alias("inserted"), count(F.col("_was") & F.col("_is")).alias("updated")).drop("_was", "_is")
    dealt = counted.repartition(n, keys[0]).sortWithinPartitions(*keys)
    dealt.write.format("parquet").bucketBy(n, keys[0]).sortBy(*keys).mode("overwrite").saveAsTable(beside)
    spark.sql(f"drop table {name}")
    spark.sql(f"alter table {beside} rename to {name}")
    spark.catalog.refreshTable(name)
    return Written(**seen.get)


def replace_dates(spark: SparkSession, rows: DataFrame, path: str, by: str) -> int:
    """Replaces the partitions of a partitioned table that rows have, and no others; the rows written. A snapshot is one partition. Readers of other partitions
    aren't disturbed; streaming.table has a table whose replacement is atomic."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return seen.get["n"]


# -- columns -----------------------------------------------------------------------------------------------------------------
def lacking(rows: DataFrame, kinds: StructType) -> list[str]:
    """Columns that are asked for and aren't there, or are of another kind."""
    have = dict(rows.dtypes)
    return [f.name for f in kinds if have.get(f.name) != f.dataType.simpleString()]


def without(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows without the columns, of which each must be there: a column that is dropped twice is a mistake."""
    if bad := [n for n in names if n not in rows.columns]:
        raise ValueError(f"no such column: {bad}")
    return reduce(lambda df, c: df.drop(c), names, rows)
