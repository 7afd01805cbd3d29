"""A keyed table of Parquet files that a crash can't harm: files are only ever added, and a manifest says which of them count.

`path`/data/<id>/in_month=YYYY-MM holds rows; `path`/manifests/<version>.json names, for each month, the folder that is its whole content now. A
batch writes the months that it touches anew beside the old ones, then commits by renaming a manifest to the next version's name, which fails if
that exists. A writer lost before the rename leaves files that nothing names; the batch is done again from the old version. A batch
that is repeated after its commit finds its number in the manifest and does nothing.

A manifest is as long as the table has months; rows and their keys never come to the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MONTH = "in_month"


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns; of equal ones that with the largest other columns. NULLs come first,
    and NULL is a key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass
class Manifest:
    version: int = 0
    batch: int = -1
    high: str | None = None  # the latest event time so far
    months: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


class Files:
    """What is needed of the file system, by Spark's own Hadoop client, so that any store it reads will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(path).getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):  # noqa: ANN201 - a Java object
        return self.fs.makeQualified(self.hadoop.Path(name))

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes beside, then renames; fails where the name exists."""
        beside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.jvm.java.lang.reflect.Array.newInstance(getattr(self.hadoop, "Options$Rename")._java_lang_class, 0)
        try:
            self.context.rename(beside, self.path(name), none)
        except Exception as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Table:
    """Rows by key under path. `at` is a date or time and one of the keys; rows of one key: the newest by `order` counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], at: str, order: list[str]) -> None:
        if at not in keys:
            raise ValueError(f"{at} must be one of the keys")
        self.spark, self.root, self.schema, self.keys, self.at, self.order = spark, path, schema, keys, at, order
        self.files = Files(spark, path)

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest version, or an older one."""
        names = [n for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json")]
        if not names and not version:
            return Manifest()
        return Manifest(**json.loads(self.files.read(f"{self.root}/manifests/{names[-1] if version is None else f'{version:020d}.json'}")))

    def read(self, months: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows with their month; only the files of the months asked for are opened."""
        m = self.manifest(version).months
        folders = [f"{self.root}/data/{m[x]}" for x in sorted(m if months is None else set(months) & set(m))]
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        return rows.withColumn(MONTH, F.date_format(self.at, "yyyy-MM"))

    def write(self, rows: DataFrame) -> str:
        """Rows with their month, one folder a month, in a new place that no manifest names yet."""
        place = uuid.uuid4().hex
        rows.write.partitionBy(MONTH).parquet(f"{self.root}/data/{place}")
        return place

    def commit(self, manifest: Manifest) -> Manifest:
        self.files.create(f"{self.root}/manifests/{manifest.version:020d}.json", json.dumps(vars(manifest), sort_keys=True))
        return manifest

    def upsert(self, new: DataFrame, batch: int | None = None, update: bool = True) -> Manifest:
        """New keys are inserted; of known ones the newer row stays, or with update=False the old one. counts of the manifest: rows, inserted, updated."""
        before = self.manifest()
        if batch is not None and batch <= before.batch:
            return before
        new = new.filter(F.col(self.at).isNotNull()).withColumn(MONTH, F.date_format(self.at, "yyyy-MM"))
        found = new.groupBy(MONTH).agg(F.max(self.at).alias("high")).collect()  # one row a month
        months = sorted(r[MONTH] for r in found)
        if not months:
            return self.commit(Manifest(before.version + 1, max(before.batch, -1 if batch is None else batch), before.high, before.months, {"rows": before.counts.get("rows", 0), "inserted": 0, "updated": 0}))
        old = self.read(months).withColumn("_new", F.lit(0))
        old_rows = old.count()
        both = old.select(*new.columns, "_new").unionByName(new.withColumn("_new", F.lit(1)))
        group = [*self.keys, MONTH]
        rest = [c for c in new.columns if c not in group and c not in self.order]
        rank = [*self.order, "_new", *rest] if update else [(1 - F.col("_new")).alias("_old"), *self.order, "_new", *rest]
        best = both.groupBy(*group).agg(F.max(F.struct(*rank)).alias("_best"), F.min("_new").alias("_first"))
        seen = Observation()
        kept = best.select(*group, "_best.*", "_first").observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_first") == 1, 1)).alias("inserted"), F.count(F.when((F.col("_first") == 0) & (F.col("_new") == 1), 1)).alias("updated"))
        place = self.write(kept.select(*self.schema.fieldNames(), MONTH))
        n = seen.get
        total = before.counts.get("rows", 0) - old_rows + n["rows"]
        high = max(x for x in [before.high, *(str(r["high"]) for r in found)] if x)
        return self.commit(Manifest(before.version + 1, max(before.batch, -1 if batch is None else batch), high, before.months | {m: f"{place}/{MONTH}={m}" for m in months}, {"rows": total, "inserted": n["inserted"], "updated": n["updated"]}))

    def replace_range(self, new: DataFrame, first: dt.date, last: dt.date) -> Manifest:
        """All rows from first to last are replaced by those of new in that range; the rest of their months stays."""
        before, inside = self.manifest(), F.col(self.at).cast("date").between(F.lit(first), F.lit(last))
        touched = [m for m in before.months if str(first)[:7] <= m <= str(last)[:7]]
        new = new.filter(inside).withColumn(MONTH, F.date_format(self.at, "yyyy-MM"))
        seen = Observation()
        rows = self.read(touched).filter(~inside).unionByName(newest(new, [*self.keys, MONTH], self.order)).select(*self.schema.fieldNames(), MONTH)
        place = self.write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
        found = [n.partition("=")[2] for n in self.files.names(f"{self.root}/data/{place}") if n.startswith(f"{MONTH}=")]
        gone = self.read(touched).count()
        months = {m: f for m, f in before.months.items() if m not in touched} | {m: f"{place}/{MONTH}={m}" for m in found}
        return self.commit(Manifest(before.version + 1, before.batch, before.high, months, {"rows": before.counts.get("rows", 0) - gone + seen.get["rows"]}))

    def check_keys(self) -> None:
        """Raises if a key has two rows."""
        if bad := self.read().groupBy(*self.keys).count().filter("count > 1").take(1):
            raise ValueError(f"key twice: {bad[0].asDict()}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests older than the last `keep`, and data that no manifest names. Only while nobody writes or reads older versions."""
        names = [n for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json")]
        for n in names[:-keep]:
            self.files.delete(f"{self.root}/manifests/{n}")
        used = {p.split("/")[0] for n in names[-keep:] for p in json.loads(self.files.read(f"{self.root}/manifests/{n}"))["months"].values()}
        gone = [p for p in self.files.names(f"{self.root}/data") if p not in used]
        for p in gone:
            self.files.delete(f"{self.root}/data/{p}")
        return gone


def within(rows: DataFrame, table: Table, delay: dt.timedelta) -> tuple[Column, str | None]:
    """Whether a row isn't later than the table's watermark: the latest event time of all batches before, less the delay."""
    high = table.manifest().high
    if high is None:
        return F.lit(True), None
    mark = str(dt.datetime.fromisoformat(high) - delay)
    return F.col(table.at) >= F.lit(mark).cast(dict(rows.dtypes)[table.at]), mark


def with_month(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add(MONTH, StringType())
