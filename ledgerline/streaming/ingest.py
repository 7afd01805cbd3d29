"""Streams into tables: upserts with late and dead rows set aside, closed days under a watermark, and computing again what has changed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerline.functions.exprs import staged
from ledgerline.streaming.table import MONTH, Table, newest, within, with_month

__all__ = ["MONTH", "closed_days", "newest", "read_table", "recompute_stream", "upsert_stream"]


def read_table(spark: SparkSession, path: str, schema: StructType, at: str) -> DataFrame:
    """The upserted table as its last manifest has it, with its month column; empty before the first commit."""
    return Table(spark, path, schema, [at], at, []).read()


def upsert_stream(rows: DataFrame, path: str, keys: list[str], at: str, order: list[str], checkpoint: str, valid: Column | None = None, dead: str | None = None, delay: dt.timedelta | None = None) -> StreamingQuery:
    """Starts a query over all rows that are there, which keeps the newest row of each key under path. Late rows count by their
    order columns, not by their arrival, so any cut into batches gives the same table and a batch may be repeated; a batch that is lost at any
    point leaves the table as it was, and is done again.

    at is a date or time and one of the keys: a batch rewrites only the months that it has rows of. Rows whose valid is false or
    NULL, or whose at is NULL, or that come more than `delay` after the latest event time of earlier batches, go to the folder dead, one folder a
    batch, or are left out without one. Columns must not be named like MONTH."""
    table = Table(rows.sparkSession, path, rows.schema, keys, at, order)
    good = F.col(at).isNotNull() if valid is None else F.col(at).isNotNull() & F.coalesce(valid, F.lit(False))

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= table.manifest().batch:
            return
        batch = batch.persist()
        kept = good if delay is None else good & within(batch, table, delay)[0]
        if dead:
            batch.filter(~F.coalesce(kept, F.lit(False))).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        table.upsert(batch.filter(kept), batch_id)
        batch.unpersist()

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_days(rows: DataFrame, at: str, by: list[str], value: str, delay: str) -> DataFrame:
    """A stream's days, given out once when the watermark has passed their end: n and total of each group. The state holds only days that are open, and
    rows later than the watermark are left out."""
    days = rows.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return days.select(F.to_date("_w.start").alias("date"), *by, "n", "total")


def recompute_stream(changes: DataFrame, history: Table, out: Table, dates_back: int, stages: list[dict[str, str]], columns: list[str], checkpoint: str, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """changes: a stream of rows of history. Each batch is first put into history; then its dates are computed again over the months that
    their look-back needs, and upserted into out, by the batch's number, so a batch may be repeated.

    The look-back is the last dates_back distinct dates up to the first changed one; it is found from the months' dates, newest month first, until there
    are enough, so only months of the look-back and after are opened. also(rows read, batch): a hook for tests and logs."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= out.manifest().batch:
            return
        batch = batch.persist()
        history.upsert(batch, batch_id)
        targets = batch.select(history.at).distinct()
        first = targets.agg(F.min(history.at)).first()[0]
        if first is not None:
            used = history.read(lookback_months(history, first, dates_back))
            if also:
                also(used, batch_id)
            anchor = used.select(history.at).distinct().filter(F.col(history.at) <= F.lit(first)).orderBy(F.desc(history.at)).limit(dates_back).agg(F.min(history.at)).first()[0]
            fresh = staged(used.drop(MONTH).filter(F.col(history.at) >= F.lit(anchor)), stages).join(targets, history.at, "left_semi")
            out.upsert(fresh.select(*out.schema.fieldNames()), batch_id)
        batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookback_months(table: Table, first: dt.date, dates_back: int) -> list[str]:
    """The months from that of the look-back's first date on."""
    months = sorted(table.manifest().months)
    need, at = dates_back, len([m for m in months if m <= str(first)[:7]])
    while at > 0 and need > 0:
        at -= 1
        need -= table.read([months[at]]).filter(F.col(table.at) <= F.lit(first)).select(table.at).distinct().count()
    return months[at:]
