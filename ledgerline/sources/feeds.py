"""Feeds of a vendor as a Spark data source: `spark.read.format("feed")` and `spark.readStream.format("feed")`.

A feed has a grain: `day` is fetched day by day, `range` in calls that span several days, `snapshot` as a whole without dates. Each call
is one partition, so Spark spreads, retries and reruns calls like any other tasks; within a task a call is repeated with growing
pauses. A date filter narrows the calls before any is made. How a call is made is a transport's matter: a class, named by
`module:Class` in the option `transport`, made from the options in the task that needs it.
"""

from __future__ import annotations

import datetime as dt
import importlib
import itertools
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.operators.serving import retried

GRAINS = ("day", "range", "snapshot")
DAY = dt.timedelta(days=1)


class Transport:
    """Makes the calls. Tasks make their own from the options, so nothing open needs to travel."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def fetch(self, feed: str, key: str | None, first: dt.date | None, last: dt.date | None) -> pa.Table:
        """The rows of the days first to last, both included, or all without them; of one key, if the feed has keys."""
        raise NotImplementedError

    def days(self, feed: str) -> tuple[dt.date, dt.date] | None:
        """The first and the last day that the feed has now; None if it has none."""
        raise NotImplementedError

    def schema(self, feed: str) -> T.StructType:
        raise NotImplementedError


class ParquetTransport(Transport):
    """A feed is a Parquet file or folder `path`/feed.parquet; the option `at` names its time, `by` the column of its keys."""

    def _table(self, feed: str) -> Any:
        import pyarrow.dataset as ds

        return ds.dataset(f"{self.options['path'].removeprefix('file://')}/{feed}.parquet")

    def fetch(self, feed: str, key: str | None, first: dt.date | None, last: dt.date | None) -> pa.Table:
        import pyarrow.dataset as ds

        rows, wanted = self._table(feed), []
        if first is not None:
            at = self.options["at"]
            kind = rows.schema.field(at).type
            edge = lambda day: pa.scalar(day if pa.types.is_date(kind) else dt.datetime.combine(day, dt.time()), kind)
            wanted += [ds.field(at) >= edge(first), ds.field(at) < edge(last + DAY)]
        if key is not None:
            wanted.append(ds.field(self.options["by"]) == key)
        # batch by batch, none read ahead: what is held is what the call asks for, not the file
        batches = rows.to_batches(filter=None if not wanted else list(itertools.accumulate(wanted, lambda a, b: a & b))[-1], batch_size=65_536, batch_readahead=0, fragment_readahead=0, use_threads=False, fragment_scan_options=ds.ParquetFragmentScanOptions(pre_buffer=False, use_buffered_stream=True))
        return pa.Table.from_batches((b for b in batches if b.num_rows), rows.schema)

    def days(self, feed: str) -> tuple[dt.date, dt.date] | None:
        """From the statistics in the files' footers; no row is read."""
        found = []
        for part in self._table(feed).get_fragments():
            for group in part.row_groups:
                found += [v for v in (group.statistics or {}).get(self.options["at"], {}).values() if v is not None]
        days = [v.date() if isinstance(v, dt.datetime) else v for v in found]
        return (min(days), max(days)) if days else None

    def schema(self, feed: str) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._table(feed).schema, prefer_timestamp_ntz=True)


def transport_of(options: dict[str, str]) -> Transport:
    module, _, name = options.get("transport", f"{__name__}:ParquetTransport").partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


@dataclass
class Call(InputPartition):
    key: str | None
    first: dt.date | None
    last: dt.date | None

    def __post_init__(self) -> None:
        super().__init__((self.key, self.first, self.last))


def _day(value: Any) -> dt.date | None:
    return value.date() if isinstance(value, dt.datetime) else value if isinstance(value, dt.date) else dt.date.fromisoformat(value) if isinstance(value, str) else None


def calls(grain: str, keys: Sequence[str | None], first: dt.date | None, last: dt.date | None, span: int) -> list[Call]:
    if grain == "snapshot":
        return [Call(k, None, None) for k in keys]
    if first is None or last is None or first > last:
        return []
    step = 1 if grain == "day" else span
    starts = [first + DAY * k for k in range(0, (last - first).days + 1, step)]
    return [Call(k, s, min(last, s + DAY * (step - 1))) for k in keys for s in starts]


class _Fetching:
    """What reading once and as a stream share."""

    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.options, self.schema = dict(options), schema
        self.feed, self.grain = options["feed"], options.get("grain", "day")
        if self.grain not in GRAINS:
            raise ValueError(f"no such grain: {self.grain}")
        self.keys: list[str | None] = json.loads(options["keys"]) if options.get("keys") else [None]
        self.span, self.tries, self.wait = int(options.get("span", "30")), int(options.get("tries", "3")), float(options.get("wait", "2"))

    def span_of_days(self) -> tuple[dt.date | None, dt.date | None]:
        """What the options ask for, within what the feed has."""
        if self.grain == "snapshot":
            return None, None
        there = retried(lambda: transport_of(self.options).days(self.feed), self.tries, self.wait)
        if there is None:
            return None, None
        first, last = _day(self.options.get("start")), _day(self.options.get("end"))
        return max(x for x in (first, there[0]) if x), min(x for x in (last, there[1]) if x)

    def read(self, call: Call) -> Iterator[pa.RecordBatch]:
        """One call, made again after a failure; rows leave the task only when a call has ended well."""
        rows = retried(lambda: transport_of(self.options).fetch(self.feed, call.key, call.first, call.last), self.tries, self.wait)
        want = to_arrow_schema(self.schema)
        columns = [rows.column(f.name).cast(f.type) if f.name in rows.column_names else pa.nulls(len(rows), f.type) for f in want]
        yield from pa.Table.from_arrays(columns, schema=want).to_batches(max_chunksize=65_536)


class FeedReader(_Fetching, DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        super().__init__(options, schema)
        self.least: dt.date | None = None
        self.most: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the days by comparisons of the time column; every filter is still applied to the rows."""
        at = (self.options.get("at", "date"),)
        for f in filters:
            if getattr(f, "attribute", None) == at and self.grain != "snapshot":
                values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else ()
                days = [d for d in map(_day, values) if d is not None]
                if days and not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(x for x in (self.least, min(days)) if x)
                if days and not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    midnight = isinstance(f, LessThan) and (not isinstance(f.value, dt.datetime) or f.value.time() == dt.time())
                    self.most = min(x for x in (self.most, max(days) - DAY * midnight) if x)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        first, last = self.span_of_days()
        if first is not None:
            first, last = max(x for x in (first, self.least) if x), min(x for x in (last, self.most) if x)
        return calls(self.grain, self.keys, first, last, self.span) or [Call(None, dt.date.min, dt.date.min)]

    def read(self, call: Call) -> Iterator[pa.RecordBatch]:
        return iter(()) if call.first == dt.date.min else super().read(call)


class FeedStream(_Fetching, DataSourceStreamReader):
    """The offset is the first day that isn't fetched yet. A day counts as there when the feed has a later one, or `whole` is true: a
    day that may still grow isn't taken."""

    def initialOffset(self) -> dict:
        first, _ = self.span_of_days()
        return {"next": str(first or _day(self.options.get("start")) or dt.date.min)}

    def latestOffset(self) -> dict:
        _, last = self.span_of_days()
        if last is None:
            return self.initialOffset()
        return {"next": str(last + DAY if self.options.get("whole", "false") == "true" else last)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return calls("day" if self.grain == "snapshot" else self.grain, self.keys, _day(start["next"]), _day(end["next"]) - DAY, self.span)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Options: feed, transport, grain, at (time column), start, end (days), keys (a JSON list), by (key column), span (days of a range call),
    tries and wait (seconds before the first repetition), whole (streams: the last day is complete)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> T.StructType:
        return transport_of(dict(self.options)).schema(self.options["feed"])

    def reader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> FeedStream:
        return FeedStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
