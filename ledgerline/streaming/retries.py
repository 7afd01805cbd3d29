"""Fetches that failed, as streaming state with deadlines: what is to be tried again, when, and what is given up."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A failure between FROM and UNTIL of its day is tried again every EVERY, and a last time at UNTIL; MOST failures in a row are dead.
FROM, UNTIL, EVERY, MOST = dt.time(17), dt.time(21), dt.timedelta(minutes=30), 5

OUTPUT = "source string, date date, kind string, at timestamp, attempts int"
STATE = "attempts int, due long"
_Out = Row("source", "date", "kind", "at", "attempts")


class Retries(StatefulProcessor):
    """Keyed by source and date; rows are outcomes (ok, at). Kinds of output rows:

    `failed` and `cleared`: what an outcome did; `retry`: try again now; `dead`: MOST failures, nothing is tried any more until an outcome
    is good; `left`: the deadline has passed, the date stays pending.

    What is due is decided by event time alone: an outcome first lets everything fire that was due up to it, and timers fire what is due up to the
    watermark, so any cut of the stream into batches gives the same rows."""

    def __init__(self, start: dt.time = FROM, until: dt.time = UNTIL, every: dt.timedelta = EVERY, most: int = MOST, zone: str = "UTC") -> None:
        self.start, self.until, self.every, self.most, self.zone = start, until, every, most, ZoneInfo(zone)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", STATE)

    def next_due(self, at: dt.datetime) -> dt.datetime | None:
        """When a failure at this time is tried again; None if it isn't on its day any more."""
        end = dt.datetime.combine(at.date(), self.until, self.zone)
        return min(at + self.every, end) if dt.datetime.combine(at.date(), self.start, self.zone) <= at < end else None

    def here(self, millis: int) -> dt.datetime:
        return dt.datetime.fromtimestamp(0, self.zone) + dt.timedelta(milliseconds=millis)

    def fired(self, key: tuple, attempts: int, due: dt.datetime | None, now: dt.datetime) -> tuple[list[Row], dt.datetime | None]:
        """The rows that are due up to now, and what is due next."""
        out = []
        while due is not None and due <= now:
            out.append(_Out(*key, "retry", due, attempts))
            last, due = due, self.next_due(due)
            if due is None:
                out.append(_Out(*key, "left", last, attempts))
        return out, due

    def _keep(self, attempts: int, due: dt.datetime | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        millis = None if due is None else round(due.timestamp() * 1000)
        if attempts:
            self.pending.update((attempts, millis))
            if millis is not None:
                self.handle.registerTimer(millis)
        elif self.pending.exists():
            self.pending.clear()

    def _kept(self) -> tuple[int, dt.datetime | None]:
        attempts, millis = self.pending.get() if self.pending.exists() else (0, None)
        return attempts, None if millis is None else self.here(millis)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        attempts, due = self._kept()
        for at, ok in sorted((r.at.replace(tzinfo=r.at.tzinfo or self.zone).astimezone(self.zone), r.ok) for r in rows):
            out, due = self.fired(key, attempts, due, at)
            yield from out
            if ok:
                if attempts:
                    yield _Out(*key, "cleared", at, attempts)
                attempts, due = 0, None
                continue
            attempts += 1
            yield _Out(*key, "failed", at, attempts)
            if attempts == self.most:
                yield _Out(*key, "dead", at, attempts)
            due = None if attempts >= self.most else self.next_due(at)
        self._keep(attempts, due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """All that is due up to the watermark: no outcome before it will be taken any more."""
        attempts, due = self._kept()
        if due is not None:
            out, due = self.fired(key, attempts, due, self.here(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())))
            yield from out
            self._keep(attempts, due)

    def close(self) -> None:
        pass


def retry_stream(outcomes: DataFrame, delay: str = "0 seconds", **rules: Any) -> DataFrame:
    """outcomes: a stream of source string, date date, at timestamp, ok boolean. Rows of OUTPUT, appended as they fall due. Days and deadlines
    are those of the session's time zone; its state store has to be RocksDB."""
    rows = outcomes.select("source", "date", "at", F.coalesce("ok", F.lit(False)).alias("ok")).filter("at is not null").withWatermark("at", delay)
    return rows.groupBy("source", "date").transformWithState(statefulProcessor=Retries(**{"zone": outcomes.sparkSession.conf.get("spark.sql.session.timeZone"), **rules}), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
