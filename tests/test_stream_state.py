"""Streams with state: retries with deadlines, days that close, a table that survives a lost writer, and computing again."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.serving import recomputed
from ledgerline.streaming import table as tables
from ledgerline.streaming.ingest import MONTH, closed_days, lookback_months, recompute_stream, upsert_stream
from ledgerline.streaming.retries import OUTPUT, retry_stream
from ledgerline.streaming.table import Conflict, Manifest, Table, newest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BARS = "code long, date date, seen long, price double"


def at(hour, minute=0, day=5):
    return dt.datetime(2024, 1, day, hour, minute)


class Fed:
    """A stream of files that are added one by one, run to its end each time from its checkpoint."""

    def __init__(self, spark, schema, make, out):
        self.spark, self.schema, self.make, self.out, self.folder = spark, schema, make, out, tempfile.mkdtemp(prefix="spark-")

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        self.make(stream).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start().awaitTermination()
        return sorted((tuple(r) for r in self.spark.read.schema(self.out).parquet(f"{self.folder}/out").collect()), key=str)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield spark
    spark.conf.set(key, before)


D = dt.date(2024, 1, 5)
OUTCOMES = "source string, date date, at timestamp, ok boolean"
SERIES = [("x", D, at(9), False), ("x", D, at(17, 50), False), ("y", D, at(18), True), ("x", D, at(19), None), ("z", D, at(20, 50), False), ("x", D, at(20, 59), True), ("x", D, at(1, day=6), False)]
WANT = [
    ("x", D, "failed", at(9), 1), ("x", D, "failed", at(17, 50), 2), ("x", D, "retry", at(18, 20), 2), ("x", D, "retry", at(18, 50), 2), ("x", D, "failed", at(19), 3),
    ("x", D, "retry", at(19, 30), 3), ("x", D, "retry", at(20), 3), ("x", D, "retry", at(20, 30), 3), ("x", D, "cleared", at(20, 59), 3), ("x", D, "failed", at(1, day=6), 1),
    ("z", D, "failed", at(20, 50), 1), ("z", D, "retry", at(21), 1), ("z", D, "left", at(21), 1),
]


@pytest.mark.parametrize("cuts", [[7], [1, 1, 1, 1, 1, 1, 1], [3, 4]])
def test_retries_by_any_cut_and_over_restarts(rocksdb, cuts):
    """Each batch is a run of its own from the checkpoint; timers of one run fire in a later one."""
    fed, k = Fed(rocksdb, OUTCOMES, retry_stream, OUTPUT), 0
    for n in cuts:
        fed.add(*SERIES[k : k + n])
        got, k = fed.run(), k + n
    assert got == sorted(WANT, key=str)


def test_dead_after_the_most_failures(rocksdb):
    fed = Fed(rocksdb, OUTCOMES, lambda s: retry_stream(s, most=3), OUTPUT)
    fed.add(*[("x", D, at(17, m), False) for m in (0, 1, 2, 3)], ("q", D, at(23), True))
    assert [r[2:] for r in fed.run() if r[2] in ("dead", "retry", "left")] == [("dead", at(17, 2), 3)]
    fed.add(("x", D, at(2, day=6), True), ("x", D, at(17, day=6), False), ("q", D, at(17, 40, day=6), True))
    assert [r[2:] for r in fed.run() if r[3] > at(3, day=6) or r[2] == "cleared"] == [("cleared", at(2, day=6), 4), ("failed", at(17, day=6), 1), ("retry", at(17, 30, day=6), 1)]


def test_closed_days_leave_late_rows_out(spark):
    fed = Fed(spark, "ts timestamp, kind string, x double", lambda s: closed_days(s, "ts", ["kind"], "x", "6 hours"), "date date, kind string, n long, total double")
    fed.add((at(9, day=1), "a", 1.0), (at(23, day=1), "a", 2.0), (at(5, day=2), "a", 4.0))
    assert fed.run() == []  # the first day may still get rows: the watermark is at 23:00
    fed.add((at(22, day=1), "a", 8.0), (at(7, day=2), "b", 16.0))
    assert fed.run() == [(dt.date(2024, 1, 1), "a", 3, 11.0)]
    fed.add((at(21, day=1), "a", 32.0), (at(12, day=3), "b", 64.0))  # too late: its day is out
    assert fed.run() == [(dt.date(2024, 1, 1), "a", 3, 11.0), (dt.date(2024, 1, 2), "a", 1, 4.0), (dt.date(2024, 1, 2), "b", 1, 16.0)]


def new_table(spark, order=("seen",)):
    return Table(spark, tempfile.mkdtemp(prefix="spark-"), spark.createDataFrame([], BARS).schema, ["code", "date"], "date", list(order))


def day(month, d):
    return dt.date(2024, month, d)


def content(t, **which):
    return sorted(map(tuple, t.read(**which).select("code", "date", "seen", "price").collect()), key=str)


def test_table_counts_versions_and_vacuum(spark):
    t, df = new_table(spark), lambda *rows: spark.createDataFrame(list(rows), BARS)
    assert content(t) == [] and t.manifest() == Manifest()
    assert t.upsert(df((1, day(1, 5), 1, 1.0), (2, day(2, 5), 1, 2.0), (3, None, 1, 3.0))).counts == {"rows": 2, "inserted": 2, "updated": 0}
    m = t.upsert(df((1, day(1, 5), 2, 5.0), (2, day(2, 5), 0, 9.0), (4, day(2, 6), 1, 4.0)))
    assert m.counts == {"rows": 3, "inserted": 1, "updated": 1} and m.version == 2 and m.high == "2024-02-06"
    assert content(t) == [(1, day(1, 5), 2, 5.0), (2, day(2, 5), 1, 2.0), (4, day(2, 6), 1, 4.0)]
    assert content(t, months=["2024-01", "2030-01"]) == [(1, day(1, 5), 2, 5.0)]
    assert content(t, version=1) == [(1, day(1, 5), 1, 1.0), (2, day(2, 5), 1, 2.0)]
    # columns of known keys may stay as they are
    assert t.upsert(df((1, day(1, 5), 9, 7.0)), update=False).counts == {"rows": 3, "inserted": 0, "updated": 0}
    assert t.replace_range(df((7, day(2, 5), 1, 7.0), (8, day(2, 6), 1, 8.0), (9, day(3, 1), 1, 9.0)), day(2, 1), day(2, 5)).counts == {"rows": 3}
    assert content(t) == [(1, day(1, 5), 2, 5.0), (4, day(2, 6), 1, 4.0), (7, day(2, 5), 1, 7.0)]
    t.check_keys()
    assert len(t.vacuum(keep=1)) >= 2 and len(content(t)) == 3
    assert t.upsert(df((1, None, 1, 1.0))).counts["inserted"] == 0 and len(content(t)) == 3
    with pytest.raises(ValueError):
        Table(spark, "", t.schema, ["code"], "date", [])


def test_two_writers_of_one_version(spark):
    t = new_table(spark)
    t.upsert(spark.createDataFrame([(1, day(1, 5), 1, 1.0)], BARS))
    with pytest.raises(Conflict):
        t.commit(Manifest(version=1))
    assert t.manifest().version == 1 and len(content(t)) == 1


@pytest.mark.parametrize("where", ["write", "commit", "after"])
def test_a_lost_writer_loses_nothing(spark, monkeypatch, where):
    """The driver goes down before the data is written, between write and commit, or after the commit but before the stream's own log."""
    folder, schema = tempfile.mkdtemp(prefix="spark-"), spark.createDataFrame([], BARS).schema
    add = lambda *rows: spark.createDataFrame(list(rows), BARS).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        upsert_stream(stream, f"{folder}/table", ["code", "date"], "date", ["seen"], f"{folder}/log", F.col("price") > 0, f"{folder}/dead").awaitTermination()

    t = Table(spark, f"{folder}/table", schema, ["code", "date"], "date", ["seen"])
    add((1, day(1, 5), 1, 1.0), (2, day(1, 6), 1, 2.0))
    run()
    before = content(t)
    add((1, day(1, 5), 2, 9.0), (3, day(1, 7), 1, 3.0), (4, day(1, 7), 1, -1.0))

    def down(self, *a):
        if where == "after":
            real(self, *a)
        raise SystemError("the driver is gone")

    real = getattr(tables.Table, "write" if where == "write" else "commit")
    monkeypatch.setattr(tables.Table, "write" if where == "write" else "commit", down)
    with pytest.raises(Exception, match="gone"):
        run()
    monkeypatch.undo()
    want = [(1, day(1, 5), 2, 9.0), (2, day(1, 6), 1, 2.0), (3, day(1, 7), 1, 3.0)]
    assert content(t) == (want if where == "after" else before)  # what is read meanwhile is whole
    run()
    assert content(t) == want and t.manifest().version == 2
    assert [tuple(r)[:1] for r in spark.read.schema(schema).parquet(f"{folder}/dead").collect()] == [(4,)]


def test_late_rows_go_to_the_dead(spark):
    folder, schema = tempfile.mkdtemp(prefix="spark-"), spark.createDataFrame([], BARS).schema
    for rows in ([(1, day(2, 10), 1, 1.0)], [(1, day(2, 6), 1, 2.0), (1, day(2, 4), 1, 3.0)]):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        upsert_stream(stream, f"{folder}/table", ["code", "date"], "date", ["seen"], f"{folder}/log", dead=f"{folder}/dead", delay=dt.timedelta(days=5)).awaitTermination()
    assert content(Table(spark, f"{folder}/table", schema, ["code", "date"], "date", ["seen"])) == [(1, day(2, 10), 1, 1.0), (1, day(2, 6), 1, 2.0)]
    assert [r.price for r in spark.read.schema(schema).parquet(f"{folder}/dead").collect()] == [3.0]


STAGES = [{"change": "price - lag(price, 2) over (partition by code order by date)"}]


def test_recompute_reads_only_its_look_back(spark):
    """Equal to the batch operator over the whole history, from the months of the look-back alone."""
    days = [dt.date(2023, 1, 1) + dt.timedelta(3 * k) for k in range(200)]
    rows = [(c, d, 0, float((c * 7 + k * k) % 31)) for c in (1, 2, 3) for k, d in enumerate(days)]
    old, fresh = [r for r in rows if r[1] < dt.date(2024, 6, 1)], [r for r in rows if r[1] >= dt.date(2024, 6, 1)]
    history, folder = new_table(spark), tempfile.mkdtemp(prefix="spark-")
    history.upsert(spark.createDataFrame(old, BARS))
    out = Table(spark, f"{folder}/out", spark.createDataFrame([], "code long, date date, change double").schema, ["code", "date"], "date", [])
    spark.createDataFrame(fresh, BARS).coalesce(1).write.parquet(f"{folder}/in")
    opened = []
    stream = spark.readStream.schema(BARS).parquet(f"{folder}/in")
    recompute_stream(stream, history, out, 12, STAGES, ["change"], f"{folder}/log", also=lambda used, _: opened.extend(used.inputFiles())).awaitTermination()
    months = {p.split(f"{MONTH}=")[1][:7] for p in opened}
    assert months == {"2024-05", "2024-06", "2024-07", "2024-08"} and lookback_months(history, dt.date(2024, 6, 1), 30)[0] == "2024-03"
    whole = spark.createDataFrame(rows, BARS)
    want = recomputed(whole, whole.filter("date >= date '2024-06-01'").select("date").distinct(), 12, STAGES, ["change"])
    assert sorted(map(tuple, out.read().select("code", "date", "change").collect())) == sorted(map(tuple, want.select("code", "date", "change").collect()))
    assert newest(whole, ["code", "date"], ["seen"]).count() == len(rows)
