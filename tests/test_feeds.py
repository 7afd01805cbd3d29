import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from ledgerline.sources.feeds import FeedReader, calls, register

D = dt.date


@pytest.fixture(scope="module")
def root(spark):
    register(spark)
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [{"at": dt.datetime(2024, 1, day, hour), "code": code, "x": float(day * hour)} for day in (1, 2, 4, 5) for hour in (0, 9, 23) for code in ("a", "b")]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("at", pa.timestamp("us")), ("code", pa.string()), ("x", pa.float64())])), f"{folder}/prices.parquet")
    return folder


def feed(spark, root, reader="read", **options):
    return getattr(spark, reader).format("feed").options(feed="prices", path=root, at="at", wait="0.01", **options).load()


def test_days_keys_and_snapshots(spark, root):
    df = feed(spark, root)
    assert df.count() == 24 and df.rdd.getNumPartitions() == 5  # a day without rows is a call as well
    assert feed(spark, root, start="2024-01-02", end="2024-01-04").count() == 12
    assert feed(spark, root, start="2025-01-01").count() == 0
    keyed = feed(spark, root, grain="range", span="3", by="code", keys='["b", "z"]')
    assert {r.code for r in keyed.collect()} == {"b"} and keyed.count() == 12 and keyed.rdd.getNumPartitions() == 4
    assert feed(spark, root, grain="snapshot").rdd.getNumPartitions() == 1
    extra = spark.read.format("feed").options(feed="prices", path=root, at="at").schema("code string, missing int, x double").load()
    assert extra.filter("missing is null and x is not null").count() == 24
    with pytest.raises(PySparkException):
        feed(spark, root, grain="hour").count()


def test_filters_narrow_the_calls(spark, root):
    df = feed(spark, root).filter("at >= '2024-01-02' and at < '2024-01-04'")
    assert df.count() == 6 and df.rdd.getNumPartitions() == 2
    assert feed(spark, root).filter("at = '2024-01-05 09:00:00'").rdd.getNumPartitions() == 1
    reader = FeedReader({"feed": "prices", "path": root, "at": "at"}, None)
    filters = [GreaterThan(("at",), dt.datetime(2024, 1, 1, 5)), LessThan(("at",), dt.datetime(2024, 1, 5)), In(("at",), (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 9))), EqualTo(("x",), 3)]
    assert list(reader.pushFilters(filters)) == filters and (reader.least, reader.most) == (D(2024, 1, 2), D(2024, 1, 4))


def test_calls():
    assert [(c.first, c.last) for c in calls("range", [None], D(2024, 1, 1), D(2024, 1, 7), 3)] == [(D(2024, 1, 1), D(2024, 1, 3)), (D(2024, 1, 4), D(2024, 1, 6)), (D(2024, 1, 7), D(2024, 1, 7))]
    assert len(calls("day", ["a", "b"], D(2024, 1, 1), D(2024, 1, 7), 3)) == 14
    assert calls("day", [None], D(2024, 1, 2), D(2024, 1, 1), 1) == [] and len(calls("snapshot", ["a"], None, None, 1)) == 1


def test_failing_calls_are_repeated_in_their_task(spark, root):
    counts = tempfile.mkdtemp(prefix="spark-")
    options = {"transport": "tests.flaky:Flaky", "counts": counts, "failures": "2"}
    assert feed(spark, root, **options, tries="3").count() == 24
    assert {len(os.listdir(f"{counts}/{day}")) for day in os.listdir(counts)} == {3} and len(os.listdir(counts)) == 5
    with pytest.raises(PySparkException, match="no answer"):
        feed(spark, root, **options | {"counts": tempfile.mkdtemp(prefix="spark-")}, tries="2").count()


def test_stream_goes_on_where_it_stopped(spark):
    """The last day may still grow and waits for a later one; a restart takes what is new, once."""
    folder = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{folder}/prices.parquet")

    def add(*days):
        rows = [{"at": dt.datetime(2024, 1, d, 9), "x": float(d)} for d in days]
        pq.write_table(pa.Table.from_pylist(rows, pa.schema([("at", pa.timestamp("us")), ("x", pa.float64())])), f"{folder}/prices.parquet/{days[0]}.parquet")

    def run():
        stream = feed(spark, folder, "readStream")
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.x for r in spark.read.schema("at timestamp_ntz, x double").parquet(f"{folder}/out").collect())

    add(1, 2, 3)
    assert run() == [1, 2]
    assert run() == [1, 2]
    add(4, 5)
    assert run() == [1, 2, 3, 4]
