import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming.ingest import MONTH, newest, read_table, upsert_stream

SCHEMA = "code long, date date, seen long, price double"


def day(m, d):
    return datetime.date(2024, m, d)


def streamed(spark, batches):
    """The table and the dead rows after a stream with one file a batch."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    upsert_stream(stream, f"{folder}/table", ["code", "date"], "date", ["seen"], f"{folder}/log", F.col("price") > 0, f"{folder}/dead").awaitTermination()
    table = read_table(spark, f"{folder}/table", stream.schema, "date")
    dead = spark.read.schema(SCHEMA).parquet(f"{folder}/dead").select("code", "date", "seen", "price")
    return sorted(map(tuple, table.select("code", "date", "seen", "price").collect())), sorted(map(tuple, dead.collect()), key=str), {r[0] for r in table.select(MONTH).distinct().collect()}


def test_late_rows_and_dead_ones(spark):
    first = [(1, day(1, 5), 10, 1.0), (2, day(1, 5), 10, 2.0), (1, day(2, 1), 10, 3.0)]
    second = [(1, day(1, 5), 12, 1.5), (2, day(1, 5), 9, 9.0), (3, day(3, 1), 10, -1.0), (3, day(3, 2), 10, None)]
    third = [(None, day(2, 1), 10, 4.0), (None, day(2, 1), 11, 5.0), (4, None, 10, 1.0)]
    want = [(1, day(1, 5), 12, 1.5), (1, day(2, 1), 10, 3.0), (2, day(1, 5), 10, 2.0)]
    for order in ([first, second], [second, first]):
        table, dead, months = streamed(spark, order)
        assert table == want and months == {"2024-01", "2024-02"}
        assert [r[0] for r in dead] == [3, 3]
    table, dead, _ = streamed(spark, [third])
    assert table == [(None, day(2, 1), 11, 5.0)] and dead == [(4, None, 10, 1.0)]


def test_newest_of_equals_and_keys(spark):
    rows = spark.createDataFrame([(1, day(1, 1), 5, 1.0), (1, day(1, 1), 5, 2.0), (1, day(1, 1), None, 9.0)], SCHEMA)
    assert [tuple(r) for r in newest(rows, ["code", "date"], ["seen"]).collect()] == [(1, day(1, 1), 5, 2.0)]
    with pytest.raises(ValueError):
        upsert_stream(rows, "", ["code"], "date", ["seen"], "")
