import datetime as dt
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import universe, upkeep
from ledgerline.sources import layout, scans
from ledgerline.sources.layout import DuplicateKey, Written

DAY = dt.date(2024, 1, 1)
KINDS = "code long, date date, x double, y double"


@pytest.fixture
def name(spark):
    n = f"panel_{uuid.uuid4().hex[:12]}"
    yield n
    for t in (n, f"{n}__next"):
        spark.sql(f"drop table if exists {t}")


def panel(spark, rows, kinds=KINDS):
    return spark.createDataFrame([(c, DAY + dt.timedelta(d), *v) for c, d, *v in rows], kinds)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_windows_by_code_need_no_exchange(spark, name):
    df = panel(spark, [(c, d, float(c * d), None) for c in range(20) for d in range(10)])
    assert layout.save(df, name, 4) == 200 and layout.buckets_of(spark, name) == 4
    w = Window.partitionBy("code").orderBy("date")
    before = spark.conf.get("spark.sql.bucketing.coalesceBucketsInJoin.enabled")
    lagged = spark.table(name).withColumn("lag", F.lag("x").over(w)).groupBy("code").agg(F.max("lag").alias("m"))
    other = spark.table(name).groupBy("code").agg(F.count("x").alias("n"))
    for plan in (lagged, lagged.join(other.hint("merge"), "code")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Window" in text, text
    assert "Exchange" in df.withColumn("lag", F.lag("x").over(w))._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.code, r.m) for r in lagged.collect()) == [(c, float(c * 8)) for c in range(20)] and before == spark.conf.get("spark.sql.bucketing.coalesceBucketsInJoin.enabled")


def test_upsert_counts_and_foreign_columns(spark, name):
    layout.save(panel(spark, [(1, 0, 1.0, 5.0), (1, 1, 2.0, 6.0), (2, 0, 3.0, 7.0)]), name, 3)
    new = panel(spark, [(1, 1, 9.0, 1.5), (3, 0, 4.0, 2.5), (2, 0, None, 3.5)], "code long, date date, x double, z double")
    assert layout.upsert(spark, name, new) == Written(rows=4, inserted=1, updated=2)
    assert layout.buckets_of(spark, name) == 3
    d = lambda k: DAY + dt.timedelta(k)
    assert rows_of(spark.table(name)) == sorted([(1, d(0), 1.0, 5.0, None), (1, d(1), 9.0, 6.0, 1.5), (2, d(0), None, 7.0, 3.5), (3, d(0), 4.0, None, 2.5)], key=str)
    with pytest.raises(DuplicateKey, match="code=1"):
        layout.upsert(spark, name, new.union(new.filter("code = 1")))
    assert spark.table(name).count() == 4
    with pytest.raises(DuplicateKey):
        layout.save(new.union(new), name, 3)


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/by_date"
    assert layout.replace_dates(spark, panel(spark, [(1, 0, 1.0, 1.0), (1, 1, 2.0, 2.0)]), path, "date") == 2
    assert layout.replace_dates(spark, panel(spark, [(7, 1, 3.0, 3.0), (8, 1, 4.0, 4.0)]), path, "date") == 2
    assert sorted((r.code, str(r.date)) for r in spark.read.parquet(path).collect()) == [(1, "2024-01-01"), (7, "2024-01-02"), (8, "2024-01-02")]


def test_what_there_is(spark, name):
    df = panel(spark, [(1, 0, 1.0, 5.0)])
    layout.save(df, name, 1)
    assert [r.name for r in scans.tables_of(spark, "panel_").collect()] == [name] and scans.tables_of(spark, "nothing").count() == 0
    assert [tuple(r) for r in scans.columns_of(spark.table(name)).collect()] == [(0, "code", "bigint"), (1, "date", "date"), (2, "x", "double"), (3, "y", "double")]
    assert layout.lacking(df, spark.createDataFrame([], "code long, x string, w double").schema) == ["x", "w"]
    assert layout.without(df, ["x", "y"]).columns == ["code", "date"]
    with pytest.raises(ValueError):
        layout.without(df, ["w"])


def test_files_of_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,date,x\n000001,2024-01-05,1.5\n600000,2024-01-08,\n")
    got = scans.csv_table(spark, f"{tmp_path}/a.csv", "code string, date date, x double").collect()
    assert [tuple(r) for r in got] == [("000001", dt.date(2024, 1, 5), 1.5), ("600000", dt.date(2024, 1, 8), None)]
    (tmp_path / "bad.csv").write_text("code,date,x\n1,2024-01-05,many\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        scans.csv_table(spark, f"{tmp_path}/bad.csv", "code string, date date, x double").collect()
    (tmp_path / "a.json").write_text('{"slope": 1.25,\n "results": {"n_pred": 3}}')
    assert scans.json_table(spark, f"{tmp_path}/a.json").select("slope", "results.n_pred").first() == (1.25, 3)
    assert scans.json_table(spark, f"{tmp_path}/a.json", "slope string, more int").first() == ("1.25", None)


def test_cells_codes_and_zeros(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, None, 2.0)], "code long, x double, y double")
    assert sorted(r.code for r in upkeep.null_out(df, ["x", "y"]).collect()) == [2, 3]
    assert [r.c for r in spark.createDataFrame([("000001.SZ",), ("600000",), (None,)], "c string").select(upkeep.with_suffix(F.col("c")).alias("c")).collect()] == ["000001", "600000", None]
    weights = {"a": 0.4, "b": 0.35, "c": 0.25}
    assert universe.sell_zero({"a": -0.01, "b": -0.02, "c": -0.03}, weights) == pytest.approx(-0.0185)
    assert universe.sell_zero({"a": -0.01, "b": None}, weights) == pytest.approx(-0.01 * 0.4 / 0.75)
    with pytest.raises(ValueError):
        universe.sell_zero({}, weights)
