"""Every query with SQL against DuckDB on the smallest tables, and units on tiny frames."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.exprs import ewm, staged
from ledgerline.operators import factors, panel
from ledgerline.plans import catalogue, checks, feeds, market, models, serving, streams, upkeep  # noqa: F401 - registers its queries in the catalogue
from ledgerline.sources import bars

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, dt.datetime | dt.date):
        return str(v)[:10]
    return round(float(v), 5) + 0.0


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    said = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, said.fetchall())
    have = rows(df.columns, got)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


def prices(spark, opens):
    day = dt.date(2026, 1, 5)
    return spark.createDataFrame([(1, day + dt.timedelta(i), float(o), float(o + 10), 1.0) for i, o in enumerate(opens)], "code long, date date, open double, close double, volume double")


def test_label_by_hand_and_no_lookahead(spark):
    opens = list(range(10, 20))
    label = lambda o: [r[0] for r in prices(spark, o).withColumn("l", panel.forward_label(2, 4)).orderBy("date").select("l").collect()]
    first = label(opens)
    assert first[0] == pytest.approx(13 / 11 - 1) and first[-1] is None
    changed = label([*opens[:8], 990, 999])
    assert changed[:4] == first[:4] and changed[4:] != first[4:]
    with pytest.raises(ValueError):
        panel.forward_label(1, 2, "vwap")


def test_constant_prices_give_null_trend(spark):
    b = prices(spark, [10] * 25).withColumns({"high": F.col("open"), "low": F.col("open"), "amount": F.lit(1.0)}).withColumn("close", F.col("open"))
    got = staged(b, factors.stages_of("trend")).select("trend_strength").collect()
    assert all(r[0] is None for r in got)


def test_adjusted_null_and_zero_factor(spark):
    raw = spark.createDataFrame([(1, dt.date(2026, 1, 1), 10.0, 1.0), (1, dt.date(2026, 1, 2), 10.0, 2.0), (1, dt.date(2026, 1, 3), 10.0, 0.0), (1, dt.date(2026, 1, 4), 10.0, None)], "code long, date date, close double, adj_factor double").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    assert [r[0] for r in bars.adjusted(raw).orderBy("date").select("close").collect()] == [5.0, 10.0, 0.0, None]


def test_fifo(spark):
    d = lambda n: dt.date(2026, 1, n)
    t = spark.createDataFrame([(1, d(1), "BUY", 300, 1.0), (1, d(2), "BUY", 200, 2.0), (1, d(3), "SELL", 400, 3.0), (1, d(4), "SELL", 100, 4.0)], "code long, date date, action string, shares long, price double")
    assert sorted(r[0] for r in panel.fifo_trips(t).select("shares").collect()) == [100, 100, 300]


def curve(spark, values):
    return spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "date date, value double")


def test_equity_stats_by_hand(spark):
    values = [100, 110, 99, 105, 103, 120]
    got = panel.equity_stats(curve(spark, values)).first()
    r = [b / a - 1 for a, b in zip(values, values[1:])]
    mean = sum(r) / 5
    sd = (sum((x - mean) ** 2 for x in r) / 4) ** 0.5
    low = [x for x in r if x < 0]
    down = (sum((x - sum(low) / 2) ** 2 for x in low)) ** 0.5
    annual = 1.2 ** (252 / 5) - 1
    assert got["sharpe"] == pytest.approx((252 * mean - 0.025) / (sd * 252**0.5)) and got["sortino"] == pytest.approx(mean / down * 252**0.5)
    assert got["max_drawdown"] == pytest.approx(-0.1) and got["calmar"] == pytest.approx(annual / 0.1) and got["win_rate"] == pytest.approx(0.6)
    flat = panel.equity_stats(curve(spark, [5] * 7)).first()
    assert (flat["sharpe"], flat["sortino"], flat["calmar"], flat["max_drawdown"]) == (0, 0, 0, 0)
    few = panel.equity_stats(curve(spark, [1, 2, 3])).first()
    assert few["n_days"] == 2 and few["sharpe"] is None


def test_deciles_drop_rows_before_they_rank(spark):
    rows = [(dt.date(2026, 1, 1), float(i), float(i)) for i in range(20)] + [(dt.date(2026, 1, 1), 100.0 + i, None) for i in range(20)]
    got = sorted(map(tuple, panel.deciles(spark.createDataFrame(rows, "date date, s double, y double"), "s", "y").collect()))
    assert [g[0] for g in got] == list(range(10)) and all(g[3] == pytest.approx(1) for g in got)


def test_exponential_means_over_long_series(spark):
    rng = random.Random(6)
    values = [rng.uniform(1, 9) for _ in range(3000)]
    rows = spark.createDataFrame([(1, dt.date(2000, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(values)], "code long, date date, x double")
    for span in (2, 26, 400):
        decay, s, w, want = 1 - 2 / (span + 1), 0.0, 0.0, []
        for x in values:
            s, w = s * decay + x, w * decay + 1
            want.append(s / w)
        assert [r[0] for r in ewm(rows, "x", span, "m").orderBy("date").select("m").collect()] == pytest.approx(want)


def test_weighted_median_of_any_ratios(spark):
    rng = random.Random(8)
    pairs = [(rng.choice([1e-9, 1e-3, 1.0, 50.0]) * rng.choice([-1, 1]), rng.uniform(-2, 3)) for _ in range(999)]
    ratios = sorted((y / p, abs(p)) for p, y in pairs)
    half, run, want = sum(w for _, w in ratios) / 2, 0.0, None
    for k, w in ratios:
        run += w
        if run >= half:
            want = k
            break
    got = panel.l1_slope(spark.createDataFrame(pairs, "p double, y double"), "p", "y").first()[0]
    assert got == pytest.approx(want if want > 0 else 1.0)


def test_upsert_keeps_foreign_columns(spark):
    old = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 6.0)], "code long, a double, b double")
    new = spark.createDataFrame([(2, 9.0, 1.0), (3, 8.0, 2.0)], "code long, a double, c double")
    got = {r["code"]: (r["a"], r["b"], r["c"]) for r in panel.upsert_columns(old, new, ["code"]).collect()}
    assert got == {1: (1.0, 5.0, None), 2: (9.0, 6.0, 1.0), 3: (8.0, None, 2.0)}


def test_blend_weights():
    with pytest.raises(ValueError):
        panel.blend({"a": (None, 0.5), "b": (None, 0.4)})
