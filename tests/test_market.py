"""Index features, benchmark worths, trips, layers, coverage and leak checks by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audits, panel, serving, universe
from ledgerline.operators.market import Index, index_features
from ledgerline.sources import scans
from ledgerline.sources.layout import DuplicateKey

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(k)


def table(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


def test_index_features(spark):
    """The broad index doubles every day; the small one starts late and has no bar on one day, over which its returns reach further."""
    bars = [("A", day(k), 2.0**k) for k in range(30)] + [("S", day(k), 1.0 + k) for k in range(3, 30) if k != 20] + [("L", day(k), 10.0) for k in range(30)]
    got = {r.date: r for r in index_features(table(spark, bars, "code string, date date, close double"), [Index("A", "broad", (1, 20, 252), 20), Index("L", "large", (1,)), Index("S", "small", (5,))], "small", "large").collect()}
    assert len(got) == 30 and got[day(0)].broad_return_1d is None and got[day(5)].broad_return_1d == 1 and got[day(25)].broad_return_20d == 2.0**20 - 1 and got[day(29)].broad_return_252d is None
    assert got[day(8)].small_return_5d == pytest.approx(9 / 4 - 1) and got[day(20)].small_return_5d is None and got[day(21)].small_return_5d == pytest.approx(22 / 16 - 1)
    assert got[day(22)].size_spread_20d is None and got[day(24)].size_spread_20d == pytest.approx(25 / 4 - 1) and got[day(25)].large_return_1d == 0
    assert got[day(22)].broad_volatility_20d == pytest.approx(0, abs=1e-6) and got[day(20)].broad_volatility_20d is None
    late = index_features(table(spark, [b for b in bars if b[0] == "S"], "code string, date date, close double"), [Index("A", "broad", (1,)), Index("S", "small", (5,))])
    assert late.count() == 26  # without the first index the second's dates count


def test_benchmark_by_hand(spark):
    """Two codes from day 0; 2 is delisted on day 2. On day 3 code 3 comes alone. Worths 1, 1.5, 1, then held at it."""
    bars = table(spark, [(1, day(0), 10.0, 0), (1, day(1), 20.0, 0), (1, day(2), 20.0, 0), (2, day(0), 5.0, 0), (2, day(1), 5.0, 0), (2, day(2), 9.0, 0), (4, day(0), 1.0, 1), (3, day(3), 2.0, 0), (3, day(4), 3.0, 0)], "code long, date date, close double, is_st int")
    resets = table(spark, [(day(0), 1), (day(0), 2), (day(0), 4), (day(3), 3)], "effective_date date, code long")
    gone = table(spark, [(2, day(2))], "code long, delist_date date")
    got = [(r.date, r.nav, r.ret) for r in universe.benchmark(bars, resets, gone).orderBy("date").collect()]
    assert got == [(day(0), 1.0, None), (day(1), 1.5, 0.5), (day(2), pytest.approx(1.0), pytest.approx(-1 / 3)), (day(3), pytest.approx(1.0), pytest.approx(0)), (day(4), pytest.approx(1.5), pytest.approx(0.5))]
    assert universe.benchmark(bars.filter(F.col("date") == F.lit(day(0))), resets, gone).count() == 0


def test_trips_and_their_t(spark):
    trips = table(spark, [(2, 0.1), (4, 0.3), (9, -0.1)], "days int, trip_return double")
    r = panel.trip_summary(trips).first()
    assert (r.n, r.mean_days, r.median_days, r.win_rate) == (3, 5, 4, pytest.approx(2 / 3)) and r.t == pytest.approx(0.1 * math.sqrt(3) / 0.2)
    assert panel.trip_summary(trips.limit(1)).first().t is None and panel.trip_summary(trips.limit(0)).first().n == 0


def test_layers_and_levels(spark):
    rows, st = table(spark, [(c,) for c in range(6)], "code long"), table(spark, [(1, day(0), 1), (2, day(0), 1), (3, day(1), 1), (4, day(0), 0)], "code long, date date, is_st int")
    gone = table(spark, [(2, day(0)), (5, day(0)), (0, day(1)), (77, day(0))], "code long, delist_date date")
    assert tuple(universe.excluded_counts(rows, st, gone, F.lit(day(0))).first()) == (2, 2, 3, 3)
    parts = {n: table(spark, [(1, day(k), s) for k, s in d], "code long, date date, score double") for n, d in {"a": [(0, 1.0), (1, 1.0)], "b": [(0, 2.0), (1, None)]}.items()}
    asked = table(spark, [(day(k),) for k in range(3)], "date date")
    assert {r.date: (r.n_parts, r.level) for r in serving.day_levels(parts, asked).collect()} == {day(0): (2, "full"), day(1): (1, "partial"), day(2): (0, "placeholder")}
    assert serving.day_levels(parts).count() == 2


def test_coverage_and_tree(spark):
    bars = table(spark, [(c, day(k)) for c in (1, 2, 3) for k in range(40)], "code long, date date")
    own = bars.filter(f"date >= date '{day(20)}' and not (code = 2 and day(date) in (21, 22)) and code < 3")
    pool = table(spark, [(1,), (2,), (3,), (9,)], "code long")
    assert sorted(map(tuple, audits.coverage(pool, bars, own).collect())) == [(2, 20, 18), (3, 20, 0)]
    levels = [table(spark, [(1, "x"), (2, "y")], "code long, l1 string"), table(spark, [(2, "z")], "code long, l2 string")]
    assert sorted(map(tuple, scans.with_levels(pool, levels).collect())) == [(1, "x", None), (2, "y", "z"), (3, None, None), (9, None, None)]
    with pytest.raises(DuplicateKey):
        scans.with_levels(pool, [levels[0].union(levels[0])])


def checks(spark, reach=6, buffer=6, missing=(), **changes):
    """Ten codes on 40 days; the test begins on day 30, so with a buffer of 6 training ends before day 24."""
    rows = [(c, day(k)) for c in range(3) for k in range(40)]
    axis = table(spark, rows, "code long, date date")
    expected = axis.filter(f"date >= date '{day(30)}'")
    scored = expected.filter(~F.col("code").isin(*missing)) if missing else expected
    meta = {"train_start": day(0), "train_end": day(24), "test_start": day(30), "test_end": day(39), "far_crossing": 0, "slope": 1.0, "median": 0.0, "n_pred": 30} | changes
    return {r.check for r in audits.leak_checks(axis, axis, scored.withColumn("s", F.lit(0.0)), expected, meta, "s", reach, buffer, 5, day(30), day(39)).collect() if not r.ok}


def test_leaks(spark):
    assert checks(spark) == set()
    assert checks(spark, train_end=day(25)) == {"train ends a buffer before the test"}
    assert checks(spark, reach=7) == {"last label ends before the test", "buffer covers the label"}
    assert checks(spark, train_start=day(1), median=None, n_pred=31, far_crossing=2) == {"train starts where the axis does", "record has the calibration", "count is the record's", "crossing labels were left out"}
    assert checks(spark, missing=(1,)) == {"scored rows are those expected", "count is the record's"}
    assert checks(spark, test_end=day(38)) == {"test period is the record's"}


def test_walk_forward_keeps_excluded_rows_to_test(spark):
    rows = table(spark, [(c, day(k), None if c == 2 else 1.0) for c in (1, 2, 3) for k in range(10)], "code long, date date, label double")
    out = table(spark, [(1, day(k)) for k in range(10)], "code long, date date")
    got = universe.walk_forward_rows(rows, out, 2, F.lit(day(6)), F.lit(day(8)), F.lit(day(9)), 4)
    assert sorted((r.code, r.date, r.part) for r in got.collect()) == sorted([(3, day(k), "train") for k in range(2, 6)] + [(c, day(k), "test") for c in (1, 2, 3) for k in (8, 9)])
    assert universe.walk_forward_rows(rows, out, 2, F.lit(day(6)), F.lit(day(8)), F.lit(day(9)), 5).count() == 0
