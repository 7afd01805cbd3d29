"""Audits and the universe builder by values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audits, panel, universe, upkeep

DAY = dt.date(2024, 1, 1)
INF, NAN = float("inf"), float("nan")


def day(k):
    return DAY + dt.timedelta(k)


def table(spark, rows, kinds):
    return spark.createDataFrame(rows, f"code long, date date, {kinds}")


def test_tolerance_is_relative_to_the_stored_value(spark):
    """100 against 100.00999 is within 1 in 10,000 of the stored 100, 100.0101 isn't; 90 against 100 at a tenth is beyond 9, though not beyond a tenth of 100."""
    s = table(spark, [(k, DAY, v) for k, v in enumerate([100.0, 100.0, None, NAN, None, INF, INF, 0.0, -100.0])], "x double")
    f = table(spark, [(k, DAY, v) for k, v in enumerate([100.00999, 100.0101, None, None, 1.0, INF, -INF, 1e-13, -100.0101])] + [(99, DAY, 1.0)], "x double")
    assert [tuple(r) for r in audits.stale_cells(s, f, ["x"]).collect()] == [("x", 9, 4)]
    ninety, hundred = table(spark, [(1, DAY, 90.0)], "x double"), table(spark, [(1, DAY, 100.0)], "x double")
    assert audits.stale_cells(ninety, hundred, ["x"], rtol=0.1).first().stale == 1 and audits.stale_cells(hundred, ninety, ["x"], rtol=0.1).first().stale == 0


def test_staleness_audit_samples_members_only(spark):
    stored = table(spark, [(c, day(d), 1.0, 1.0) for c in (1, 2) for d in range(10)], "x double, x_rank double")
    fresh = table(spark, [(c, day(d), 2.0 if c == 1 and d in (4, 7) else 1.0, 9.0) for c in (1, 2) for d in range(10)], "x double, x_rank double")
    members = table(spark, [(1, day(d), 0) for d in range(4, 10)] + [(2, day(5), 0)], "n int").select("code", "date")
    got = [tuple(r) for r in audits.staleness_audit(stored, fresh, members, ["x", "x_rank"], 3).orderBy("date").collect()]
    assert got == [(day(4), 1, 1, 1, 1), (day(6), 1, 0, 0, 0), (day(8), 1, 0, 0, 0)]


def pulled(spark, counts):
    return table(spark, [(c, day(d), None if d == 25 and c == 0 else 1.0) for d, n in counts.items() for c in range(n)], "f double")


def test_days_that_came_in_short(spark):
    """20 days of 10 and 14 rows in turns: the median is 12, so 9 are enough and 8 are too few; the upper median would be 14."""
    counts = {d: 10 if d % 2 else 14 for d in range(20)} | {20: 9, 25: 40}
    asked = spark.createDataFrame([(day(d),) for d in (0, 20, 22, 25)], "date date")
    got = {r.date: (r.n, r.usual, r.wrong) for r in audits.pull_checks(pulled(spark, counts), asked, "f").collect()}
    assert got == {day(22): (0, 10.0, "empty"), day(25): (40, 10.0, "nulls")}  # days 1 to 20: one of 9, ten of 10 and nine of 14
    got = {r.date: (r.n, r.usual, r.wrong) for r in audits.pull_checks(pulled(spark, counts | {20: 8}), asked).collect()}
    assert got == {day(20): (8, 12.0, "rows"), day(22): (0, 10.0, "empty")}
    assert audits.pull_checks(pulled(spark, {0: 3}), asked.filter(F.col("date") == F.lit(DAY))).count() == 0


def report(spark, panel_rows, bar_rows, open_days, **options):
    p = table(spark, panel_rows, "x double, y double")
    b = table(spark, bar_rows, "adj_factor double")
    calendar = spark.createDataFrame([(day(d),) for d in open_days], "date date")
    return {r.check: (r.severity, r.found) for r in audits.integrity_report(p, calendar, b, ["x", "y"], ["x"], **options).collect()}


def test_integrity_of_a_sound_panel(spark):
    rows = [(c, day(d), 1.0, 1.0) for d in range(30) for c in range(10)]
    got = report(spark, rows, [r[:3] for r in rows], range(30))
    assert len(got) == 12 and {n for _, n in got.values()} == {0}


def test_integrity_faults_by_hand(spark):
    bars = [(c, day(d), None if d == 29 and c == 0 else 1.0) for d in range(30) for c in range(10) if d != 17]
    # from day 2 on, not day 9, code 3 lacks 5 days, the last day has 6 rows without x, y is mostly NULL
    p = [(c, day(d), None if d == 29 else 1.0, 1.0 if d < 6 else None) for d in range(2, 30) for c in range(10) if d not in (9, 17) and not (c == 3 and d in (11, 12, 13, 14, 15)) and (d < 29 or c < 6)]
    got = {k: n for k, (_, n) in report(spark, p, bars, range(30)).items()}
    # codes 6 to 9 lack days 9 and 29: 25 of 27 rows are under 95 %; codes 0 to 5 lack day 9 only: 26 of 27 are over it, but for code 3 with 21
    assert got == {
        "latest day, panel": 0, "latest day, bars": 0, "holes": 1, "panel drift": 1, "bars drift": 0, "factor nulls": 1, "panel calendar": 2, "bars calendar": 1,
        "value health": 1, "null rate": 1, "short codes": 5, "short rows": 4 * 2 + 6,
    }


def test_the_latest_day_is_hard(spark):
    rows = [(c, day(d), 1.0, 1.0) for d in range(25) for c in range(4)]
    bars = [r[:3] for r in rows]
    late = report(spark, rows, bars, range(26))
    assert late["latest day, panel"] == ("hard", 0) and late["latest day, bars"] == ("hard", 1)
    assert report(spark, rows, bars, range(26), evening=False)["latest day, bars"] == ("soft", 1)
    made = report(spark, rows, bars + [(1, day(25), 1.0)], range(26))
    assert made["latest day, panel"] == ("hard", 1) and made["latest day, bars"][1] == 0 and made["bars drift"][1] == 1


def test_scores_that_are_no_numbers(spark):
    rows = [(k, day(k), float(p), float(y)) for k, (p, y) in enumerate([(1, 2), (2, 4), (3, 6)])]
    bad = [(7, day(3), NAN, 1.0), (8, day(3), 1.0, NAN), (9, day(3), INF, 1.0), (10, day(3), 1.0, -INF)]
    assert panel.l1_slope(table(spark, rows + bad, "p double, y double"), "p", "y").first().slope == 2
    c = panel.calibration(table(spark, rows + bad, "p double, y double"), "p", "y", F.lit(day(9)), least=2).first()
    assert c.slope == 2 and c["median"] == 4


def test_rebuild_of_ties(spark):
    old = table(spark, [(1, DAY, 5.0)], "kept double")
    for rows in ([(1, DAY, 1, 2.0), (1, DAY, 1, 3.0)], [(1, DAY, 1, 3.0), (1, DAY, 1, 2.0)]):
        got = upkeep.rebuild(old, table(spark, rows, "seen int, v double"), ["code", "date"], "seen").collect()
        assert [tuple(r) for r in got] == [(1, DAY, 3.0, 5.0)]


RULES = universe.Universe("main", ("00", "60"), 1.0, 40.0, 2026, 0.5, 10.0, 5)


def test_band_of_a_day(spark):
    """Half of ten years before the base year is a half to the power of a half; nothing after it."""
    days = [dt.date(2016, 1, 1), dt.date(2021, 1, 1), dt.date(2026, 1, 1), dt.date(2030, 5, 5), dt.date(2024, 12, 31)]
    got = {r.d: (r.y, r.f) for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", universe.decimal_year(F.col("d")).alias("y"), universe.decay(F.col("d"), RULES).alias("f")).collect()}
    assert [got[d][1] for d in days[:4]] == pytest.approx([0.5, math.sqrt(0.5), 1, 1])
    assert got[days[4]][0] == pytest.approx(2024 + 365 / 366)


def test_snapshots_by_hand(spark):
    opens = [dt.date(2025, 5, 20) + dt.timedelta(k) for k in range(40)]
    calendar = spark.createDataFrame([(d,) for d in opens], "date date")
    cut = dt.date(2025, 5, 31)
    low, high = (round(x * 0.5 ** ((2026 - (2025 + 150 / 365)) / 10) * 10000) for x in (1.0, 40.0))
    basics = spark.createDataFrame([("000001", cut, low + 1.0), ("000002", cut, float(low)), ("600003", cut, high - 1.0), ("600004", cut, float(high)), ("300005", cut, 99999.0), ("300006", cut, 99999.0), ("000007", cut, 99999.0), ("000008", cut, 99999.0), ("000009", opens[0], 99999.0), ("000010", cut, 99999.0)], "code string, date date, size double")
    info = [(c, None, dt.date(2000, 1, 1)) for c in ("000001", "000002", "600003", "600004", "300005", "000009")]
    info += [("300006", "main", dt.date(2025, 5, 26)), ("000007", "other", dt.date(2000, 1, 1)), ("000008", "main", dt.date(2025, 5, 27)), ("000010", "main", None)]
    rows = spark.createDataFrame(info, "code string, market string, list_date date").withColumn("mark", F.col("code"))
    got = [tuple(r) for r in universe.build_snapshots(calendar, basics, rows, RULES, 2025).collect()]
    # 300006 was listed five open days before the cutoff, 000008 four
    assert sorted(got) == [(dt.date(2025, 6, 1), cut, c) for c in ("000001", "300006", "600003")]
    everyone = universe.Universe("main", ("00", "60"), None, None, 2026, 0.5, 10.0, 0)
    assert universe.build_snapshots(calendar, basics, rows, everyone, 2025).count() == 6 and universe.build_snapshots(calendar, basics, rows, everyone, 2026).count() == 0
