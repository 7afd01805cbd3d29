"""The daily run's operators on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.exprs import roll, staged
from ledgerline.operators import serving

DAY = lambda n: dt.date(2026, 1, n)


def test_retries_double_the_wait_and_raise_the_last():
    waits, left = [], [1, 2]

    def call():
        if left:
            raise OSError(left.pop())
        return "done"

    assert serving.retried(call, pause=waits.append) == "done" and waits == [2, 4]
    with pytest.raises(ZeroDivisionError):
        serving.retried(lambda: 1 / 0, tries=2, pause=waits.append)
    assert waits == [2, 4, 2]


def test_recomputed_equals_the_whole_where_the_look_back_suffices(spark):
    rows = spark.createDataFrame([(c, DAY(1) + dt.timedelta(k), float(k * c % 7)) for c in (1, 2) for k in range(30)], "code long, date date, close double")
    stages = [{"m": roll("avg", "close", 5, 5)}]
    targets = rows.filter(F.col("date") > DAY(25)).select("date")
    whole = sorted(map(tuple, staged(rows, stages).join(targets.distinct(), "date").select("code", "date", "m").collect()))
    assert sorted(map(tuple, serving.recomputed(rows, targets, 5, stages, ["m"]).collect())) == whole
    short = serving.recomputed(rows, targets, 2, stages, ["m"]).filter(F.col("date") == DAY(26)).collect()
    assert all(r["m"] is None for r in short)
    assert serving.recomputed(rows, targets.limit(0), 5, stages, ["m"]).count() == 0


def test_target_date_levels(spark):
    frame = lambda *days: spark.createDataFrame([(1, d) for d in days], "code long, date date")
    at = lambda asked=None: tuple(serving.target_date([frame(DAY(3), DAY(5))], frame(DAY(4), DAY(8)), asked).first())
    assert at() == (DAY(8), "live")
    assert at(F.lit(DAY(5))) == (DAY(5), "stored") and at(F.lit(DAY(4))) == (DAY(4), "placeholder")
    assert tuple(serving.target_date([frame(DAY(9))], frame(DAY(8))).first()) == (DAY(9), "stored")


def test_candidates_leave_out_held_st_and_delisted(spark):
    scores = spark.createDataFrame([(c, DAY(2), s) for c, s in ((1, 9.0), (2, 8.0), (3, 7.0), (4, 6.0), (5, 6.0), (6, None))], "code long, date date, score double")
    none = scores.limit(0).select("code", "date")
    st = spark.createDataFrame([(2, DAY(2), 1), (4, DAY(2), 0), (5, DAY(2), None)], "code long, date date, is_st int")
    gone = spark.createDataFrame([(3, DAY(2)), (5, DAY(3))], "code long, delist_date date")
    held = scores.filter("code = 1").select("code", "date")
    pick = lambda h, k: [r["code"] for r in serving.candidates(scores, h, st, gone, k).orderBy("rank").collect()]
    assert pick(held, 5) == [4, 5] and pick(none, 2) == [1, 4]


def test_flags_default_to_false(spark):
    rows = spark.createDataFrame([(1, DAY(1)), (2, DAY(1)), (3, DAY(1))], "code long, date date")
    flags = spark.createDataFrame([(1, DAY(1), 1), (2, DAY(1), None)], "code long, date date, f int")
    assert [r["f"] for r in serving.aligned(rows, flags, ["f"]).orderBy("code").collect()] == [True, False, False]


def test_sources_and_builders_are_checked(spark):
    with pytest.raises(ValueError):
        serving.fetch_dates(None, None, F.lit(DAY(1)), {"a": "weekly"})
    with pytest.raises(ValueError):
        serving.builders_of(["m_x", "plain"], ["m_"], {})
    assert serving.builders_of(["m_x", "plain"], ["m_"], {"m_x": len, "m_y": max}) == {"m_x": len}
