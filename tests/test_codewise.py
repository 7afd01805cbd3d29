import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators.asof import asof
from ledgerline.operators.codewise import SHARES, Rolling, cost_distribution, cost_factors, entropy_of, euclidean, rolling

DAY = dt.date(2024, 1, 1)


def panel(spark, rows, kinds="x double, y double"):
    return spark.createDataFrame([(c, DAY + dt.timedelta(d), *v) for c, d, *v in rows], f"code long, date date, {kinds}")


def by_key(df, *columns):
    return {(r.code, r.date): tuple(r[c] for c in columns) for r in df.collect()}


def close(a, b):
    return all(x is None and y is None or x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b, strict=True))


def test_costs_against_all_days_before(spark):
    """Every day's weight counted anew for each row; turnovers so high that plain products would leave the range."""
    rng = random.Random(4)
    rows = [(c, d, rng.choice([None] * (rng.random() < 0.1) + [float(rng.randrange(1, 40))]), rng.choice([0.0, 0.0113, 0.317, 0.9371, 1.0, 1.5, None]) if c else 0.9431) for c in range(3) for d in range(400)]
    got = by_key(cost_distribution(panel(spark, rows), "x", "y"), "winner_rate", "weight_avg", "cost_5pct", "cost_15pct", "cost_50pct", "cost_85pct", "cost_95pct")
    for c in range(3):
        held = []
        for _, d, price, turn in [r for r in rows if r[0] == c]:
            if price is not None and turn is not None:
                t = min(1.0, turn)
                held = [(p, w * (1 - t)) for p, w in held if w * (1 - t) > 1e-300] + ([(price, t)] if t else [])
            total = sum(w for _, w in held)
            if not total:
                want = (None,) * 7
            else:
                ordered = sorted(held)
                sums = list(itertools.accumulate(w for _, w in ordered))
                at = [next((p for (p, _), s in zip(ordered, sums, strict=True) if s >= q * total * (1 - 1e-12)), ordered[-1][0]) for q in SHARES]
                want = (None if price is None else sum(w for p, w in held if p <= price) / total, sum(p * w for p, w in held) / total, *at)
            assert close(got[c, DAY + dt.timedelta(d)], want), (c, d, got[c, DAY + dt.timedelta(d)], want)


def test_cost_factors_by_hand(spark):
    """10 at half of the stock, then 20 at half of it: a third paid 10 and two thirds 20."""
    r = cost_factors(cost_distribution(panel(spark, [(1, 0, 10.0, 0.5), (1, 1, 20.0, 0.5)]), "x", "y")).orderBy("date").collect()
    assert r[0].winner_rate == 1 and r[0].cost_position == 0
    assert (r[1].winner_rate, r[1].cost_15pct, r[1].cost_50pct, r[1].cost_85pct) == (1, 10, 20, 20) and math.isclose(r[1].weight_avg, 50 / 3)
    assert math.isclose(r[1].cost_position, (20 - 50 / 3) / 10) and math.isclose(r[1].chip_dispersion, 0.5) and math.isclose(r[1].chip_skew, (20 - 50 / 3) / 10)


def test_rolling_against_whole_windows(spark):
    rng = random.Random(8)
    rows = [(c, d, None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(rng.randrange(30)), 0.0) for c in (None, 1, 2) for d in range(120)]
    specs = [Rolling("r", "x", 20, "rank", least=5), Rolling("full", "x", 4, "rank"), Rolling("q", "x", 20, "quantile", 0.3, 3), Rolling("lo", "x", 7, "min", least=1), Rolling("hi", "x", 7, "max", least=1)]
    got = by_key(rolling(panel(spark, rows), specs), "r", "full", "q", "lo", "hi")
    for c in (None, 1, 2):
        x = [math.nan if r[2] is None else r[2] for r in rows if r[0] == c]
        for d, v in enumerate(x):
            def win(n):
                return [y for y in x[max(0, d - n + 1) : d + 1] if y == y]  # noqa: B023
            a, b, e = win(20), win(4), win(7)
            want = (sum(y <= v for y in a) / len(a) if len(a) >= 5 and v == v else None, sum(y <= v for y in b) / 4 if len(b) == 4 else None, float(np.quantile(a, 0.3)) if len(a) >= 3 else None, min(e) if e else None, max(e) if e else None)
            assert close(got[c, DAY + dt.timedelta(d)], want), (c, d)
    with pytest.raises(ValueError):
        rolling(panel(spark, rows), [Rolling("r", "x", 2, "mode")])


def test_entropy_and_length(spark):
    r = spark.sql("select 0.25D as a, 0.75D as b, 0D as z, cast(null as double) as n").select(entropy_of([F.col("a"), F.col("b"), F.col("z")]).alias("e"), entropy_of([F.col("a"), F.col("n")]).alias("n"), euclidean([F.lit(3.0), F.lit(4.0)]).alias("l")).first()
    assert math.isclose(r.e, -0.25 * math.log(0.25) - 0.75 * math.log(0.75)) and r.n is None and r.l == 5


@pytest.mark.parametrize("direction, strict, bucket", list(itertools.product(["backward", "forward"], [False, True], [None, "floor(t / 7)"])))
def test_asof_against_all_pairs(spark, direction, strict, bucket):
    rng = random.Random(7)
    left = [(rng.choice([1, 2, None]), rng.choice([None, *range(40)]), k) for k in range(90)]
    right = [(rng.choice([1, 2, None]), rng.choice([None, *range(40)]), rng.randrange(100), str(k)) for k in range(40)]
    df, other = spark.createDataFrame(left, "g long, t long, k long"), spark.createDataFrame(right, "g long, t long, v long, s string")
    got = asof(df, other, ["g"], "t", ["v", "s"], direction, F.abs(F.col("t") - F.col("_on")) <= 9, strict, None if bucket is None else F.expr(bucket))
    back = direction == "backward"
    want = []
    for g, t, k in left:
        near = [(u, v, s) for h, u, v, s in right if h == g and t is not None and u is not None and (u < t if back else u > t) | (not strict and u == t)]
        best = max(near, key=lambda x: ((x[0] if back else -x[0]), x[1], x[2])) if near else None
        want.append((g, t, k, *((best[1], best[2]) if best and abs(best[0] - t) <= 9 else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        asof(df, other, ["g"], "t", ["v"], "nearest")
