import datetime as dt
import math
import random

import numpy as np
import pytest

from ledgerline.operators.selection import correlations, linkage, select


def greedy(distance, at_most):
    """The nearest two clusters of all merge, by the mean over all pairs of items, until they are too far apart."""
    parts = [[i] for i in range(len(distance))]
    while len(parts) > 1:
        d, a, b = min((np.mean([distance[i, j] for i in parts[a] for j in parts[b]]), a, b) for a in range(len(parts)) for b in range(a))
        if d > at_most:
            break
        parts[b] += parts.pop(a)
    return [min(next(p for p in parts if i in p)) for i in range(len(distance))]


def test_linkage_against_greedy_merges():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 25):
        for _ in range(12):
            x = rng.random((n, 2))
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            for cut in (0.0, 0.1, 0.3, 2.0):
                assert linkage(d, cut) == greedy(d, cut)


def test_correlations_of_rows_that_have_both(spark):
    rng, rows = random.Random(1), []
    for _ in range(700):
        a = rng.gauss(0, 1)
        rows.append((1e9 + a, None if rng.random() < 0.4 else a + rng.gauss(0, 1), float("nan") if rng.random() < 0.3 else -a, 5.0, float("inf") if rng.random() < 0.2 else rng.random(), None))
    df, names = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double"), list("abcdef")
    got = {(r.a, r.b): (r.n, r["corr"]) for r in correlations(df.repartition(5), names, block=64).collect()}
    x = np.array([[math.nan if v is None or not math.isfinite(v) else v for v in r] for r in rows])
    assert len(got) == 15
    for (p, q), (n, c) in got.items():
        u, v = x[:, names.index(p)], x[:, names.index(q)]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert n == both.sum()
        if "d" in (p, q) or "f" in (p, q):
            assert c is None
        else:
            assert math.isclose(c, np.corrcoef(u[both], v[both])[0, 1], rel_tol=1e-6, abs_tol=1e-9)


def test_one_feature_of_each_cluster(spark):
    rng, rows = random.Random(3), []
    for day in range(12):
        for code in range(30):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((code, dt.date(2024, 1, 1 + day), a + rng.gauss(0, 0.3), -a, b, b + rng.gauss(0, 0.2), rng.random(), a * 2 + b + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "code long, date date, noisy double, minus double, b double, near_b double, noise double, label double")
    got = select(df, ["noisy", "minus", "b", "near_b", "noise"], "label").orderBy("rank").collect()
    assert [(r.feature, r.cluster, r.rank) for r in got] == [("minus", "noisy", 1), ("b", "b", 2), ("noise", "noise", 3)] and got[0].ic < -0.8
    assert select(df, ["noisy", "minus", "b"], "label", most=1).count() == 1
    with pytest.raises(Exception, match="nothing"):
        select(df, ["nothing"], "label")
