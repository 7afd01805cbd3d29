import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators.boosting import Model, Rules, Tree, best_split, edges_of, fit, out_of_fold
from ledgerline.operators.panel import rank_ic

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """A label that rises with a, has a step at b, depends on whether c is missing, and has a few wild values; d is noise."""
    rng, made = random.Random(3), []
    for day in range(60):
        for code in range(40):
            a, b, c, d = rng.gauss(0, 1), rng.random(), None if rng.random() < 0.3 else rng.random(), rng.gauss(0, 1)
            y = a + 3 * (b > 0.6) + 2 * (c is None) + rng.gauss(0, 0.3) + (1000 if rng.random() < 0.01 else 0)
            made.append((code, DAY + dt.timedelta(day), a if rng.random() < 0.99 else float("nan"), b, c, d, y if rng.random() < 0.98 else None))
    return spark.createDataFrame(made, "code long, date date, a double, b double, c double, d double, y double").cache()


def brute_split(bins, grad, rules):
    """Every feature, cut and side, over the rows themselves."""
    n, best = len(grad), None
    score = lambda s, k: max(abs(s) - rules.lasso, 0) ** 2 / (k + rules.ridge)
    for f in range(bins.shape[1]):
        for left in (False, True):
            for cut in range(1, rules.bins + 1):
                goes = np.where(bins[:, f] == 0, left, bins[:, f] <= cut)
                k = int(goes.sum())
                if k >= rules.least and n - k >= rules.least:
                    gain = score(grad[goes].sum(), k) + score(grad[~goes].sum(), n - k) - score(grad.sum(), n)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut, left
    return best


@pytest.mark.parametrize("lasso", [0.0, 3.0])
def test_split_against_all_rows(lasso):
    rng, rules = np.random.default_rng(5), Rules(bins=8, least=7, lasso=lasso)
    for _ in range(40):
        bins, grad = rng.integers(0, 9, (90, 3)), rng.integers(-3, 4, 90)
        g, n = np.zeros((3, 9), np.int64), np.zeros((3, 9), np.int64)
        for f in range(3):
            np.add.at(g[f], bins[:, f], grad)
            np.add.at(n[f], bins[:, f], 1)
        got, want = best_split(g, n, rules, [0, 1, 2]), brute_split(bins, grad, rules)
        assert (got is None) == (want is None) and (got is None or (math.isclose(got[0], want[0], rel_tol=1e-9) and got[1:] == want[1:]))


def test_first_tree_is_that_of_the_rows_in_one_place(rows):
    """A tree of depth 1 without draws, against the same rows collected: split by brute force, leaves as medians."""
    rules = Rules(rounds=1, depth=1, bins=16, rows=1.0, features=1.0, rate=1.0, held_out=0.1)
    model = fit(rows, ["a", "b", "c"], "y", rules=rules)
    t, here = model.trees[0], rows.filter("y is not null").toPandas()
    here = here[here.date < sorted(here.date.unique())[-6]]
    bins = model.bins_of([here[c].to_numpy(float) for c in "abc"])
    rest = here.y.to_numpy() - model.start
    want = brute_split(bins, np.sign(rest).astype(int), rules)
    assert (t.feature[0], t.bin[0], t.left[0]) == want[1:]
    leaf = t.leaves(bins)
    for i in (1, 2):
        values = np.sort(rest[leaf == i])
        assert values[len(values) // 2 - 2] <= t.value[i] <= values[len(values) // 2 + 2]


@pytest.mark.parametrize("loss", ["l1", "l2"])
def test_held_out_dates(rows, loss):
    """Outliers of 1000 in one label of a hundred: the absolute loss still ranks dates that no model has seen."""
    rules = Rules(loss=loss, rounds=12, depth=3, bins=24, rate=0.3, least=10, held_out=0.1)
    train = rows.filter(F.col("date") < F.lit(DAY + dt.timedelta(50)))
    model = fit(train, ["a", "b", "c", "d"], "y", rules=rules)
    assert model.dumps() == fit(train.repartition(7), ["a", "b", "c", "d"], "y", rules=rules).dumps() or loss == "l1"
    assert Model.loads(model.dumps()) == model and 0 < len(model.trees) <= 12
    seen = model.predict(rows.filter(F.col("date") >= F.lit(DAY + dt.timedelta(50))))
    ic = rank_ic(seen.filter("y is not null"), "score", "y").agg(F.avg("ic")).first()[0]
    assert ic > (0.85 if loss == "l1" else 0.3)
    if loss == "l1":
        assert model.losses[len(model.trees) - 1] < model.losses[0]


def test_edges_and_missing(spark, rows):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("inf"), None), (float("nan"), None), (3.0, None)], "x double, z double")
    edges = edges_of(df, ["x", "z"], 4)
    assert edges[0] == [1.0, 2.0, 3.0] and edges[1] == []
    m = Model(["x", "z"], edges, 5.0, [Tree([0, -1, -1], [1, 0, 0], [True, False, False], [0.0, 1.0, 2.0])])
    assert [r.score for r in m.predict(df).orderBy("x").collect()] == [6.0, 7.0, 7.0, 6.0, 6.0]
    with pytest.raises(ValueError):
        fit(rows, ["a"], "y", rules=Rules(loss="l3"))
    with pytest.raises(ValueError):
        fit(rows.filter("code = 1").limit(1), ["a"], "y")


def test_no_score_knows_its_own_time(rows, monkeypatch):
    """Which rows each model saw: all at least `buffer` dates before its segment; after frozen_from one last model."""
    from ledgerline.operators import boosting

    saw = []

    class Constant(Model):
        pass

    def spy(df, features, label, at, rules):
        saw.append(df.agg(F.max("date")).first()[0])
        return Constant(["a"], [[]], float(len(saw)))

    monkeypatch.setattr(boosting, "fit", spy)
    out = out_of_fold(rows, ["a"], "y", first=20, every=10, buffer=3, least=100)
    scores = {r.date: r.score for r in out.select("date", "score").distinct().collect()}
    assert saw == [DAY + dt.timedelta(d) for d in (16, 26, 36, 46)] and min(scores) == DAY + dt.timedelta(20) and len(scores) == 40
    assert all(scores[DAY + dt.timedelta(20 + k)] == k // 10 + 1 for k in range(40))
    saw.clear()
    out_of_fold(rows, ["a"], "y", first=20, every=10, buffer=3, least=100, frozen_from=DAY + dt.timedelta(35)).count()
    assert saw == [DAY + dt.timedelta(d) for d in (16, 26, 31)]
    assert out_of_fold(rows, ["a"], "y", first=20, every=10, least=10**9).count() == 0


def test_queries_of_models(spark):
    """Every bar from the 960th date on has a score of the expanding walk, and every bar of the half year one of the live model, with one zero."""
    from ledgerline.plans import models

    sf = "/root/testdata/sf0.001"
    bars = models.featured(spark, sf).cache()
    dates = sorted(r.date for r in bars.select("date").distinct().collect())
    walk = models.QUERIES["boosted_out_of_fold"](spark, sf).collect()
    assert {(r.code, r.date) for r in walk} == {(r.code, r.date) for r in bars.filter(F.col("date") >= F.lit(dates[960])).collect()} and all(r.gb_gap_1d is not None for r in walk)
    live = models.QUERIES["boosted_scores"](spark, sf).collect()
    assert len(live) == bars.filter("date between date '2000-01-01' and date '2000-06-30'").count() and len({r.zero for r in live}) == 1 and all(r.score is not None for r in live)
    chosen = models.QUERIES["selected_features"](spark, sf).orderBy("rank").collect()
    assert [r["rank"] for r in chosen] == list(range(1, len(chosen) + 1)) and len({r.cluster for r in chosen}) == len(chosen) and abs(chosen[0].ic) >= abs(chosen[-1].ic)
