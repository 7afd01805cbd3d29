"""Some published formulas against plain pandas over random bars."""

import datetime

import numpy as np
import pandas as pd
import pytest

from ledgerline.functions.exprs import staged
from ledgerline.operators.alphas import stages_of

DAYS, CODES = 110, 6


def made():
    r = np.random.default_rng(7)
    rows = []
    for code in range(CODES):
        for k in range(DAYS):
            low, up = r.uniform(5, 10), r.uniform(1, 3)
            o, c, v = low + up * r.uniform(), low + up * r.uniform(), float(r.integers(10, 500))
            rows.append((code, datetime.date(2024, 1, 1) + datetime.timedelta(k), o, low + up, low, c, v, v * (low + up * r.uniform())))
    return pd.DataFrame(rows, columns=["code", "date", "open", "high", "low", "close", "volume", "amount"])


def wide(bars):
    w = {c: bars.pivot(index="date", columns="code", values=c) for c in bars.columns[2:]}
    return w | {"vwap": w["amount"] / w["volume"]}


def rank(x):
    """Values are compared to nine decimals, as the formulas' ranks say."""
    return x.round(9).rank(axis=1, pct=True)


def over(x, n, f):
    return x.rolling(n).apply(f, raw=True)


def ts_rank(x, n):
    return over(x, n, lambda v: (v <= v[-1]).mean())


def decay(x, n):
    return over(x, n, lambda v: v @ np.arange(1, n + 1) / (n * (n + 1) / 2))


def corr(x, y, n):
    """None where a side is constant, for which the rolling one gives noise."""
    moves = lambda z: z.rolling(n).max() > z.rolling(n).min()
    return pd.DataFrame({c: x[c].rolling(n).corr(y[c]) for c in x}).where(moves(x) & moves(y))


def exact_corr(x, y, n):
    """Each window by itself, to twelve decimals: windows of the same pairs tie, which sums kept while rolling hide."""
    out = pd.DataFrame(np.nan, x.index, x.columns)
    for c in x:
        for k in range(n - 1, len(x)):
            a, b = x[c].to_numpy()[k - n + 1 : k + 1], y[c].to_numpy()[k - n + 1 : k + 1]
            if not np.isnan(a + b).any() and np.ptp(a) and np.ptp(b):
                out.loc[x.index[k], c] = round(np.corrcoef(a, b)[0, 1], 12)
    return out


def neutral(x, groups):
    return x - x.T.groupby([c % groups for c in x]).transform("mean").T


@pytest.mark.parametrize("n", [58, 65, 77, 84, 98])
def test_formula_as_pandas_has_it(spark, n):
    bars = made()
    w = wide(bars)
    adv = lambda n: w["amount"].rolling(n).mean()
    less = rank(corr(w["open"] * 0.00817205 + w["vwap"] * (1 - 0.00817205), adv(60).rolling(8).sum(), 6)), rank(w["open"] - w["open"].rolling(13).min())
    base, power = ts_rank(w["vwap"] - w["vwap"].rolling(15).max(), 20), w["close"] - w["close"].shift(4)
    least = over(exact_corr(rank(w["open"]), rank(adv(15)), 20), 8, lambda v: float(len(v) - np.argmin(v[::-1])))
    mid = (w["high"] + w["low"]) / 2
    want = {
        58: -ts_rank(decay(corr(neutral(w["vwap"], 5), w["volume"], 3), 7), 5),
        65: -(less[0] < less[1]).astype(float).where(less[0].notna() & less[1].notna()),
        77: np.minimum(rank(decay(mid + w["high"] - (w["vwap"] + w["high"]), 20)), rank(decay(corr(mid, adv(40), 3), 5))),
        84: base**power,
        98: rank(decay(corr(w["vwap"], adv(5).rolling(26).sum(), 4), 7)) - rank(decay(ts_rank(least, 6), 8)),
    }
    x = want[n]
    stages, names = stages_of([n])
    got = staged(spark.createDataFrame(bars), stages).select("code", "date", *names).toPandas()
    mine = got.pivot(index="date", columns="code", values=names[0]).astype(float)
    np.testing.assert_allclose(mine.to_numpy(), x.to_numpy(), atol=1e-8, err_msg=str(n))
    assert mine.notna().sum().sum() > 100
