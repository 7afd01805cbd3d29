"""Operators that walk each code's rows in order of date with a structure of their own: cost distributions and order statistics.

Rows are dealt by code and sorted, and a task streams them code by code, so it holds one code's columns at a time. What a structure costs is a
logarithm, or its window, for each row; nothing is compared with all rows before it."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Walk = Callable[[list[np.ndarray]], list[np.ndarray]]


def walked(rows: DataFrame, needs: list[str], gives: list[str], walk: Walk) -> DataFrame:
    """rows with the doubles `gives`, which walk makes from a code's columns `needs` in order of date; NULL and NaN are NaN in both directions,
    and NULL in the result. Codes may be NULL; of equal dates of a code the order is open."""
    kinds = dict(rows.dtypes)
    cast = [F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(needs)]
    dealt = rows.select("*", *cast).repartition("code").sortWithinPartitions("code", "date")
    n, code_at = len(needs), rows.columns.index("code")

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        columns = [whole.column(whole.num_columns - n + k).to_numpy(zero_copy_only=False).astype(float) for k in range(n)]
        made = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in walk(columns)]
        kept = whole.select(range(whole.num_columns - n))
        for name, x in zip(gives, made, strict=True):
            kept = kept.append_column(name, x)
        return kept.to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: object = None
        for b in batches:
            codes = b.column(code_at)
            keys = codes.to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and keys[lo] != now:
                    yield finish(held)
                    held = []
                now = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield finish(held)

    ddl = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return dealt.mapInArrow(run, f"{ddl}, " + ", ".join(f"`{g}` double" for g in gives))


# -- what holders have paid ------------------------------------------------------------------------------------------------
SHARES = (0.05, 0.15, 0.5, 0.85, 0.95)


class CostTree:
    """Weights by price as a Fenwick tree over the code's prices; a day's turnover takes its share from all weights and adds itself.

    What is left of a day's weight is turn * prod(1 - later turns). With that product as a quotient of prefix products, a day's weight relative to the
    others never changes again, so a day is one addition; logarithms of the prefix products keep it in range."""

    def __init__(self, prices: np.ndarray) -> None:
        self.prices = np.unique(prices[~np.isnan(prices)])
        self.size = 1 << max(0, len(self.prices) - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.tree, self.sold, self.total, self.paid = [0.0] * (self.size + 1), 0.0, 0.0, 0.0

    def trade(self, price: float, turn: float) -> None:
        turn = min(1.0, turn)
        if turn <= 0:
            return
        if turn == 1:  # all have sold
            self.clear()
        else:
            self.sold -= math.log1p(-turn)
            if self.sold > 500:
                down = math.exp(-self.sold)
                self.tree, self.total, self.paid, self.sold = [x * down for x in self.tree], self.total * down, self.paid * down, 0.0
        weight = turn * math.exp(self.sold)
        self.total += weight
        self.paid += weight * price
        i = int(np.searchsorted(self.prices, price)) + 1
        while i <= self.size:
            self.tree[i] += weight
            i += i & -i

    def upto(self, price: float) -> float:
        """The share that has paid at most the price."""
        i, s = int(np.searchsorted(self.prices, price, side="right")), 0.0
        while i:
            s += self.tree[i]
            i -= i & -i
        return s / self.total

    def quantile(self, share: float) -> float:
        """The least price that at least the share has paid."""
        want, at, step = share * self.total, 0, self.size
        while step:
            if at + step <= len(self.prices) and self.tree[at + step] < want:
                at += step
                want -= self.tree[at]
            step >>= 1
        return float(self.prices[min(at, len(self.prices) - 1)])


def _costs(columns: list[np.ndarray]) -> list[np.ndarray]:
    prices, turns = columns
    tree, out = CostTree(prices), np.full((len(SHARES) + 2, len(prices)), np.nan)
    for k, (price, turn) in enumerate(zip(prices.tolist(), turns.tolist(), strict=True)):
        if price == price and turn == turn:
            tree.trade(price, turn)
        if tree.total > 0:
            if price == price:
                out[0, k] = tree.upto(price)
            out[1, k] = tree.paid / tree.total
            for j, share in enumerate(SHARES):
                out[2 + j, k] = tree.quantile(share)
    return list(out)


COSTS = ["winner_rate", "weight_avg", *(f"cost_{round(100 * s)}pct" for s in SHARES)]


def cost_distribution(rows: DataFrame, price: str = "close", turn: str = "turn") -> DataFrame:
    """rows with winner_rate (the share of holders who paid at most the price), weight_avg (what they paid in the mean) and the prices that
    5, 15, 50, 85 and 95 % of them paid at most. turn: the share of the stock that changes hands in a day, by its price; days without either change
    nothing. NULL before the first trade."""
    return walked(rows, [price, turn], COSTS, _costs)


def cost_factors(rows: DataFrame) -> DataFrame:
    """winner_rate as it is, and where the middle of the costs lies, how wide and how lopsided they are; a width of 0 counts as 1e-10."""
    c, e = F.col, F.lit(1e-10)
    return rows.withColumns({
        "cost_position": (c("cost_50pct") - c("weight_avg")) / (c("cost_95pct") - c("cost_5pct") + e),
        "chip_dispersion": (c("cost_85pct") - c("cost_15pct")) / (c("cost_50pct") + e),
        "chip_skew": (c("cost_50pct") - c("weight_avg")) / (c("cost_85pct") - c("cost_15pct") + e),
    })


# -- order statistics of long windows ----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Rolling:
    """kind: `rank` (share of the window that is at most this value), `quantile` (at `share`, linear between values), `min`, `max`; over the last n rows;
    NULL unless at least `least` of them have a value (all n by default), and for `rank` this row too."""

    name: str
    of: str
    n: int
    kind: str
    share: float = 0.5
    least: int | None = None


def _one(s: Rolling, x: list[float]) -> np.ndarray:
    least, out, window = s.n if s.least is None else s.least, np.full(len(x), np.nan), []
    for k, v in enumerate(x):
        if k >= s.n and (old := x[k - s.n]) == old:
            del window[bisect_left(window, old)]
        if v == v:
            insort(window, v)
        if len(window) < max(1, least) or s.kind == "rank" and v != v:
            continue
        if s.kind == "rank":
            out[k] = bisect_right(window, v) / len(window)
        elif s.kind == "min":
            out[k] = window[0]
        elif s.kind == "max":
            out[k] = window[-1]
        else:
            at = s.share * (len(window) - 1)
            i = int(at)
            out[k] = window[i] + (at - i) * (window[min(i + 1, len(window) - 1)] - window[i])
    return out


def rolling(rows: DataFrame, specs: list[Rolling]) -> DataFrame:
    """rows with one column for each spec, from a sorted window that gains and loses one value a row."""
    if bad := [s.kind for s in specs if s.kind not in ("rank", "quantile", "min", "max")]:
        raise ValueError(f"no such kind: {bad[0]}")
    needs = sorted({s.of for s in specs})
    return walked(rows, needs, [s.name for s in specs], lambda columns: [_one(s, columns[needs.index(s.of)].tolist()) for s in specs])


# -- of a row's parts --------------------------------------------------------------------------------------------------------
def entropy_of(shares: list[Column]) -> Column:
    """-sum p ln p of shares that are scaled to 1; a share of 0 adds nothing."""
    total = sum(shares[1:], shares[0])
    parts = [F.when(s > 0, -F.try_divide(s, total) * F.ln(F.try_divide(s, total))).otherwise(F.when(s.isNotNull(), 0.0)) for s in shares]
    return sum(parts[1:], parts[0])


def euclidean(parts: list[Column]) -> Column:
    """The length of a vector; NULL if a part is."""
    squares = [p * p for p in parts]
    return F.sqrt(sum(squares[1:], squares[0]))
