"""Published daily formulas as stages of SQL expressions over bars. A windowed term becomes a column of the stage after those it
reads, so formulas that share a term share its column."""

from __future__ import annotations

from collections.abc import Callable

from ledgerline.functions.exprs import block, div, frame, lag, mean_rank, roll, stride

#: Of a phase, at most.
STEPS = 64


class Term:
    """An expression, and the number of stages it needs before it."""

    def __init__(self, sql: str, level: int = 0) -> None:
        self.sql, self.level = sql, level

    def _with(self, form: str, other: Term | float) -> Term:
        o = other if isinstance(other, Term) else Term(f"{float(other)!r}D")
        return Term("(" + form.format(self.sql, o.sql) + ")", max(self.level, o.level))

    def __add__(self, o): return self._with("{0} + {1}", o)
    def __radd__(self, o): return self._with("{1} + {0}", o)
    def __sub__(self, o): return self._with("{0} - {1}", o)
    def __rsub__(self, o): return self._with("{1} - {0}", o)
    def __mul__(self, o): return self._with("{0} * {1}", o)
    def __rmul__(self, o): return self._with("{1} * {0}", o)
    def __truediv__(self, o): return self._with("{0} / nullif({1}, 0)", o)
    def __rtruediv__(self, o): return self._with("{1} / nullif({0}, 0)", o)
    def __pow__(self, o): return self._with("pow({0}, {1})", o)
    def __lt__(self, o): return self._with("{0} < {1}", o)
    def __le__(self, o): return self._with("{0} <= {1}", o)
    def __ge__(self, o): return self._with("{0} >= {1}", o)
    def __neg__(self): return Term(f"(-{self.sql})", self.level)

    def applied(self, name: str) -> Term:
        return Term(f"{name}({self.sql})", self.level)

    def picked(self, yes: Term | float, no: Term | float) -> Term:
        a, b = (t if isinstance(t, Term) else Term(f"{float(t)!r}D") for t in (yes, no))
        return Term(f"case when {self.sql} then {a.sql} when not {self.sql} then {b.sql} end", max(self.level, a.level, b.level))

    def powered(self, y: Term) -> Term:
        return Term(f"case when abs({y.sql} * ln({self.sql})) <= 20 then pow({self.sql}, {y.sql}) end", max(self.level, y.level))


def fn(name: str, x: Term) -> Term:
    return x.applied(name)


def pick(test: Term, yes: Term | float, no: Term | float) -> Term:
    """NULL where the test is."""
    return test.picked(yes, no)


class Sheet:
    """The columns of a set of formulas. Windows over rows of a code are NULL before they are full; ranks lie in (0, 1], ties
    share their mean, and values are compared to nine decimals.

    phased: for Spark. Stages alternate between phases that need rows by code (the even ones) and by date, and a column goes into the first that it can, so
    rows change places once a phase; without it, stages are as few as can be, in standard SQL."""

    def __init__(self, phased: bool = False) -> None:
        self.phased = phased
        self.columns: dict[int, dict[str, str]] = {}
        self.known: dict[str, Term] = {}
        self.open, self.high, self.low, self.close, self.volume = (Term(c) for c in ("open", "high", "low", "close", "volume"))
        self.vwap = self.kept(Term(div("amount", "volume")))
        self.cap = self.kept(Term("sum(amount) over (partition by code order by date rows between unbounded preceding and current row)"))
        self.returns = self.kept(self.close / self.delay(self.close, 1) - 1)
        self.mid = (self.high + self.low) / 2
        self.amount = Term("amount")
        self.adv20 = self.adv(20)

    def kept(self, x: Term) -> Term:
        """As a column."""
        if x.sql.isidentifier():
            return x
        if x.sql not in self.known:
            at, name = x.level, f"t{len(self.known)}"
            if self.phased and " over (" in x.sql and at // STEPS % 2 != ("partition by date" in x.sql):
                at = (at // STEPS + 1) * STEPS
            self.columns.setdefault(at, {})[name] = x.sql
            self.known[x.sql] = Term(name, at + 1)
        return self.known[x.sql]

    @property
    def stages(self) -> list[dict[str, str]]:
        return [self.columns[k] for k in sorted(self.columns)]

    def window(self, x: Term, form: Callable[[str], str]) -> Term:
        x = self.kept(x)
        return self.kept(Term(form(x.sql), x.level))

    def delay(self, x: Term, n: int) -> Term:
        return self.window(x, lambda c: lag(c, n))

    def delta(self, x: Term, n: int) -> Term:
        return x - self.delay(x, n)

    def roll(self, f: str, x: Term, n: int) -> Term:
        m = block(n) if self.phased and f in ("sum", "avg", "min", "max") else None
        if not m:
            return self.window(x, lambda c: roll(f, c, n, n))
        return self.blocks(lambda c, w: f"{f}({c[0]}) {w}", [self.roll(f, x, m)], n, m)

    def blocks(self, form: Callable[[list[str], str], str], of: list[Term], n: int, m: int) -> Term:
        """From columns over the last m rows, over the blocks of the last n; NULL where the first column of one of them is."""
        at = self.kept(Term("row_number() over (partition by code order by date)"))
        w = stride(n, m, at.sql)
        return self.kept(Term(f"case when count({of[0].sql}) {w} = {n // m} then {form([t.sql for t in of], w)} end", max(at.level, *(t.level for t in of))))

    def sum(self, x: Term, n: int) -> Term:
        return self.roll("sum", x, n)

    def mean(self, x: Term, n: int) -> Term:
        return self.roll("avg", x, n)

    def adv(self, n: int) -> Term:
        """Mean traded amount, not number of shares, of n rows."""
        return self.mean(self.amount, n)

    def std(self, x: Term, n: int) -> Term:
        return self.roll("stddev_samp", x, n)

    def low_of(self, x: Term, n: int) -> Term:
        return self.roll("min", x, n)

    def high_of(self, x: Term, n: int) -> Term:
        return self.roll("max", x, n)

    def lags(self, x: Term, n: int, form: Callable[[list[str]], str], after: Term | None = None) -> Term:
        """Over the columns of the n rows up to this one, the newest first; NULL where one is."""
        full = lambda c: f"case when count({c}) {frame(n)} = {n} then {form([c, *(lag(c, k) for k in range(1, n))])} end"
        x = self.kept(x)
        return self.kept(Term(full(x.sql), max(x.level, after.level if after else 0)))

    def ts_rank(self, x: Term, n: int) -> Term:
        """The share of the n rows that don't exceed this one."""
        return self.lags(x, n, lambda c: f"({' + '.join(f'case when {k} <= {c[0]} then 1 else 0 end' for k in c)}) / {n}.0D")

    def _place(self, f: str, x: Term, n: int) -> Term:
        """1 to n from the oldest row; the newest of equals."""
        best = self.roll(f, x, n) if self.phased else None  # once, not for each row of the window
        return self.lags(x, n, lambda c: f"case {' '.join(f'when {k} = {best.sql if best else f"{f}({c[0]}) {frame(n)}"} then {n - i}.0D' for i, k in enumerate(c))} end", best)

    def ts_argmax(self, x: Term, n: int) -> Term:
        return self._place("max", x, n)

    def ts_argmin(self, x: Term, n: int) -> Term:
        return self._place("min", x, n)

    def product(self, x: Term, n: int) -> Term:
        return self.lags(x, n, lambda c: " * ".join(c))

    def decay(self, x: Term, n: int) -> Term:
        """Weights n to 1 from this row back."""
        return self.lags(x, n, lambda c: f"({' + '.join(f'{n - i} * {k}' for i, k in enumerate(c))}) / {n * (n + 1) / 2}D")

    def _pair(self, x: Term, y: Term, n: int, form: str) -> Term:
        x, y = self.kept(x), self.kept(y)
        both = f"count(case when {x.sql} is not null and {y.sql} is not null then 1 end) {frame(n)}"
        return self.kept(Term(f"case when {both} = {n} then {form.format(x=x.sql, y=y.sql, f=frame(n))} end", max(x.level, y.level)))

    def corr(self, x: Term, y: Term, n: int) -> Term:
        """Pearson's to twelve decimals; NULL where a side is constant. Of two rows it is 1 or -1, whatever the last bits of their sums say; they move if they
        differ by more than nine decimals and twelve digits, as sums of the same values added in another order don't."""
        if n == 2:
            moves = " and ".join("max({0}) {{f}} - min({0}) {{f}} > 0.000000001D + 0.000000000001D * abs(max({0}) {{f}})".format(c) for c in ("{x}", "{y}"))
            return self._pair(x, y, n, f"case when {moves} then cast(sign(covar_samp({{x}}, {{y}}) {{f}}) as double) end")
        if self.phased and (m := block(n)):
            return self._long_corr(x, y, n, m)
        form = "round(covar_samp({x}, {y}) {f} / nullif(stddev_samp({x}) {f} * stddev_samp({y}) {f}, 0), 12)"
        if self.phased:  # Spark goes through a window's rows one by one, so that the deviation of equal values is 0
            return self._pair(x, y, n, form)
        return self._pair(x, y, n, "case when min({x}) {f} < max({x}) {f} and min({y}) {f} < max({y}) {f} then " + form + " end")

    def _long_corr(self, x: Term, y: Term, n: int, m: int) -> Term:
        """From blocks of m rows: what lies within them in the mean, and between their means."""
        mean_x, mean_y, cov, var_x, var_y = (self._pair(x, y, m, f) for f in ("avg({x}) {f}", "avg({y}) {f}", "covar_pop({x}, {y}) {f}", "var_pop({x}) {f}", "var_pop({y}) {f}"))
        both = self.blocks(lambda c, w: f"avg({c[0]}) {w} + covar_pop({c[1]}, {c[2]}) {w}", [cov, mean_x, mean_y], n, m)
        of_x, of_y = (self.blocks(lambda c, w: f"avg({c[0]}) {w} + var_pop({c[1]}) {w}", [v, mean], n, m) for v, mean in ((var_x, mean_x), (var_y, mean_y)))
        return self.kept(Term(f"round({both.sql} / nullif(sqrt({of_x.sql}) * sqrt({of_y.sql}), 0), 12)", max(both.level, of_x.level, of_y.level)))

    def cov(self, x: Term, y: Term, n: int) -> Term:
        return self._pair(x, y, n, "covar_samp({x}, {y}) {f}")

    def rank(self, x: Term) -> Term:
        def form(c: str) -> str:
            if self.phased:
                rank, n = mean_rank(c)
                return f"case when {c} is not null then {rank} / {n} end"
            some = f"case when {c} is null then 1 else 0 end"
            return f"case when {c} is not null then (rank() over (partition by date, {some} order by {c}) + (count(*) over (partition by date, {c}) - 1) / 2.0D) / count({c}) over (partition by date) end"

        return self.window(Term(f"round({x.sql}, 9) + 0.0D", x.level), form)

    def scale(self, x: Term) -> Term:
        return self.window(x, lambda c: div(c, f"sum(abs({c})) over (partition by date)"))

    def neutral(self, x: Term, group: str) -> Term:
        return self.window(x, lambda c: f"{c} - avg({c}) over (partition by date, {group})")


#: Stand in for industry codes of three nested levels, which bars lack.
SECTOR, INDUSTRY, SUBINDUSTRY = "code % 5", "code % 10", "code % 20"


def mix(x: Term, y: Term, share: float) -> Term:
    return x * share + y * (1 - share)


def larger(x: Term, y: Term) -> Term:
    """NULL where either is."""
    return pick(x < y, y, x)


def smaller(x: Term, y: Term) -> Term:
    """NULL where either is."""
    return pick(x < y, x, y)


def flag(test: Term) -> Term:
    return pick(test, 1, 0)


def powered(x: Term, y: Term) -> Term:
    """x to the power of y for positive x; NULL where the result's logarithm is over 20, as price changes as exponents go beyond
    any double."""
    return x.powered(y)


def _slope(s: Sheet) -> Term:
    """The ten-row slope before the last ten rows less that of the last ten."""
    return (s.delay(s.close, 20) - s.delay(s.close, 10)) / 10 - (s.delay(s.close, 10) - s.close) / 10


def _turn(s: Sheet, n: int) -> Term:
    """The day's change while the changes of n days have one sign, else its opposite."""
    d = s.delta(s.close, 1)
    return pick(0 * d < s.low_of(d, n), d, pick(s.high_of(d, n) < 0, d, -d))


#: The published formulas by number; windows that aren't whole are cut to whole rows.
FORMULAS: dict[int, Callable[[Sheet], Term]] = {
    1: lambda s: s.rank(s.ts_argmax(pick(s.returns < 0, s.std(s.returns, 20), s.close) ** 2, 5)) - 0.5,
    2: lambda s: -s.corr(s.rank(s.delta(fn("ln", s.volume), 2)), s.rank((s.close - s.open) / s.open), 6),
    3: lambda s: -s.corr(s.rank(s.open), s.rank(s.volume), 10),
    4: lambda s: -s.ts_rank(s.rank(s.low), 9),
    5: lambda s: s.rank(s.open - s.sum(s.vwap, 10) / 10) * -fn("abs", s.rank(s.close - s.vwap)),
    6: lambda s: -s.corr(s.open, s.volume, 10),
    7: lambda s: pick(s.adv20 < s.volume, -s.ts_rank(fn("abs", s.delta(s.close, 7)), 60) * fn("sign", s.delta(s.close, 7)), -1),
    8: lambda s: -s.rank(s.delta(s.sum(s.open, 5) * s.sum(s.returns, 5), 10)),
    9: lambda s: _turn(s, 5),
    10: lambda s: s.rank(_turn(s, 4)),
    11: lambda s: (s.rank(s.high_of(s.vwap - s.close, 3)) + s.rank(s.low_of(s.vwap - s.close, 3))) * s.rank(s.delta(s.volume, 3)),
    12: lambda s: fn("sign", s.delta(s.volume, 1)) * -s.delta(s.close, 1),
    13: lambda s: -s.rank(s.cov(s.rank(s.close), s.rank(s.volume), 5)),
    14: lambda s: -s.rank(s.delta(s.returns, 3)) * s.corr(s.open, s.volume, 10),
    15: lambda s: -s.sum(s.rank(s.corr(s.rank(s.high), s.rank(s.volume), 3)), 3),
    16: lambda s: -s.rank(s.cov(s.rank(s.high), s.rank(s.volume), 5)),
    17: lambda s: -s.rank(s.ts_rank(s.close, 10)) * s.rank(s.delta(s.delta(s.close, 1), 1)) * s.rank(s.ts_rank(s.volume / s.adv20, 5)),
    18: lambda s: -s.rank(s.std(fn("abs", s.close - s.open), 5) + (s.close - s.open) + s.corr(s.close, s.open, 10)),
    19: lambda s: -fn("sign", (s.close - s.delay(s.close, 7)) + s.delta(s.close, 7)) * (1 + s.rank(1 + s.sum(s.returns, 250))),
    20: lambda s: -s.rank(s.open - s.delay(s.high, 1)) * s.rank(s.open - s.delay(s.close, 1)) * s.rank(s.open - s.delay(s.low, 1)),
    21: lambda s: pick(s.mean(s.close, 8) + s.std(s.close, 8) < s.mean(s.close, 2), -1, pick(s.mean(s.close, 2) < s.mean(s.close, 8) - s.std(s.close, 8), 1, pick(s.volume / s.adv20 >= 1, 1, -1))),
    22: lambda s: -(s.delta(s.corr(s.high, s.volume, 5), 5) * s.rank(s.std(s.close, 20))),
    23: lambda s: pick(s.mean(s.high, 20) < s.high, -s.delta(s.high, 2), 0),
    24: lambda s: pick(s.delta(s.mean(s.close, 100), 100) / s.delay(s.close, 100) <= 0.05, -(s.close - s.low_of(s.close, 100)), -s.delta(s.close, 3)),
    25: lambda s: s.rank(-s.returns * s.adv20 * s.vwap * (s.high - s.close)),
    26: lambda s: -s.high_of(s.corr(s.ts_rank(s.volume, 5), s.ts_rank(s.high, 5), 5), 3),
    27: lambda s: pick(s.rank(s.sum(s.corr(s.rank(s.volume), s.rank(s.vwap), 6), 2) / 2) <= 0.5, 1, -1),
    28: lambda s: s.scale(s.corr(s.adv20, s.low, 5) + (s.high + s.low) / 2 - s.close),
    29: lambda s: s.low_of(s.rank(s.rank(s.scale(fn("ln", s.low_of(s.rank(s.rank(-s.rank(s.delta(s.close - 1, 5)))), 2))))), 5) + s.ts_rank(s.delay(-s.returns, 6), 5),
    30: lambda s: (1 - s.rank(fn("sign", s.delta(s.close, 1)) + fn("sign", s.delay(s.delta(s.close, 1), 1)) + fn("sign", s.delay(s.delta(s.close, 1), 2)))) * s.sum(s.volume, 5) / s.sum(s.volume, 20),
    31: lambda s: s.rank(s.rank(s.rank(s.decay(-s.rank(s.rank(s.delta(s.close, 10))), 10)))) + s.rank(-s.delta(s.close, 3)) + fn("sign", s.scale(s.corr(s.adv20, s.low, 12))),
    32: lambda s: s.scale(s.mean(s.close, 7) - s.close) + 20 * s.scale(s.corr(s.vwap, s.delay(s.close, 5), 230)),
    33: lambda s: s.rank(-(1 - s.open / s.close)),
    34: lambda s: s.rank(1 - s.rank(s.std(s.returns, 2) / s.std(s.returns, 5)) + (1 - s.rank(s.delta(s.close, 1)))),
    35: lambda s: s.ts_rank(s.volume, 32) * (1 - s.ts_rank(s.close + s.high - s.low, 16)) * (1 - s.ts_rank(s.returns, 32)),
    36: lambda s: 2.21 * s.rank(s.corr(s.close - s.open, s.delay(s.volume, 1), 15)) + 0.7 * s.rank(s.open - s.close) + 0.73 * s.rank(s.ts_rank(s.delay(-s.returns, 6), 5)) + s.rank(fn("abs", s.corr(s.vwap, s.adv20, 6))) + 0.6 * s.rank((s.mean(s.close, 200) - s.open) * (s.close - s.open)),
    37: lambda s: s.rank(s.corr(s.delay(s.open - s.close, 1), s.close, 200)) + s.rank(s.open - s.close),
    38: lambda s: -s.rank(s.ts_rank(s.close, 10)) * s.rank(s.close / s.open),
    39: lambda s: -s.rank(s.delta(s.close, 7) * (1 - s.rank(s.decay(s.volume / s.adv20, 9)))) * (1 + s.rank(s.sum(s.returns, 250))),
    40: lambda s: -s.rank(s.std(s.high, 10)) * s.corr(s.high, s.volume, 10),
    41: lambda s: (s.high * s.low) ** 0.5 - s.vwap,
    42: lambda s: s.rank(s.vwap - s.close) / s.rank(s.vwap + s.close),
    43: lambda s: s.ts_rank(s.volume / s.adv20, 20) * s.ts_rank(-s.delta(s.close, 7), 8),
    44: lambda s: -s.corr(s.high, s.rank(s.volume), 5),
    45: lambda s: -(s.rank(s.mean(s.delay(s.close, 5), 20)) * s.corr(s.close, s.volume, 2) * s.rank(s.corr(s.sum(s.close, 5), s.sum(s.close, 20), 2))),
    46: lambda s: pick(0.25 + 0 * s.close < _slope(s), -1, pick(_slope(s) < 0, 1, -s.delta(s.close, 1))),
    47: lambda s: s.rank(1 / s.close) * s.volume / s.adv20 * (s.high * s.rank(s.high - s.close) / s.mean(s.high, 5)) - s.rank(s.delta(s.vwap, 5)),
    48: lambda s: s.neutral(s.corr(s.delta(s.close, 1), s.delta(s.delay(s.close, 1), 1), 250) * s.delta(s.close, 1) / s.close, SUBINDUSTRY) / s.sum((s.delta(s.close, 1) / s.delay(s.close, 1)) ** 2, 250),
    49: lambda s: pick(_slope(s) < -0.1, 1, -s.delta(s.close, 1)),
    50: lambda s: -s.high_of(s.rank(s.corr(s.rank(s.volume), s.rank(s.vwap), 5)), 5),
    51: lambda s: pick(_slope(s) < -0.05, 1, -s.delta(s.close, 1)),
    52: lambda s: -s.delta(s.low_of(s.low, 5), 5) * s.rank((s.sum(s.returns, 240) - s.sum(s.returns, 20)) / 220) * s.ts_rank(s.volume, 5),
    53: lambda s: -s.delta(((s.close - s.low) - (s.high - s.close)) / (s.close - s.low), 9),
    54: lambda s: -((s.low - s.close) * s.open**5) / ((s.low - s.high) * s.close**5),
    55: lambda s: -s.corr(s.rank((s.close - s.low_of(s.low, 12)) / (s.high_of(s.high, 12) - s.low_of(s.low, 12))), s.rank(s.volume), 6),
    56: lambda s: -(s.rank(s.sum(s.returns, 10) / s.sum(s.sum(s.returns, 2), 3)) * s.rank(s.returns * s.cap)),
    57: lambda s: -((s.close - s.vwap) / s.decay(s.rank(s.ts_argmax(s.close, 30)), 2)),
    58: lambda s: -s.ts_rank(s.decay(s.corr(s.neutral(s.vwap, SECTOR), s.volume, 3), 7), 5),
    59: lambda s: -s.ts_rank(s.decay(s.corr(s.neutral(mix(s.vwap, s.vwap, 0.728317), INDUSTRY), s.volume, 4), 16), 8),
    60: lambda s: -(2 * s.scale(s.rank(((s.close - s.low) - (s.high - s.close)) / (s.high - s.low) * s.volume)) - s.scale(s.rank(s.ts_argmax(s.close, 10)))),
    61: lambda s: flag(s.rank(s.vwap - s.low_of(s.vwap, 16)) < s.rank(s.corr(s.vwap, s.adv(180), 17))),
    62: lambda s: -flag(s.rank(s.corr(s.vwap, s.sum(s.adv20, 22), 9)) < s.rank(flag(s.rank(s.open) + s.rank(s.open) < s.rank(s.mid) + s.rank(s.high)))),
    63: lambda s: -(s.rank(s.decay(s.delta(s.neutral(s.close, INDUSTRY), 2), 8)) - s.rank(s.decay(s.corr(mix(s.vwap, s.open, 0.318108), s.sum(s.adv(180), 37), 13), 12))),
    64: lambda s: -flag(s.rank(s.corr(s.sum(mix(s.open, s.low, 0.178404), 12), s.sum(s.adv(120), 12), 16)) < s.rank(s.delta(mix(s.mid, s.vwap, 0.178404), 3))),
    65: lambda s: -flag(s.rank(s.corr(mix(s.open, s.vwap, 0.00817205), s.sum(s.adv(60), 8), 6)) < s.rank(s.open - s.low_of(s.open, 13))),
    66: lambda s: -(s.rank(s.decay(s.delta(s.vwap, 3), 7)) + s.ts_rank(s.decay((mix(s.low, s.low, 0.96633) - s.vwap) / (s.open - s.mid), 11), 6)),
    67: lambda s: -(s.rank(s.high - s.low_of(s.high, 2)) ** s.rank(s.corr(s.neutral(s.vwap, SECTOR), s.neutral(s.adv20, SUBINDUSTRY), 6))),
    68: lambda s: -flag(s.ts_rank(s.corr(s.rank(s.high), s.rank(s.adv(15)), 8), 13) < s.rank(s.delta(mix(s.close, s.low, 0.518371), 1))),
    69: lambda s: -(s.rank(s.high_of(s.delta(s.neutral(s.vwap, INDUSTRY), 2), 4)) ** s.ts_rank(s.corr(mix(s.close, s.vwap, 0.490655), s.adv20, 4), 9)),
    70: lambda s: -(s.rank(s.delta(s.vwap, 1)) ** s.ts_rank(s.corr(s.neutral(s.close, INDUSTRY), s.adv(50), 17), 17)),
    71: lambda s: larger(s.ts_rank(s.decay(s.corr(s.ts_rank(s.close, 3), s.ts_rank(s.adv(180), 12), 18), 4), 15), s.ts_rank(s.decay(s.rank((s.low + s.open) - (s.vwap + s.vwap)) ** 2, 16), 4)),
    72: lambda s: s.rank(s.decay(s.corr(s.mid, s.adv(40), 8), 10)) / s.rank(s.decay(s.corr(s.ts_rank(s.vwap, 3), s.ts_rank(s.volume, 18), 6), 2)),
    73: lambda s: -larger(s.rank(s.decay(s.delta(s.vwap, 4), 2)), s.ts_rank(s.decay(-(s.delta(mix(s.open, s.low, 0.147155), 2) / mix(s.open, s.low, 0.147155)), 3), 16)),
    74: lambda s: -flag(s.rank(s.corr(s.close, s.sum(s.adv(30), 37), 15)) < s.rank(s.corr(s.rank(mix(s.high, s.vwap, 0.0261661)), s.rank(s.volume), 11))),
    75: lambda s: flag(s.rank(s.corr(s.vwap, s.volume, 4)) < s.rank(s.corr(s.rank(s.low), s.rank(s.adv(50)), 12))),
    76: lambda s: -larger(s.rank(s.decay(s.delta(s.vwap, 1), 11)), s.ts_rank(s.decay(s.ts_rank(s.corr(s.neutral(s.low, SECTOR), s.adv(81), 8), 19), 17), 19)),
    77: lambda s: smaller(s.rank(s.decay((s.mid + s.high) - (s.vwap + s.high), 20)), s.rank(s.decay(s.corr(s.mid, s.adv(40), 3), 5))),
    78: lambda s: s.rank(s.decay(s.corr(s.vwap, s.sum(s.adv(5), 26), 4), 7)) ** s.rank(s.corr(s.rank(s.vwap), s.rank(s.volume), 5)),
    79: lambda s: flag(s.rank(s.delta(s.neutral(mix(s.close, s.open, 0.60733), SECTOR), 1)) < s.rank(s.corr(s.ts_rank(s.vwap, 3), s.ts_rank(s.adv(150), 9), 14))),
    80: lambda s: -(s.rank(fn("sign", s.delta(s.neutral(mix(s.open, s.high, 0.868128), INDUSTRY), 4))) ** s.ts_rank(s.corr(s.high, s.adv(10), 5), 5)),
    81: lambda s: -flag(s.rank(fn("ln", s.product(s.rank(s.rank(s.corr(s.vwap, s.sum(s.adv(10), 49), 8)) ** 4), 14))) < s.rank(s.corr(s.rank(s.vwap), s.rank(s.volume), 5))),
    82: lambda s: -smaller(s.rank(s.decay(s.delta(s.open, 1), 14)), s.ts_rank(s.decay(s.corr(s.neutral(s.volume, SECTOR), mix(s.open, s.open, 0.634196), 17), 6), 13)),
    83: lambda s: s.rank(s.delay((s.high - s.low) / (s.sum(s.close, 5) / 5), 2)) * s.rank(s.rank(s.volume)) / ((s.high - s.low) / (s.sum(s.close, 5) / 5) / (s.vwap - s.close)),
    84: lambda s: powered(s.ts_rank(s.vwap - s.high_of(s.vwap, 15), 20), s.delta(s.close, 4)),
    85: lambda s: s.rank(s.corr(mix(s.high, s.close, 0.876703), s.adv(30), 9)) ** s.rank(s.corr(s.ts_rank(s.mid, 3), s.ts_rank(s.volume, 10), 7)),
    86: lambda s: -flag(s.ts_rank(s.corr(s.close, s.sum(s.adv20, 14), 6), 20) < s.rank((s.open + s.close) - (s.vwap + s.open))),
    87: lambda s: -larger(s.rank(s.decay(s.delta(mix(s.close, s.vwap, 0.369701), 1), 2)), s.ts_rank(s.decay(fn("abs", s.corr(s.neutral(s.adv(81), INDUSTRY), s.close, 13)), 4), 14)),
    88: lambda s: smaller(s.rank(s.decay((s.rank(s.open) + s.rank(s.low)) - (s.rank(s.high) + s.rank(s.close)), 8)), s.ts_rank(s.decay(s.corr(s.ts_rank(s.close, 8), s.ts_rank(s.adv(60), 20), 8), 6), 2)),
    89: lambda s: s.ts_rank(s.decay(s.corr(mix(s.low, s.low, 0.967285), s.adv(10), 6), 5), 3) - s.ts_rank(s.decay(s.delta(s.neutral(s.vwap, INDUSTRY), 3), 10), 15),
    90: lambda s: -(s.rank(s.close - s.high_of(s.close, 4)) ** s.ts_rank(s.corr(s.neutral(s.adv(40), SUBINDUSTRY), s.low, 5), 3)),
    91: lambda s: -(s.ts_rank(s.decay(s.decay(s.corr(s.neutral(s.close, INDUSTRY), s.volume, 9), 16), 3), 4) - s.rank(s.decay(s.corr(s.vwap, s.adv(30), 4), 2))),
    92: lambda s: smaller(s.ts_rank(s.decay(flag(s.mid + s.close < s.low + s.open), 14), 18), s.ts_rank(s.decay(s.corr(s.rank(s.low), s.rank(s.adv(30)), 7), 6), 6)),
    93: lambda s: s.ts_rank(s.decay(s.corr(s.neutral(s.vwap, INDUSTRY), s.adv(81), 17), 19), 7) / s.rank(s.decay(s.delta(mix(s.close, s.vwap, 0.524434), 2), 16)),
    94: lambda s: -(s.rank(s.vwap - s.low_of(s.vwap, 11)) ** s.ts_rank(s.corr(s.ts_rank(s.vwap, 19), s.ts_rank(s.adv(60), 4), 18), 2)),
    95: lambda s: flag(s.rank(s.open - s.low_of(s.open, 12)) < s.ts_rank(s.rank(s.corr(s.sum(s.mid, 19), s.sum(s.adv(40), 19), 12)) ** 5, 11)),
    96: lambda s: -larger(s.ts_rank(s.decay(s.corr(s.rank(s.vwap), s.rank(s.volume), 3), 4), 8), s.ts_rank(s.decay(s.ts_argmax(s.corr(s.ts_rank(s.close, 7), s.ts_rank(s.adv(60), 4), 3), 12), 14), 13)),
    97: lambda s: -(s.rank(s.decay(s.delta(s.neutral(mix(s.low, s.vwap, 0.721001), INDUSTRY), 3), 20)) - s.ts_rank(s.decay(s.ts_rank(s.corr(s.ts_rank(s.low, 7), s.ts_rank(s.adv(60), 17), 4), 18), 15), 6)),
    98: lambda s: s.rank(s.decay(s.corr(s.vwap, s.sum(s.adv(5), 26), 4), 7)) - s.rank(s.decay(s.ts_rank(s.ts_argmin(s.corr(s.rank(s.open), s.rank(s.adv(15)), 20), 8), 6), 8)),
    99: lambda s: -flag(s.rank(s.corr(s.sum(s.mid, 19), s.sum(s.adv(60), 19), 8)) < s.rank(s.corr(s.low, s.volume, 6))),
    100: lambda s: -((1.5 * s.scale(s.neutral(s.neutral(s.rank(((s.close - s.low) - (s.high - s.close)) / (s.high - s.low) * s.volume), SUBINDUSTRY), SUBINDUSTRY)) - s.scale(s.neutral(s.corr(s.close, s.rank(s.adv20), 5) - s.rank(s.ts_argmin(s.close, 30)), SUBINDUSTRY))) * (s.volume / s.adv20)),
    101: lambda s: (s.close - s.open) / (s.high - s.low + 0.001),
}


def stages_of(numbers: list[int], phased: bool = True) -> tuple[list[dict[str, str]], list[str]]:
    """The stages of some formulas, and the names of their columns."""
    s, last = Sheet(phased), {}
    done = {f"alpha_{n:03d}": FORMULAS[n](s) for n in numbers}
    last = {name: t.sql for name, t in done.items()}
    return [*s.stages, last], list(last)
