"""Formulas over bars by numpy inside tasks: a graph of steps over whole columns, of which Spark deals the rows.

Steps over the rows of a code and steps over those of a date take turns, one shuffle each. A task gets its rows sorted and works on whole codes or
dates, CHUNK rows or one code or date at a time. What goes from a phase to the next is the least that the rest can be made from: a column is
sent, or made again from what is sent, bars for instance, whichever set weighs less (a smallest cut of the graph). A window of n rows costs n
additions of whole columns. Columns hold NaN for NULL, as in `codewise`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import dealt
from ledgerline.operators.alphas import FORMULAS, Sheet, Term

BARS = ("open", "high", "low", "close", "volume", "amount")
#: Rows that a task works on at once, unless a code or a date has more.
CHUNK = 32_768
#: Bytes that a value is taken for in a shuffle: of most bars all prices are one, and volumes are small whole numbers.
WEIGHT = {"open": 6, "high": 3, "low": 3, "close": 3, "volume": 3, "amount": 7}
OTHER = 8

Column = np.ndarray


class Rows:
    """The keys of some rows, sorted by one of them: code or date."""

    def __init__(self, code: pa.ChunkedArray, date: pa.ChunkedArray, by: str) -> None:
        self.code, self.no_code = filled(code)
        key, none = (self.code, self.no_code) if by == "code" else filled(date)
        new = np.ones(len(key), bool)
        new[1:] = changes(key, none)
        self.starts = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.at = np.arange(len(key)) - self.starts[self.group]

    def within(self, g: int) -> Column:
        """Numbers for the groups of a date and code % g, with g for those without a code."""
        rest = np.where(self.no_code, g, np.fmod(self.code, g))
        return self.group * (2 * g) + rest + g - 1


def filled(key: pa.ChunkedArray) -> tuple[Column, Column]:
    none = key.is_null().to_numpy().astype(bool)
    whole = key.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date32(key.type) else key
    return (whole.fill_null(0) if none.any() else whole).to_numpy(), none


def changes(key: Column, none: Column) -> Column:
    return (key[1:] != key[:-1]) | (none[1:] != none[:-1])


# -- steps over single rows ------------------------------------------------------------------------------------------------
def compared(f: np.ufunc, a: Column, b: Column) -> Column:
    return np.where(np.isnan(a) | np.isnan(b), np.nan, f(a, b))


def divided(a: Column, b: Column) -> Column:
    return a / np.where(b == 0, np.nan, b)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, by the same steps as DuckDB's round."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    out = (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 10.0**digits
    return np.where(np.isfinite(out), out, x) + 0.0


SINGLE: dict[str, Callable[..., Column]] = {
    "{0} + {1}": lambda a, b: a + b, "{1} + {0}": lambda a, b: b + a, "{0} - {1}": lambda a, b: a - b, "{1} - {0}": lambda a, b: b - a, "{0} * {1}": lambda a, b: a * b, "{1} * {0}": lambda a, b: b * a,
    "{0} / nullif({1}, 0)": divided, "{1} / nullif({0}, 0)": lambda a, b: divided(b, a), "pow({0}, {1})": lambda a, b: np.where(np.isnan(a) | np.isnan(b), np.nan, np.power(a, b)),
    "{0} < {1}": lambda a, b: compared(np.less, a, b), "{0} <= {1}": lambda a, b: compared(np.less_equal, a, b), "{0} >= {1}": lambda a, b: compared(np.greater_equal, a, b),
    "neg": np.negative, "abs": np.abs, "sign": np.sign, "floor": np.floor, "ln": lambda x: np.log(np.where(x > 0, x, np.nan)),
    "pick": lambda test, a, b: np.where(np.isnan(test), np.nan, np.where(test == 1, a, b)),
    "powered": lambda x, y: np.where(np.abs(y * SINGLE["ln"](x)) <= 20, np.power(x, y), np.nan),
}


# -- steps over the rows of a code -----------------------------------------------------------------------------------------
class Past:
    """A column's values k rows before each row; those of the first rows of a code are another code's."""

    def __init__(self, x: Column, n: int) -> None:
        self.n, self.size = n, len(x)
        self.padded = np.concatenate([np.full(n, np.nan), x])

    def __call__(self, k: int) -> Column:
        return self.padded[self.n - k : self.n - k + self.size]


def full(rows: Rows, n: int, *columns: Column) -> Column:
    """Where the last n rows are of one code and have a value in all columns."""
    i = np.arange(len(rows.at))
    none = np.logical_or.reduce([np.isnan(x) for x in columns])
    return (rows.at >= n - 1) & (i - np.maximum.accumulate(np.where(none, i, -n)) >= n)


def delayed(rows: Rows, x: Column, n: int) -> Column:
    return np.where(rows.at >= n, Past(x, n)(n), np.nan)


def folded(f: np.ufunc) -> Callable[..., Column]:
    """From the oldest row to the newest."""

    def run(rows: Rows, x: Column, n: int) -> Column:
        past = Past(x, n)
        out = past(n - 1).copy()
        for k in range(n - 2, -1, -1):
            f(out, past(k), out=out)
        return np.where(full(rows, n, x), out, np.nan)

    return run


def products(rows: Rows, x: Column, y: Column, n: int) -> Column:
    """The sum of the products of deviations. They are taken from the oldest row first, so that those of equal values are 0."""
    px, py = Past(x, n), Past(y, n)
    x0, y0 = px(n - 1), py(n - 1)
    mx, my = (sum((p(k) - o for k in range(n - 2, -1, -1)), np.zeros(len(x))) / n for p, o in ((px, x0), (py, y0)))
    out = np.zeros(len(x))
    for k in range(n - 1, -1, -1):
        out += (px(k) - x0 - mx) * (py(k) - y0 - my)
    return out


def deviation(rows: Rows, x: Column, n: int) -> Column:
    return np.where(full(rows, n, x), np.sqrt(products(rows, x, x, n) / (n - 1)), np.nan)


def covariance(rows: Rows, x: Column, y: Column, n: int) -> Column:
    return np.where(full(rows, n, x, y), products(rows, x, y, n) / (n - 1), np.nan)


def correlation(rows: Rows, x: Column, y: Column, n: int) -> Column:
    """As Sheet.corr has it."""
    if n == 2:
        signs = []
        for c in (x, y):
            before = Past(c, 1)(1)
            moves = np.abs(c - before) > 0.000000001 + 0.000000000001 * np.abs(np.maximum(c, before))
            signs.append(np.where(moves, np.sign(c - before), np.nan))
        return np.where(full(rows, 2, x, y), signs[0] * signs[1], np.nan)
    both = np.sqrt(products(rows, x, x, n) / (n - 1)) * np.sqrt(products(rows, y, y, n) / (n - 1))
    return rounded(np.where(full(rows, n, x, y), divided(products(rows, x, y, n) / (n - 1), both), np.nan), 12)


def share_below(rows: Rows, x: Column, n: int) -> Column:
    past = Past(x, n)
    return np.where(full(rows, n, x), sum((past(k) <= x for k in range(n)), np.zeros(len(x))) / n, np.nan)


def place(better: np.ufunc) -> Callable[..., Column]:
    """1 to n from the oldest row; the newest of equals."""

    def run(rows: Rows, x: Column, n: int) -> Column:
        past = Past(x, n)
        best, at = past(n - 1).copy(), np.ones(len(x))
        for k in range(n - 2, -1, -1):
            hit = better(past(k), best)
            best, at = np.where(hit, past(k), best), np.where(hit, float(n - k), at)
        return np.where(full(rows, n, x), at, np.nan)

    return run


def multiplied(rows: Rows, x: Column, n: int) -> Column:
    past = Past(x, n)
    out = x.copy()
    for k in range(1, n):
        out *= past(k)
    return np.where(full(rows, n, x), out, np.nan)


def decayed(rows: Rows, x: Column, n: int) -> Column:
    past = Past(x, n)
    out = n * x
    for k in range(1, n):
        out += (n - k) * past(k)
    return np.where(full(rows, n, x), out / (n * (n + 1) / 2), np.nan)


def running(rows: Rows, x: Column) -> Column:
    """The sum of a code's values so far."""
    known = ~np.isnan(x)
    out = np.where(known, x, 0.0)
    for lo, hi in zip(rows.starts, [*rows.starts[1:], len(x)], strict=True):
        np.cumsum(out[lo:hi], out=out[lo:hi])
    i = np.arange(len(x))
    return np.where(np.maximum.accumulate(np.where(known, i, -1)) >= i - rows.at, out, np.nan)


BY_CODE: dict[str, Callable[..., Column]] = {
    "delay": delayed, "sum": folded(np.add), "avg": lambda r, x, n: folded(np.add)(r, x, n) / n, "min": folded(np.minimum), "max": folded(np.maximum), "stddev_samp": deviation,
    "cov": covariance, "corr": correlation, "ts_rank": share_below, "argmax": place(np.greater_equal), "argmin": place(np.less_equal), "product": multiplied, "decay": decayed, "running": running,
}


# -- steps over the rows of a date -----------------------------------------------------------------------------------------
def ranked(rows: Rows, x: Column) -> Column:
    """In (0, 1]; ties to nine decimals share their mean."""
    v = rounded(x, 9)
    order = np.lexsort((v, rows.group))
    s, g = v[order], rows.group[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    ties = np.diff(np.append(first, len(s)))[run]
    rank = (first[run] - rows.starts[g] + 1) + (ties - 1) / 2.0
    out = np.empty(len(s))
    out[order] = rank
    return np.where(np.isnan(v), np.nan, divided(out, np.bincount(rows.group, ~np.isnan(v), len(rows.starts))[rows.group]))


def scaled(rows: Rows, x: Column) -> Column:
    return divided(x, np.bincount(rows.group, np.nan_to_num(np.abs(x), nan=0.0, posinf=np.inf), len(rows.starts))[rows.group])


def neutral(rows: Rows, x: Column, g: int) -> Column:
    at, known = rows.within(g), ~np.isnan(x)
    return x - divided(np.bincount(at, np.where(known, x, 0.0)), np.bincount(at, known))[at]


BY_DATE: dict[str, Callable[..., Column]] = {"rank": ranked, "scale": scaled, "neutral": neutral}


# -- the graph -------------------------------------------------------------------------------------------------------------
class Node(Term):
    """A step, its columns, its fixed values, and the first phase that can do it: even ones have rows by code, odd ones by date."""

    def __init__(self, grid: Grid, op: str, args: tuple[Node, ...] = (), how: tuple = ()) -> None:
        self.grid, self.op, self.args, self.how = grid, op, args, how
        first = max((a.level for a in args), default=0)
        wrong = op in BY_CODE and first % 2 == 1 or op in BY_DATE and first % 2 == 0
        super().__init__(f"n{len(grid.nodes)}", first + wrong)

    def of(self, o: Term | float) -> Node:
        return o if isinstance(o, Node) else self.grid.node("fixed", (), float(o))

    def _with(self, form: str, other: Term | float) -> Node:
        return self.grid.node(form, (self, self.of(other)))

    def __neg__(self): return self.grid.node("neg", (self,))

    def applied(self, name: str) -> Node:
        return self.grid.node(name, (self,))

    def picked(self, yes: Term | float, no: Term | float) -> Node:
        return self.grid.node("pick", (self, self.of(yes), self.of(no)))

    def powered(self, y: Term) -> Node:
        return self.grid.node("powered", (self, y))

    def made_in(self, phase: int) -> bool:
        """Whether it can be made there from its columns."""
        return self.op in SINGLE or self.op in (BY_DATE if phase % 2 else BY_CODE)


class Grid(Sheet):
    """The steps of a set of formulas; each step is there once."""

    def __init__(self) -> None:
        self.nodes: dict[tuple, Node] = {}
        self.open, self.high, self.low, self.close, self.volume, self.amount = (self.node(c) for c in BARS)
        self.vwap = self.amount / self.volume
        self.cap = self.node("running", (self.amount,))
        self.returns = self.close / self.delay(self.close, 1) - 1
        self.mid = (self.high + self.low) / 2
        self.adv20 = self.adv(20)

    def node(self, op: str, args: tuple[Node, ...] = (), *how: float) -> Node:
        key = (op, tuple(a.sql for a in args), how)
        if key not in self.nodes:
            self.nodes[key] = Node(self, op, args, how)
        return self.nodes[key]

    def delay(self, x: Node, n: int) -> Node:
        return self.node("delay", (x,), n)

    def roll(self, f: str, x: Node, n: int) -> Node:
        return self.node(f, (x,), n)

    def ts_rank(self, x: Node, n: int) -> Node:
        return self.node("ts_rank", (x,), n)

    def _place(self, f: str, x: Node, n: int) -> Node:
        return self.node(f"arg{f}", (x,), n)

    def product(self, x: Node, n: int) -> Node:
        return self.node("product", (x,), n)

    def decay(self, x: Node, n: int) -> Node:
        return self.node("decay", (x,), n)

    def corr(self, x: Node, y: Node, n: int) -> Node:
        return self.node("corr", (x, y), n)

    def cov(self, x: Node, y: Node, n: int) -> Node:
        return self.node("cov", (x, y), n)

    def rank(self, x: Node) -> Node:
        return self.node("rank", (x,))

    def scale(self, x: Node) -> Node:
        return self.node("scale", (x,))

    def neutral(self, x: Node, group: str) -> Node:
        return self.node("neutral", (x,), int(group.removeprefix("code % ")))


def sent(wanted: list[Node], phase: int) -> list[Node]:
    """The lightest columns of earlier phases that the wanted ones can be made from in a phase: a smallest cut between them and the bars, by paths that
    still have room."""
    room: dict[tuple, dict[tuple, float]] = {}

    def edge(a: tuple, b: tuple, weight: float) -> None:
        room.setdefault(a, {})[b] = weight
        room.setdefault(b, {}).setdefault(a, 0)

    seen, todo = set(), list(wanted)
    for w in wanted:
        edge(("from",), (w.sql, "in"), np.inf)
    met: dict[str, Node] = {}
    while todo:
        x = todo.pop()
        if x.sql in seen or x.op == "fixed":
            continue
        seen.add(x.sql)
        met[x.sql] = x
        edge((x.sql, "in"), (x.sql, "out"), WEIGHT.get(x.op, OTHER) if x.level < phase else np.inf)
        if x.op in BARS or not x.made_in(phase):
            edge((x.sql, "out"), ("to",), np.inf)
            continue
        for a in x.args:
            if a.op != "fixed":
                edge((x.sql, "out"), (a.sql, "in"), np.inf)
                todo.append(a)

    def reached() -> dict[tuple, tuple | None]:
        came: dict[tuple, tuple | None] = {("from",): None}
        line = [("from",)]
        for a in line:
            for b, left in room.get(a, {}).items():
                if left > 0 and b not in came:
                    came[b] = a
                    line.append(b)
        return came

    while ("to",) in (came := reached()):
        path = [("to",)]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        steps = list(zip(path[1:], path, strict=False))
        most = min(room[a][b] for a, b in steps)
        for a, b in steps:
            room[a][b] -= most
            room[b][a] += most
    return [x for name, x in met.items() if (name, "in") in came and (name, "out") not in came]


Step = tuple[str, str, tuple[str, ...], tuple]


def steps_to(wanted: list[Node], given: list[Node]) -> list[Step]:
    """Steps from given columns to wanted ones, each after those it needs."""
    done, out = {x.sql for x in given}, []

    def make(x: Node) -> None:
        if x.sql in done:
            return
        done.add(x.sql)
        for a in x.args:
            make(a)
        out.append((x.sql, x.op, tuple(a.sql for a in x.args), x.how))

    for x in wanted:
        make(x)
    return out


def followed(steps: list[Step], have: dict[str, Column], rows: Rows, wanted: set[str]) -> dict[str, Column]:
    last = {a: k for k, s in enumerate(steps) for a in s[2]}
    with np.errstate(all="ignore"):
        for k, (name, op, args, how) in enumerate(steps):
            of = [have[a] for a in args]
            have[name] = np.full(len(rows.at), how[0]) if op == "fixed" else SINGLE[op](*of) if op in SINGLE else (BY_CODE if op in BY_CODE else BY_DATE)[op](rows, *of, *how)
            for a in {*args, name}:
                if a not in wanted and last.get(a, k) == k:
                    have.pop(a, None)
    return have


def chunks(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Whole groups of equal keys, CHUNK rows or one group at least."""
    held, due = [], CHUNK
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) < due:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        ends = np.flatnonzero(changes(*filled(whole.column(key))))
        at = int(ends[-1]) + 1 if len(ends) else 0
        if at:
            yield whole.slice(0, at)
        held = whole.slice(at).to_batches()
        due = max(CHUNK, 2 * (whole.num_rows - at))
    if held and sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks()


def phase_of(rows: DataFrame, by: str, given: dict[str, str], steps: list[Step], gives: dict[str, str], nulls: bool) -> DataFrame:
    """rows (code, date and the given columns), sorted by their key, with the columns to give instead: name of the column: step, and the same for given.
    nulls: NaN as NULL."""
    key = ("code", "date").index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, key):
            have = {step: t.column(c).to_numpy().astype(float) for c, step in given.items()}
            made = followed(steps, have, Rows(t.column(0), t.column(1), by), set(gives.values()))
            columns = [pa.array(made[s], pa.float64(), mask=np.isnan(made[s]) if nulls else None) for s in gives.values()]
            yield from pa.Table.from_arrays([t.column(0), t.column(1), *columns], names=["code", "date", *gives]).to_batches()

    return rows.select("code", "date", *given).mapInArrow(run, ", ".join(["code long, date date", *(f"{c} double" for c in gives)]))


def planned(numbers: list[int], last: Callable[[Term], Term]) -> tuple[dict[str, Node], list[list[Node]]]:
    """The results, and what each phase gets: the first one bars."""
    g = Grid()
    results = {f"alpha_{n:03d}": last(FORMULAS[n](g)) for n in numbers}
    wanted, gets = list(results.values()), []
    for phase in range(max(x.level for x in wanted), 0, -1):
        wanted = sent(wanted, phase)
        gets.append(wanted)
    return results, [[g.node(c) for c in BARS], *reversed(gets)]


def formulas(bars: DataFrame, numbers: list[int], last: Callable[[Term], Term] = lambda x: x, parts: int | None = None) -> DataFrame:
    """code, date and some of the published formulas, each after `last`; bars: dealt by code, one row a code and date. parts: as in `exprs.dealt`."""
    results, gets = planned(numbers, last)
    rows, names = bars, {c: x.sql for c, x in zip(BARS, gets[0], strict=True)}
    for phase, given in enumerate(gets):
        by = "date" if phase % 2 else "code"
        if phase:
            rows = dealt(rows, by, parts)
        rows = rows.sortWithinPartitions(*(F.col(c).asc_nulls_last() for c in (("date",) if phase % 2 else ("code", "date"))))
        end = phase == len(gets) - 1
        wanted = results if end else {x.sql: x for x in gets[phase + 1]}
        gives = {name: x.sql for name, x in wanted.items()}
        rows = phase_of(rows, by, names, steps_to(list(wanted.values()), given), gives, end)
        names = gives
    return rows
