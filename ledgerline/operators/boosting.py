"""Gradient boosting over histograms, with absolute or squared loss, and predictions out of fold over an expanding past.

Rows never leave their partitions. A level of a tree is one job: each task adds up gradients by (node, feature, bin) over its rows, Spark adds up
the tasks' sums, and the driver, which gets nodes x features x bins sums and no rows, takes the best split of each node. Gradients are
whole numbers (signs, or residuals in fixed point), so sums don't depend on the order of rows and a rerun gives the same trees.
Missing values have a bin of their own, and each split learns on which side they go."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Residuals of the squared loss are summed as multiples of this part of the label's mean deviation.
FIXED = 2.0**-20


@dataclass(frozen=True)
class Rules:
    """loss: l1 (gradients are signs, leaves are medians) or l2 (leaves are shrunk means). patience: rounds without a better loss on the last
    `held_out` of the dates before it stops; the best round's trees are kept. shares of rows and features are drawn for each tree by seed."""

    loss: str = "l1"
    rounds: int = 50
    depth: int = 4
    rate: float = 0.1
    bins: int = 63
    least: int = 20
    ridge: float = 1.0
    lasso: float = 0.0
    rows: float = 0.8
    features: float = 0.8
    held_out: float = 0.05
    patience: int = 10
    seed: int = 42


@dataclass
class Tree:
    """Node i has children 2 i + 1 and 2 i + 2; a node without a feature (-1) is a leaf. Bins up to `bin` go left, the missing ones (bin 0) by `left`."""

    feature: list[int]
    bin: list[int]
    left: list[bool]
    value: list[float]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; bins: rows x features."""
        at, feature, cut, left = np.zeros(len(bins), np.int64), np.array(self.feature), np.array(self.bin), np.array(self.left)
        for _ in range(len(self.feature).bit_length()):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            b = bins[np.arange(len(bins)), np.maximum(f, 0)]
            goes = np.where(b == 0, left[at], b <= cut[at])
            at = np.where(inner, 2 * at + np.where(goes, 1, 2), at)
        return at


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def bins_of(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin 0 is missing, NaN or infinite; bin k holds values up to edge k."""
        made = [np.where(np.isfinite(x), 1 + np.searchsorted(e, x, side="left"), 0) for x, e in zip(columns, self.edges, strict=True)]
        return np.stack(made, axis=1).astype(np.uint8)

    def predict(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """rows and the score."""
        at = [rows.columns.index(f) for f in self.features]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = self.bins_of([_floats(b.column(i)) for i in at])
                out = np.full(b.num_rows, self.start)
                for t in self.trees:
                    out += np.array(t.value)[t.leaves(bins)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

        return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + f", `{name}` double")

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Model:
        raw = json.loads(text)
        return Model(**raw | {"trees": [Tree(**t) for t in raw["trees"]]})


def _floats(x: pa.Array) -> np.ndarray:
    return x.cast(pa.float64()).to_numpy(zero_copy_only=False)


def edges_of(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Cuts between bins: distinct quantiles of the finite values, from sketches that Spark merges."""
    finite = lambda c: F.when(F.col(c).cast("double").between(-1e300, 1e300), F.col(c).cast("double"))
    found = rows.agg(*(F.percentile_approx(finite(c), [(k + 1) / bins for k in range(bins - 1)], 10_000).alias(f"q{i}") for i, c in enumerate(features))).first()
    return [sorted(set(q or [])) for q in found]


def best_split(g: np.ndarray, n: np.ndarray, rules: Rules, allowed: list[int]) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, missing go left) of a node from sums of gradients and rows by feature x bin; ties to the smaller feature, bin, and to the right."""
    best, total, count = None, int(g[allowed[0]].sum()), int(n[allowed[0]].sum())
    score = lambda s, k: np.maximum(np.abs(s * 1.0) - rules.lasso, 0) ** 2 / (k + rules.ridge)
    for f in allowed:
        sums, rows = np.cumsum(g[f][1:]), np.cumsum(n[f][1:])
        for left in (False, True):
            s, k = sums + left * g[f][0], rows + left * n[f][0]
            fits = (k >= rules.least) & (count - k >= rules.least)
            gain = np.where(fits, score(s, k) + score(total - s, count - k) - score(total, count), -np.inf)
            i = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-9):
                best = float(gain[i]), f, i + 1, left
    return best


def _steady(x: float) -> float:
    """Without the last digits, which depend on the order of a sum."""
    return float(f"{x:.10g}")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), np.uint8)


def _drawn(b: pa.RecordBatch, k: int, share: float) -> np.ndarray:
    """Training rows of round k, by a mark of the row that doesn't depend on where it lies."""
    mark = b.column(3).to_numpy() * (2 * k + 1) % 1_000_003
    return ~b.column(2).to_numpy(zero_copy_only=False) & (mark < share * 1_000_003)


def _rest(b: pa.RecordBatch) -> np.ndarray:
    return b.column(1).to_numpy() - b.column(4).to_numpy()


class _Fit:
    """One model's training. The rows are binned once; a round adds a tree to every row's prediction and keeps that beside the bins."""

    def __init__(self, rows: DataFrame, features: list[str], label: str, at: str, rules: Rules, drawn: Column) -> None:
        self.rules, self.features, self.spark = rules, features, rows.sparkSession
        good = rows.filter(F.col(label).cast("double").between(-1e300, 1e300))
        dates = [r[0] for r in good.select(at).distinct().orderBy(at).collect()]  # one value a date
        if len(dates) < 2:
            raise ValueError("too few dates to train on")
        first_held = dates[len(dates) - max(1, int(len(dates) * rules.held_out))]
        train = good.filter(F.col(at) < F.lit(first_held))
        self.model = Model(features, edges_of(train, features, rules.bins), 0.0)
        middle = F.percentile_approx(label, 0.5, 10_000) if rules.loss == "l1" else F.avg(label)
        self.model.start, spread = map(_steady, train.agg(middle.cast("double"), F.coalesce(F.avg(F.abs(F.col(label))), F.lit(0.0))).first())
        self.unit = max(spread, 1e-12) * FIXED
        base = good.select(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("y"), (F.col(at) >= F.lit(first_held)).alias("held"), F.pmod(F.xxhash64(drawn, F.lit(rules.seed)), F.lit(2**31)).cast("long").alias("mark"))
        start, model = self.model.start, self.model

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = model.bins_of([_floats(b.column(i)) for i in range(len(features))])
                raw = pa.array([x.tobytes() for x in bins], pa.binary())
                yield pa.RecordBatch.from_arrays([raw, *b.columns[len(features) :], pa.array(np.full(b.num_rows, start))], names=["bins", "y", "held", "mark", "p"])

        self.kinds = "bins binary, y double, held boolean, mark long, p double"
        self.state = base.mapInArrow(binned, self.kinds).persist(StorageLevel.MEMORY_AND_DISK)

    def level(self, k: int, tree: Tree, nodes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Sums of gradients and rows of the nodes, by feature and bin."""
        width, n_features, unit, l1, share = self.rules.bins + 1, len(self.features), self.unit, self.rules.loss == "l1", self.rules.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((len(nodes), n_features, width), np.int64)
            n = np.zeros_like(g)
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            for b in batches:
                use = _drawn(b, k, share)
                bins, rest = _matrix(b)[use], _rest(b)[use]
                grad = np.sign(rest).astype(np.int64) if l1 else np.rint(rest / unit).astype(np.int64)
                node = place[tree.leaves(bins)]
                inside = node >= 0
                for f in range(n_features):
                    np.add.at(g, (node[inside], f, bins[inside, f]), grad[inside])
                    np.add.at(n, (node[inside], f, bins[inside, f]), 1)
            at = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in at), pa.array(g[at]), pa.array(n[at])], names=["node", "feature", "bin", "g", "n"])

        sums = self.state.mapInArrow(run, "node long, feature long, bin long, g long, n long").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
        out = {i: (np.zeros((n_features, width), np.int64), np.zeros((n_features, width), np.int64)) for i in nodes}
        for r in sums.collect():  # at most nodes x features x bins sums
            out[nodes[r.node]][0][r.feature, r.bin], out[nodes[r.node]][1][r.feature, r.bin] = r.g, r.n
        return out

    def grow(self, k: int) -> Tree:
        size, rng = 2 ** (self.rules.depth + 1) - 1, random.Random(f"{self.rules.seed}-{k}")
        tree = Tree([-1] * size, [0] * size, [False] * size, [0.0] * size)
        some = sorted(rng.sample(range(len(self.features)), max(1, round(self.rules.features * len(self.features)))))
        nodes = [0]
        for _ in range(self.rules.depth):
            splits = {i: best_split(g, n, self._in_units(), some) for i, (g, n) in self.level(k, tree, nodes).items()}
            nodes = []
            for i, s in splits.items():
                if s:
                    _, tree.feature[i], tree.bin[i], tree.left[i] = s
                    nodes += [2 * i + 1, 2 * i + 2]
            if not nodes:
                break
        self.fill(k, tree)
        return tree

    def _in_units(self) -> Rules:
        """The penalty on sums, in the units that they are summed in."""
        return self.rules if self.rules.loss == "l1" else replace(self.rules, lasso=self.rules.lasso / self.unit)

    def fill(self, k: int, tree: Tree) -> None:
        """Leaf values: medians of residuals (l1), or their shrunk means (l2), times the rate."""
        share = self.rules.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                use = _drawn(b, k, share)
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(_matrix(b)[use])), pa.array(_rest(b)[use])], names=["leaf", "rest"])

        leaves = self.state.mapInArrow(run, "leaf long, rest double").groupBy("leaf")
        value = F.percentile_approx("rest", 0.5, 10_000) if self.rules.loss == "l1" else F.sum(F.round(F.col("rest") / self.unit).cast("long"))
        for leaf, v, n in leaves.agg(value, F.count(F.lit(1))).collect():
            if self.rules.loss != "l1":
                v = np.sign(v) * max(abs(v * self.unit) - self.rules.lasso, 0) / (n + self.rules.ridge)
            tree.value[leaf] = float(v) * self.rules.rate

    def add(self, tree: Tree, cut: bool) -> float:
        """Adds the tree to the predictions; the loss on the dates held out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = b.column(4).to_numpy() + np.array(tree.value)[tree.leaves(_matrix(b))]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(p)], names=b.schema.names)

        before, self.state = self.state, self.state.mapInArrow(run, self.kinds).persist(StorageLevel.MEMORY_AND_DISK)
        if cut and self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            self.state = self.state.checkpoint()
        rest = F.col("y") - F.col("p")
        loss = self.state.filter("held").agg(F.avg(F.abs(rest) if self.rules.loss == "l1" else rest * rest)).first()[0]
        before.unpersist()
        return _steady(loss)


def fit(rows: DataFrame, features: list[str], label: str, at: str = "date", rules: Rules = Rules(), drawn: Column | None = None) -> Model:  # noqa: B008
    """A model of the label from the features; rows with a NULL or infinite label take no part. The last dates are held out to stop in time. drawn: what a row's
    place in the draws depends on (code and date by default). Every tenth round the lineage is cut, if the session has a checkpoint folder."""
    if rules.loss not in ("l1", "l2"):
        raise ValueError(f"no such loss: {rules.loss}")
    if not 1 < rules.bins < 255:
        raise ValueError("2 to 254 bins")
    f = _Fit(rows, features, label, at, rules, F.concat_ws(":", "code", at) if drawn is None else drawn)
    best, kept = float("inf"), 0
    for k in range(rules.rounds):
        tree = f.grow(k)
        f.model.trees.append(tree)
        loss = f.add(tree, k % 10 == 9)
        f.model.losses.append(loss)
        if loss < best:
            best, kept = loss, k + 1
        if k + 1 - kept >= rules.patience or tree.feature[0] < 0 and rules.features == 1:
            break
    f.state.unpersist()
    f.model.trees = f.model.trees[:kept]
    return f.model


def out_of_fold(rows: DataFrame, features: list[str], label: str, at: str = "date", first: int = 960, every: int = 120, buffer: int = 6, least: int = 10_000, rules: Rules = Rules(loss="l2"), frozen_from: object = None) -> DataFrame:  # noqa: B008
    """rows of the dates from the first-th on, each with the score of a model that saw only dates at least `buffer` before its segment of
    `every` dates. A segment whose past has at most `least` labelled rows takes the last model; without one it has no rows. From the
    date frozen_from on no model is trained but one, on all dates that are safe before it."""
    dates = [r[0] for r in rows.select(at).distinct().filter(F.col(at).isNotNull()).orderBy(at).collect()]  # one value a date
    labelled = dict(rows.filter(F.col(label).isNotNull()).groupBy(at).count().collect())
    parts, model, frozen = [], None, False
    for i in range(first, len(dates), every):
        last = dates[max(i - buffer, 0)]
        if frozen_from is not None and dates[i] >= frozen_from:
            before = sum(d < frozen_from for d in dates)
            last, frozen = (None, True) if frozen else (dates[max(before - buffer, 0)], True)
        if last is not None and sum(labelled.get(d, 0) for d in dates if d < last) > least:
            model = fit(rows.filter(F.col(at) < F.lit(last)), features, label, at, rules)
        if model is not None:
            end = dates[i + every] if i + every < len(dates) else None
            segment = F.col(at) >= F.lit(dates[i]) if end is None else (F.col(at) >= F.lit(dates[i])) & (F.col(at) < F.lit(end))
            parts.append(model.predict(rows.filter(segment)))
    if not parts:
        return rows.limit(0).withColumn("score", F.lit(None).cast("double"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
