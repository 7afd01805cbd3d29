"""Toxicity by classifier chains.

The categories are the label columns in a fixed order, quality before toxic. For each, a logistic model over the presence
of words, word beginnings and a few shapes of the whole text is fitted on a sample of at most SAMPLE labelled documents.
A later model also sees the probabilities of the earlier ones: in training those that models fitted on the other folds
give, in scoring those of the final earlier models.

Every word of every whole text is looked at in scoring. The vocabulary is chosen by the likelihood-ratio statistic of
each feature with a category over the sample, at most FEATURES for each category and only above LEAST_G2; the models of
the other folds choose theirs without the fold that they predict. Word beginnings have 3 to 8 letters; whole words any.

Defined cases: a null or empty text has no features; a very long text is read whole, as one set of features; a document
without a label, or whose label is null, is scored and not trained on; labels without a document are ignored; of a
repeated id the largest labels and the least text are trained on; ties in the statistic go by the feature; without labels of both kinds a category's probability is its share (0
without labels); repeated rows are scored each; an empty table gives an empty result; a null id is scored and kept;
further columns come through keep_clean() unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices, table, with_arrow_column, written

CATEGORIES = ("quality", "toxic")
#: Labelled documents of the fit.
SAMPLE = 8_000
#: Features that the fit takes for each category, those of the highest statistic, if it is above LEAST_G2.
FEATURES = 400
LEAST_G2 = 25.0
FOLDS = 5
RIDGE = 0.1
#: A fit ends when no weight moves by more.
CLOSE = 1e-3
THRESHOLD = 0.5
REMEMBERED = 100_000
#: Distinct features that a counting task holds before it passes their counts on.
COUNTED = 50_000
_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def features_of(token: str) -> tuple[str, ...]:
    """Of a token between white space: its words and their beginnings, in lower case."""
    out = []
    for w in _WORD.findall(token.lower()):
        out.append(f"{w}$")
        out += [w[:n] for n in range(3, min(len(w), 8) + 1)]
    return tuple(out)


def shapes(text: str, tokens: int, distinct: int) -> list[str]:
    upper = sum(1 for _ in re.finditer(r"[A-Z]", text)) if text else 0
    out = []
    if tokens >= 20:
        out += [f"\x00symbols{k}" for k, x in enumerate((0.1, 0.5)) if len(_SYMBOL.findall(text)) > x * tokens]
        out += ["\x00upper"] if upper > 0.4 * len(text) else []
        out += [f"\x00repeats{k}" for k, x in enumerate((0.5, 0.2)) if distinct < x * tokens]
    else:
        out.append("\x00short")
    return out


def all_features(text: str | None) -> set[str]:
    tokens = (text or "").split()
    own = set(tokens)
    return {f for t in own for f in features_of(t)} | set(shapes(text or "", len(tokens), len(own)))


@dataclass
class Logistic:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, near: Logistic | None = None) -> Logistic:
        """near: a model to start from."""
        return cls.fit_in_place(np.hstack([x, np.ones((len(x), 1))]), y, near)

    @classmethod
    def fit_in_place(cls, a: np.ndarray, y: np.ndarray, near: Logistic | None = None) -> Logistic:
        """a: the rows with a last column of ones, of which no copy is made."""
        share = float(y.mean()) if len(y) else 0.0
        if not 0 < share < 1:
            return cls(np.zeros(a.shape[1] - 1), 40.0 if share else -40.0)
        w = np.append(near.weights, near.bias) if near else np.append(np.zeros(a.shape[1] - 1), np.log(share / (1 - share)))
        ridge = np.full(a.shape[1], RIDGE)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((a * v[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
            size = np.abs(step).max()
            w += step * min(1.0, 4.0 / max(size, 1e-12))
            if size < CLOSE:
                break
        return cls(w[:-1], float(w[-1]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    models: list[Logistic]

    def predict(self, present: list[list[int]]) -> np.ndarray:
        """(documents, categories), each model fed the earlier probabilities."""
        out = np.zeros((len(present), len(self.models)))
        for j, m in enumerate(self.models):
            own = np.array([m.weights[p].sum() if p else 0.0 for p in present]) + m.bias
            if j:
                own = own + out[:, :j] @ m.weights[len(self.vocabulary):]
            out[:, j] = 1 / (1 + np.exp(-np.clip(own, -30, 30)))
        return out

    @classmethod
    def fit(cls, categories: tuple[str, ...], vocabulary: dict[str, int], of_fold: list[list[int]], present: list[list[int]], labels: np.ndarray, folds: np.ndarray) -> Chain:
        """vocabulary: the features of the chain, numbered from 0; of_fold: for each fold the numbers of the features chosen
        without it, which present numbers as well; labels: NaN where a document has none for the category."""
        x = np.zeros((len(present), 1 + max([len(vocabulary) - 1, *(i for own in of_fold for i in own), *(i for p in present for i in p)], default=-1)), np.uint8)
        for i, p in enumerate(present):
            x[i, p] = 1
        earlier, models, every = np.zeros((len(x), 0)), [], list(range(len(vocabulary)))
        for j in range(len(categories)):
            y = labels[:, j]
            has = ~np.isnan(y)
            m = _fit_alike(x, every, earlier, y, has)
            models.append(m)
            near = np.zeros(x.shape[1])
            near[every] = m.weights[: len(every)]
            out_of_fold = np.zeros(len(x))
            for f in range(len(of_fold)):
                mine = folds == f
                own = _fit_alike(x, of_fold[f], earlier, y, has & ~mine, Logistic(np.append(near[of_fold[f]], m.weights[len(every) :]), m.bias))
                out_of_fold[mine] = own.probability(np.hstack([x[mine][:, of_fold[f]], earlier[mine]]))
            earlier = np.hstack([earlier, out_of_fold[:, None]])
        return cls(categories, vocabulary, models)


def _fit_alike(x: np.ndarray, columns: list[int], earlier: np.ndarray, y: np.ndarray, use: np.ndarray, near: Logistic | None = None) -> Logistic:
    """The model over those columns of x and the earlier ones; columns that the rows can't tell apart are one in the fit, scaled
    so that the fit is that of the columns apart."""
    own = x[:, columns]
    if columns:
        _, first, group, alike = np.unique(np.packbits(own > 0, axis=0).T, axis=0, return_index=True, return_inverse=True, return_counts=True)
        group, root = group.reshape(-1), np.sqrt(alike)
    else:
        first, group, root = np.zeros(0, int), np.zeros(0, int), np.ones(0)
    a = np.ones((int(use.sum()), len(first) + earlier.shape[1] + 1))
    np.multiply(own[np.ix_(use, first)], root, out=a[:, : len(first)])
    a[:, len(first) : -1] = earlier[use]
    del own
    if near:
        near = Logistic(np.append(np.bincount(group, near.weights[: len(columns)], len(first)) / root, near.weights[len(columns) :]), near.bias)
    m = Logistic.fit_in_place(a, y[use], near)
    return Logistic(np.append((m.weights[: len(first)] / root)[group], m.weights[len(first) :]), m.bias)


_known: dict = {}


def present_in(text: str | None, vocabulary: dict[str, int], known: dict[str, tuple[int, ...]]) -> list[int]:
    if not text:
        text = ""
    tokens = text.split()
    own = set(tokens)
    found: set[int] = set()
    for t in own:
        got = known.get(t)
        if got is None:
            got = known[t] = tuple(vocabulary[f] for f in features_of(t) if f in vocabulary)
        if got:
            found.update(got)
    found.update(vocabulary[s] for s in shapes(text, len(tokens), len(own)) if s in vocabulary)
    return sorted(found)


def _memory(vocabulary: dict[str, int]) -> dict[str, tuple[int, ...]]:
    if _known.get("for") != vocabulary or len(_known["of"]) > REMEMBERED:
        _known["for"], _known["of"] = vocabulary, {}
    return _known["of"]


def _forget() -> None:
    _known.clear()


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """The chain, fitted on the sample of labelled documents with the least hashes of their ids."""
    # labels without a document neither take a place in the sample nor count in the statistic
    chosen = labels.filter(F.col("doc_id").isNotNull()).join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(*(F.max(c).cast("double").alias(c) for c in categories)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    facts = chosen.toPandas().set_index("doc_id")  # at most sample rows
    wanted = docs.sparkSession.createDataFrame([(int(i),) for i in facts.index], "doc_id long")
    # of the texts of a repeated id the least, so that reruns agree
    rows = written(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    ids = sorted(facts.index.tolist())
    values = {i: tuple(r) for i, r in zip(facts.index.tolist(), facts.to_numpy().tolist(), strict=True)}
    fold_of = {i: k % FOLDS for k, i in enumerate(ids)}
    n = len(categories)
    sums = [f"s{i}" for i in range(2 * n)]  # for each category: documents with the feature, and those of them labelled 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Counter]] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for fold, own in held.items():
                keys = list(set().union(*own))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([fold] * len(keys), pa.int32()), *(pa.array([c[k] for k in keys], pa.int64()) for c in own)], names=["feature", "fold", *sums])
            held.clear()

        for b in slices(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                f, own = all_features(text), held.setdefault(fold_of[i], [Counter() for _ in sums])
                for j, y in enumerate(values[i]):
                    if y == y:
                        own[2 * j].update(f)
                        if y >= 0.5:
                            own[2 * j + 1].update(f)
            if sum(len(own[0]) for own in held.values()) > COUNTED:
                yield from emptied()
        yield from emptied()

    without = {(s, f): f"{s}_{f}" for s in sums for f in range(FOLDS)}
    counts = rows.mapInArrow(count, "feature string, fold int, " + ", ".join(f"{s} long" for s in sums)).groupBy("feature").agg(*(F.sum(s).alias(s) for s in sums), *(F.coalesce(F.sum(F.when(F.col("fold") != f, F.col(s))), F.lit(0)).alias(c) for (s, f), c in without.items()))
    statistics = {}
    for j, c in enumerate(categories):
        for f in [None, *range(FOLDS)]:
            y = np.array([values[i][j] for i in ids if fold_of[i] != f])
            y = y[~np.isnan(y)]
            name = [sums[2 * j + k] if f is None else without[sums[2 * j + k], f] for k in (1, 0)]
            if 0 < (y >= 0.5).sum() < len(y):
                statistics[f, c] = _g2(*name, float((y >= 0.5).sum()), float(len(y)))
    chosen_features: dict[int | None, set[str]] = {f: set() for f in [None, *range(FOLDS)]}
    if statistics:
        names = {k: f"g{i}" for i, k in enumerate(statistics)}
        likely = written(counts.select("feature", *(g.alias(names[k]) for k, g in statistics.items())).filter(F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in names.values()), F.lit(0.0)) > LEAST_G2))
        for (f, _), name in names.items():
            chosen_features[f] |= {r[0] for r in likely.filter(F.col(name) > LEAST_G2).orderBy(F.col(name).desc(), "feature").limit(FEATURES).select("feature").collect()}
    vocabulary = {x: k for k, x in enumerate(sorted(chosen_features[None]))}
    every = dict(vocabulary)
    for f in range(FOLDS):
        for x in sorted(chosen_features[f]):
            every.setdefault(x, len(every))
    present = _present(rows, every)
    ids = sorted(present)
    y = np.array([values[i] for i in ids], float).reshape(len(ids), n)
    return Chain.fit(categories, vocabulary, [sorted(every[x] for x in chosen_features[f]) for f in range(FOLDS)], [present[i] for i in ids], y, np.array([fold_of[i] for i in ids], int))


def _g2(ones_with: str, with_: str, ones: float, total: float) -> Column:
    """The likelihood-ratio statistic of a feature with a category, NULL for one that all documents have."""
    a, b = F.col(ones_with).cast("double"), F.col(with_).cast("double")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = 2 * (part(a, b * (ones / total)) + part(b - a, b * (1 - ones / total)) + part(F.lit(ones) - a, (total - b) * (ones / total)) + part(total - ones - b + a, (total - b) * (1 - ones / total)))
    return F.when((b > 0) & (b < total), g2)


def _present(rows: DataFrame, vocabulary: dict[str, int]) -> dict[int, list[int]]:
    def make(texts: pa.Array) -> pa.Array:
        known = _memory(vocabulary)
        return pa.array([present_in(t, vocabulary, known) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return {r[0]: list(r[1]) for r in with_arrow_column(rows, "present", T.ArrayType(T.IntegerType()), make, ["text"], _forget).select("doc_id", "present").collect()}


def with_probabilities(docs: DataFrame, chain: Chain, name: str, text_col: str = "text") -> DataFrame:
    """docs and a struct with the probability of each category."""

    def make(texts: pa.Array) -> pa.Array:
        known = _memory(chain.vocabulary)
        p = chain.predict([present_in(t, chain.vocabulary, known) for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(p[:, j], pa.float64()) for j in range(p.shape[1])], names=list(chain.categories))

    return with_arrow_column(docs, name, T.StructType([T.StructField(c, T.DoubleType()) for c in chain.categories]), make, [text_col], _forget)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not held toxic, with their own columns."""
    p = free_name(docs, "p")
    return with_probabilities(docs, train(docs, labels), p).filter(F.col(f"{p}.toxic") < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = with_probabilities(docs.select("doc_id", "text"), train(docs, labels), "p")
    return p.select("doc_id", F.col("p.quality").alias("p_quality"), F.col("p.toxic").alias("p_toxic"), (F.col("p.toxic") >= THRESHOLD).alias("toxic"))
