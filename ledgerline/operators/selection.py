"""Choosing features: correlations of all pairs in one pass, clusters of alike ones, and the best of each cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import dealt, sdiv
from ledgerline.operators.panel import LEAST, average_rank


def correlations(rows: DataFrame, features: list[str], block: int = 4096) -> DataFrame:
    """a, b, n, corr for each pair a < b by their order in features, over the rows that have both; NULL if fewer than two do or one doesn't vary. NULL, NaN
    and infinite values are missing.

    One pass: each task keeps products of blocks of rows with themselves (values, squares and presence, features x features) and Spark adds the tasks' up;
    values are taken from a rough middle first, so that large means leave the digits to what varies."""
    finite = lambda c: F.when(F.col(c).cast("double").between(-1e300, 1e300), F.col(c).cast("double"))
    narrow = rows.select(*(finite(f).alias(f"f{i}") for i, f in enumerate(features)))
    n_features = len(features)
    found = narrow.agg(*(F.percentile_approx(f"f{i}", 0.5, 100) for i in range(n_features))).first()
    middle = np.array([0.0 if v is None else v for v in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, xx, xy = (np.zeros((n_features, n_features)) for _ in range(4))
        for whole in batches:
            for lo in range(0, whole.num_rows, block):
                b = whole.slice(lo, block)
                v = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float) - middle
                there = ~np.isnan(v)
                v, m = np.where(there, v, 0.0), there.astype(float)
                n += m.T @ m
                x += v.T @ m  # of the row's feature, where the column's is there too
                xx += (v * v).T @ m
                xy += v.T @ v
        i, j = np.triu_indices(n_features, 1)
        kinds = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(a) for a in (n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]))], names=kinds)

    sums = narrow.mapInArrow(run, "i long, j long, n double, x double, y double, xx double, yy double, xy double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    c = F.col
    var = lambda s, q: c(q) - c(s) * c(s) / c("n")
    real = lambda s, q: F.when(var(s, q) > 1e-12 * c(q), var(s, q))
    corr = (c("xy") - c("x") * c("y") / c("n")) / F.sqrt(real("x", "xx") * real("y", "yy"))
    name = F.array(*(F.lit(f) for f in features))
    return sums.select(F.element_at(name, (c("i") + 1).cast("int")).alias("a"), F.element_at(name, (c("j") + 1).cast("int")).alias("b"), c("n").cast("long").alias("n"), F.when((c("n") >= 2) & corr.isNotNull(), F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0))).alias("corr"))


def linkage(distance: np.ndarray, at_most: float) -> list[int]:
    """The cluster of each item by average linkage, up to merges at `at_most`: chains of nearest neighbours, whose ends merge when they are each
    other's nearest. The cluster's number is its least item. Items are features, so the matrix is small."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            top = chain[-1]
            row = np.where(alive, d[top], np.inf)
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:  # of equals the one that we came from
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(d[a, b]), a, b))
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    up = list(range(n))
    for height, a, b in sorted(merges):  # average linkage never merges lower later, so the order by height is that of a greedy search
        if height <= at_most:
            lo, hi = sorted((up[a], up[b]))
            up = [lo if u == hi else u for u in up]
    return up


def mean_ic(rows: DataFrame, features: list[str], label: str, parts: int | None = None) -> dict[str, float]:
    """Each feature's mean rank correlation with the label over dates, as rank_ic has it; 0 where it has none. Rows are dealt by date once, for all features."""
    narrow = dealt(rows.select("date", F.col(label).alias("_l"), *(F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features))), "date", parts)
    both = lambda i, c: F.when(F.col("_l").isNotNull() & ~F.isnan(f"_f{i}"), F.col(c))
    pairs = narrow.select("date", *(both(i, f"_f{i}").alias(f"_x{i}") for i in range(len(features))), *(both(i, "_l").alias(f"_y{i}") for i in range(len(features))))
    pairs = pairs.withColumns({f"_y{i}": F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_y{i}")) for i in range(len(features))})
    ranked = pairs.select("date", *(average_rank(f"_{k}{i}", "date").alias(f"_{k}{i}") for i in range(len(features)) for k in "xy"))
    ic = lambda i: F.when(F.count(f"_x{i}") >= LEAST, sdiv(F.covar_pop(f"_x{i}", f"_y{i}"), F.stddev_pop(f"_x{i}") * F.stddev_pop(f"_y{i}")))
    found = ranked.groupBy("date").agg(*(ic(i).alias(f"_{i}") for i in range(len(features)))).agg(*(F.avg(f"_{i}") for i in range(len(features)))).first()
    return {f: v or 0.0 for f, v in zip(features, found)}


def select(rows: DataFrame, features: list[str], label: str, alike: float = 0.7, most: int = 60, parts: int | None = None) -> DataFrame:
    """feature, cluster (its first feature), ic, rank: the feature of the largest |mean IC| of each cluster of features that correlate by `alike` or more in the
    mean, the `most` best of them. Ties go to the earlier feature; a pair without a correlation counts as 0."""
    at = {f: i for i, f in enumerate(features)}
    distance = np.ones((len(features), len(features)))
    for r in correlations(rows, features).collect():  # one row a pair of features
        distance[at[r.a], at[r.b]] = distance[at[r.b], at[r.a]] = 1 - abs(r["corr"] or 0.0)
    cluster, ic = linkage(distance, 1 - alike + 1e-12), mean_ic(rows, features, label, parts)
    best: dict[int, str] = {}
    for f in features:
        k = cluster[at[f]]
        if k not in best or abs(ic[f]) > abs(ic[best[k]]):
            best[k] = f
    ranked = sorted(best.items(), key=lambda e: (-abs(ic[e[1]]), at[e[1]]))[:most]
    return rows.sparkSession.createDataFrame([(f, features[k], ic[f], i + 1) for i, (k, f) in enumerate(ranked)], "feature string, cluster string, ic double, rank int")
