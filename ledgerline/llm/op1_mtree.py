"""Exact top-k search by inner product with M-trees.

An inner product becomes a metric by one more coordinate: with M the largest squared norm, x gets sqrt(M - |x|^2) and a
query gets 0, so |q - x|^2 = |q|^2 + M - 2 q.x and the highest score is the nearest object. Pivots from a bounded sample
deal the vectors into cells, and a hash deals large cells into trees of about TREE vectors. Each tree is built in one
task as paged nodes: entries hold a routing object, its covering radius, its distance to the routing object of the page
and the child page. A search visits pages best first, by the least distance that a page can hold, and first tries the
bound |d(q, parent) - d(entry, parent)| - radius, which needs no new distance. Every query is searched in a tree of its
nearest cell first; its k-th score then rules out whole cells by their covering radius before the other trees are searched.

Distances carry a small slack, and every entry that may reach the k-th score, ties included, is compared by its exact
integer score.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate; vectors
of unequal length count as padded with zeros; a null id is a candidate with a null id, last among ties, and no query;
rows that repeat an id are candidates each, but never for a query of that id, and the first of them by vector order is
the query; an empty table gives no rows; further columns are ignored; very long vectors are taken whole. Vectors whose squared norm, as
integers, reaches LARGEST take no part either: a score with one may not be a long, and all scores of the others are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
PIVOTS = 64
SAMPLE = 4096
TREE = 4096
#: A product of two vectors is at most the product of their lengths.
LARGEST = 2**62
PAGE = 64
FAN = 32

_PAGE_KIND = "cell int, salt int, page int, leaf boolean, ids array<long>, vectors array<long>, norms array<long>, radius array<double>, parent array<double>, child array<int>"


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v, floor(256 * x) of each component, for vectors that take part."""
    v = F.col(f"`{vector_col}`")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * 256).cast("double"), F.lit(2.0)))
    small = F.forall(v, lambda x: F.abs(x.cast("double")) < 2.0**31)  # a longer one can't be small enough, and its floor may not be a long
    sound = sound & small & F.when(sound & small, size < LARGEST * (1 - 1e-9))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(sound, F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long"))).alias("v")).filter(F.col("v").isNotNull())


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _lift(x: np.ndarray, most: int) -> np.ndarray:
    """Floats with the further coordinate."""
    f = x.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(most - (f * f).sum(axis=1, keepdims=True), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def build(cell: int, salt: int, ids: np.ndarray, x: np.ndarray, most: int) -> pd.DataFrame:
    """The pages of one tree; page 0 is the root."""
    lifted, pages = _lift(x, most), []

    def node(at: np.ndarray, centre: np.ndarray | None) -> int:
        number = len(pages)
        pages.append(None)
        if len(at) <= PAGE:
            parent = np.zeros(len(at)) if centre is None else _distances(lifted[at], centre[None])[:, 0]
            pages[number] = (True, ids[at], x[at], np.zeros(len(at)), parent, np.full(len(at), -1))
            return number
        n = min(FAN, -(-len(at) // PAGE))
        rng = np.random.default_rng([cell, salt, number])
        routers = at[np.sort(rng.choice(len(at), n, replace=False))]
        near = _distances(lifted[at], lifted[routers])
        home = near.argmin(1)
        if np.bincount(home, minlength=n).max() > 0.9 * len(at):  # alike objects: any even cut is as good
            home = np.arange(len(at)) * n // len(at)
        found = [(r, at[home == k], near[home == k, k].max()) for k, r in enumerate(routers) if (home == k).any()]
        parent = [0.0 if centre is None else float(_distances(lifted[[r]], centre[None])[0, 0]) for r, _, _ in found]
        children = [node(own, lifted[r]) for r, own, _ in found]
        heads = [r for r, _, _ in found]
        pages[number] = (False, ids[heads], x[heads], np.array([d for _, _, d in found]), np.array(parent), np.array(children))
        return number

    node(np.arange(len(ids)), None)
    return pd.DataFrame([(cell, salt, k, leaf, [None if i is pd.NA else i for i in i_], v.ravel(), (v * v).sum(1), radius, parent, child) for k, (leaf, i_, v, radius, parent, child) in enumerate(pages)], columns=[c.split()[0] for c in _PAGE_KIND.split(", ")])


class Tree:
    def __init__(self, pages: pd.DataFrame, dim: int, most: int) -> None:
        self.most, self.pages = most, {}
        for p in pages.itertuples():
            v = np.asarray(p.vectors, np.int64).reshape(-1, dim)
            self.pages[p.page] = (p.leaf, list(p.ids), v, v.astype(np.float64), np.asarray(p.norms, np.float64), np.asarray(p.radius), np.asarray(p.parent), np.asarray(p.child))
        self.computed = self.avoided = 0

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int | None]]:
        """The k best (score, id) but for the query's own id, of those that reach the score floor."""
        f, q2 = q.astype(np.float64), float((q.astype(np.float64) ** 2).sum())
        slack = 1e-6 + 1e-7 * np.sqrt(q2 + self.most)
        best: list[tuple[int, float, int | None]] = []  # a heap: the worst first
        reach = lambda s: np.sqrt(max(q2 + self.most - 2.0 * s, 0.0)) + slack
        bound = np.inf if floor is None else reach(floor)
        heap, count = [(0.0, 0, 0, None)], 0
        while heap:
            least, _, page, to_parent = heapq.heappop(heap)
            if least > bound:
                break
            leaf, ids, v, vf, norms, radius, parent, child = self.pages[page]
            at = np.arange(len(ids)) if to_parent is None else np.flatnonzero(np.abs(to_parent - parent) - radius <= bound)
            self.computed, self.avoided = self.computed + len(at), self.avoided + len(ids) - len(at)
            if not len(at):
                continue
            if not leaf:
                d = np.sqrt(np.maximum(q2 + self.most - 2 * (vf[at] @ f), 0))
                for i, dist, low in zip(at, d, np.maximum(d - radius[at], 0), strict=True):
                    if low <= bound:
                        count += 1
                        heapq.heappush(heap, (low, count, int(child[i]), dist))
                continue
            scores = v[at] @ q
            for i, s in zip(at.tolist(), scores.tolist(), strict=True):
                one = ids[i]
                if one == own or floor is not None and s < floor:
                    continue
                entry = (s, -float("inf") if one is None else -one, one)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry[:2] > best[0][:2]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                bound = min(bound, reach(best[0][0]))
        return [(s, one) for s, _, one in best]


def top_k(rows: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by every, its k candidates of the highest inner product."""
    v = cut(quantised(rows).withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)))
    facts = v.agg(F.max(F.size("v")), F.max("norm"), F.count(F.lit(1))).first()
    result = "query_id long, vec_id long, score long"
    if not facts[2]:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, most = max(int(facts[0]), 1), int(facts[1])
    sample = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    lifted = _lift(_matrix(sample, dim), most)
    pivots = lifted[np.random.default_rng(1).choice(len(lifted), min(PIVOTS, 1 + len(lifted) // PAGE), replace=False)]

    def nearest(batches):
        for b in batches:
            x = _lift(_matrix(b["v"], dim), most)
            d = _distances(x, pivots)
            yield b.assign(cell=d.argmin(1).astype(np.int32), far=d.min(1))

    dealt = v.mapInPandas(nearest, "id long, v array<long>, norm long, cell int, far double")
    stats = {r["cell"]: (max(1, -(-r["n"] // TREE)), r["far"]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    salts = F.create_map(*(F.lit(x) for c, (n, _) in stats.items() for x in (c, n)))
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("id", "v"), salts[F.col("cell")]).cast("int"))

    def tree(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        ids = np.array([None if pd.isna(i) else int(i) for i in g["id"]], object)
        return build(int(key[0]), int(key[1]), ids, _matrix(g["v"], dim), most)

    trees = cut(salted.groupBy("cell", "salt").applyInPandas(tree, _PAGE_KIND))
    first = Window.partitionBy("id").orderBy("v")
    asked = dealt.filter(F.col("id") % every == 0).withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("id", "v", "cell", F.pmod(F.xxhash64("id"), salts[F.col("cell")]).cast("int").alias("salt"), F.lit(None).cast("long").alias("floor"))

    def search(key: tuple, pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(queries):
            own = Tree(pages, dim, most)
            for q in queries.itertuples():
                vector = _matrix([q.v], dim)[0]
                out += [(q.id, one, s) for s, one in own.search(q.id, vector, k, None if pd.isna(q.floor) else int(q.floor))]
        return pd.DataFrame({"query_id": pd.array([o[0] for o in out], "Int64"), "vec_id": pd.array([o[1] for o in out], "Int64"), "score": pd.array([o[2] for o in out], "Int64")})

    def searched(queries: DataFrame) -> DataFrame:
        return trees.groupBy("cell", "salt").cogroup(queries.groupBy("cell", "salt")).applyInPandas(search, result)

    asked = cut(asked)
    home = cut(searched(asked))
    floors = home.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).select("id", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    cells = sorted(stats)

    def routes(batches):
        """The cells whose covering radius leaves room for the query's k-th score."""
        for b in batches:
            out = []
            for q in b.itertuples():
                f = _matrix([q.v], dim)[0].astype(np.float64)
                q2 = float((f * f).sum())
                d = _distances(np.append(f, 0.0)[None], pivots[cells])[0]
                slack = 1e-6 + 1e-7 * np.sqrt(q2 + most)
                bound = np.inf if pd.isna(q.floor) else np.sqrt(max(q2 + most - 2.0 * int(q.floor), 0.0)) + slack
                out += [(q.id, q.v, c, q.floor, q.cell, q.salt) for c, x in zip(cells, d, strict=True) if x - stats[c][1] <= bound + slack]
            yield pd.DataFrame({"id": [o[0] for o in out], "v": [o[1] for o in out], "cell": pd.array([o[2] for o in out], "Int32"), "floor": pd.array([None if pd.isna(o[3]) else int(o[3]) for o in out], "Int64"), "cell0": pd.array([o[4] for o in out], "Int32"), "salt0": pd.array([o[5] for o in out], "Int32")})

    routed = asked.drop("floor").join(floors, "id", "left").mapInPandas(routes, "id long, v array<long>, cell int, floor long, cell0 int, salt0 int")
    spread = routed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts[F.col("cell")] - 1))).filter((F.col("cell") != F.col("cell0")) | (F.col("salt") != F.col("salt0"))).select("id", "v", "cell", "salt", "floor")
    both = home.unionByName(searched(spread))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(rows: DataFrame) -> DataFrame:
    return top_k(rows)


SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from e q join e c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
