"""Connected components by repeated minima over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. Rows (id, component) for every id of an edge; component is the least id that can be reached.

    Large-star and small-star rounds: the number of rounds grows with the logarithm of the longest path. The table of least
    neighbours is written before it is joined, so Spark broadcasts it if it is small and else may split the join of a node
    of many edges over several tasks."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = cut(both(now).select(F.col("a").alias("id")).distinct())
    while True:
        # every larger neighbour of a node gets the node's least neighbour
        around = both(now)
        least = written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = written(around.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct())
        # every smaller neighbour of a node, and the node, get the least of them
        small = written(large.groupBy("b").agg(F.min("a").alias("m")))
        after = cut(large.join(small, "b").select(F.col("m").alias("p"), "a", "b").select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("a").alias("b")), F.struct(F.col("p").alias("a"), "b"))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
        # stars only: no centre is a leaf and no leaf has two centres
        if not after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").take(1) and after.count() == after.select("b").distinct().count():
            break
        now = after
    return ids.join(after.select(F.col("b").alias("id"), F.col("a").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
