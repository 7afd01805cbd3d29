"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into at most BLOCKS blocks by a hash of the document. A source's quota is an exact number of block
draws: whole passes over its blocks in a permuted order, then the first blocks of one more pass, the last of them in
part, so that the words drawn meet the target. A tree over the output shards splits the vector of quotas in two at
every node by a multivariate-hypergeometric draw, so every shard gets its exact share and all shards together the whole
quota. Shards take disjoint stretches of each source's permuted draws and are shuffled locally by a hash.

The driver sees one row for each source (counts and sums), never documents. Draws go to the documents by a join with a
written table of blocks, which Spark broadcasts if it is below its threshold, so texts are shuffled once, to the shards.
Sizes and hashes are written once, and all but the last step read those. The one block of a source that is drawn in part
is one task's, as hashes and sizes: about 1/BLOCKS of the source.

Defined cases: a null or empty text has size 0 and is drawn like any other; a very long text counts whole, and may be all
that a target leaves out; a null source is a source of its own, the last; a null id is dealt by its text and may be drawn;
repeated rows are separate rows, and of rows that tie in hash and size any one is as good; an empty table gives an empty
result; a source without words has target 0 and is not drawn; further columns, whatever their names, come through shards()
unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCKS = 1024
DOCS_A_BLOCK = 64
WEIGHTS = (1, 2, 3)
MOST = 3
SHARDS = 16
#: A shard has at least so many parts, and one for so many documents of the input over its shards.
PARTS, DOCS_A_PART = 16, 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Targets in proportion to the weights, none above most times its size, with the sum of the sizes."""
    sizes, weights = sizes.astype(float), weights.astype(float)
    target, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = sizes.sum()
    while open_.any():
        share = np.where(open_, weights, 0) / weights[open_].sum() * left
        above = open_ & (share > most * sizes)
        if not above.any():
            target[open_] = share[open_]
            break
        target[above] = most * sizes[above]
        left -= target[above].sum()
        open_ &= ~above
    return target


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many draws of each source every shard gets; the columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, int(q.sum()) * (mid - lo) // (hi - lo), method="marginals")
        node(left, lo, mid)
        node(q - left, mid, hi)

    node(quotas.astype(np.int64), 0, shards)
    return out


def part_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block that fill what is left of a source's target: largest first while they fit, then the smallest
    other one if that comes nearer."""
    rows = rows.sort_values(["size", "order"], ascending=[False, True], kind="stable")
    left = float(rows["part"].iloc[0])
    sizes = rows["size"].to_numpy()
    take = np.zeros(len(rows), bool)
    for i, n in enumerate(sizes):
        if n <= left:
            take[i] = True
            left -= n
    other = np.flatnonzero(~take)
    if len(other) and sizes[other[-1]] - left < left:
        take[other[-1]] = True
    return rows[take].groupby(["block_key", "order", "size"]).size().rename("times").reset_index()


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, seed: int = 5, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """row: a struct of the document's own columns; mix: a struct of size, source_size, target, shards, an array with one shard for
    each time the mix takes the row, and order, a hash of the row's id."""
    spark = docs.sparkSession
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    # the columns of docs go in a struct, so that no name of theirs can meet one used here
    order = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), text), F.lit(seed))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if docs.columns else F.lit(None)
    sized = docs.select(row.alias("row"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("null"), words(text).alias("size"), order.alias("order"))
    facts = written(sized.drop("row"))
    table = facts.groupBy("source", "null").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("null", "source").toPandas()  # a row a source
    sizes, counts = table["size"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
    target = fill(sizes, np.array([weights[i % len(weights)] for i in range(len(table))]))
    blocks = np.clip(counts // DOCS_A_BLOCK, 1, BLOCKS)
    passes = np.where(sizes > 0, np.minimum(np.floor(target / np.maximum(sizes, 1) + 1e-9), MOST), 0).astype(np.int64)
    of_source = pd.DataFrame({"source": table["source"], "null": table["null"], "source_size": sizes, "target": target, "blocks": blocks, "passes": passes, "rest": np.maximum(target - passes * sizes, 0.0)})
    of_source = written(spark.createDataFrame(of_source, "source string, null boolean, source_size long, target double, blocks int, passes long, rest double"))

    block = F.pmod(F.col("order"), F.col("blocks")).cast("int").alias("block")
    own = ["source", "null", "block"]
    by = Window.partitionBy("source", "null").orderBy(F.xxhash64("source", "block", F.lit(seed + 1)), "block")
    placed = facts.join(of_source, ["source", "null"]).select("source", "null", "size", "order", "passes", "rest", block)
    drawn = (
        placed.groupBy(*own).agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("passes", "rest")))
        .withColumns({"rank": F.row_number().over(by) - 1, "upto": F.sum("words").over(by), "n": F.count(F.lit(1)).over(Window.partitionBy("source", "null"))})
        .withColumns({"whole": F.col("upto") <= F.col("rest"), "part": F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")), F.col("rest") - F.col("upto") + F.col("words"))})
        .select(*own, "rank", "n", "passes", "whole", "part")
    )
    drawn = written(drawn)
    quota = drawn.groupBy("source", "null").agg((F.max("passes") * F.max("n") + F.count(F.when(F.col("whole") | F.col("part").isNotNull(), 1))).alias("q")).toPandas().sort_values(["null", "source"])
    ends = split(quota["q"].to_numpy(np.int64), shards, seed).cumsum(axis=0).T
    bounds = written(spark.createDataFrame(pd.DataFrame({"source": quota["source"], "null": quota["null"], "ends": ends.tolist()}), "source string, null boolean, ends array<long>"))
    shard = lambda draw: F.size(F.filter("ends", lambda e: e <= draw))
    draws = drawn.join(bounds, ["source", "null"]).select(
        *own, "part",
        F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda p: shard(p * F.col("n") + F.col("rank")))).otherwise(F.array().cast("array<int>")).alias("all"),
        shard(F.col("passes") * F.col("n") + F.col("rank")).alias("last"), "whole",
    )
    draws = written(draws.join(of_source.select("source", "null", "source_size", "target"), ["source", "null"]))
    # of blocks that are drawn in part: how many of each (hash, size) are drawn, as rows that agree in both are alike
    part = draws.filter("part is not null").select(*own, "part")
    chosen = placed.join(part, own).select(F.xxhash64(*own).alias("block_key"), "size", "order", "part").groupBy("block_key").applyInPandas(part_of_block, "block_key long, order long, size long, times long")
    chosen = written(chosen)
    full = sized.join(of_source.select("source", "null", "blocks"), ["source", "null"]).select("row", "source", "null", "size", "order", block).join(draws, own)
    keyed = full.withColumn("block_key", F.xxhash64(*own)).withColumn("wanted", F.col("part").isNotNull())
    among = Window.partitionBy("block_key", "order", "size").orderBy("order")
    partly = keyed.filter("wanted").join(chosen, ["block_key", "order", "size"], "left").withColumn("more", F.row_number().over(among) <= F.coalesce("times", F.lit(0).cast("long"))).drop("times")
    both = keyed.filter("not wanted").withColumn("more", F.col("whole")).unionByName(partly)
    took = F.when(F.col("more"), F.concat("all", F.array("last"))).otherwise(F.col("all"))
    return both.select("row", F.struct("size", "source_size", "target", took.alias("shards"), "order").alias("mix"))


def shards(docs: DataFrame, **how) -> DataFrame:
    """One row for each time the mix takes a document: its own columns, grouped by shard and shuffled within it. A shard is written in as many parts
    as its documents need, PARTS at least."""
    parts = max(PARTS, docs.count() // (how.get("shards", SHARDS) * DOCS_A_PART))
    each = plan(docs, **how).select("row", "mix.order", F.posexplode("mix.shards").alias("copy", "shard")).select("row", "shard", F.xxhash64("order", "copy").alias("at"))
    return each.repartition(F.col("shard"), F.pmod("at", F.lit(parts))).sortWithinPartitions("shard", "at").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    planned = plan(docs.select("doc_id", "source", "text"))
    return planned.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.size("mix.shards")).cast("long").alias("taken"), F.col("mix.shards").alias("shards"))
