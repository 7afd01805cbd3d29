"""Features of the whole market from index bars, the same for every code of a date."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import sdiv


@dataclass(frozen=True)
class Index:
    """Which returns of an index are features, over how many of its own bars, and over how many a deviation of its 20-bar return is taken (0: none)."""

    code: str
    name: str
    returns: tuple[int, ...]
    deviation: int = 0


def index_features(bars: DataFrame, indices: list[Index], small: str | None = None, large: str | None = None, over: int = 20) -> DataFrame:
    """bars: code, date, close -> date and <name>_return_<n>d, <name>_volatility_20d for each index, and size_spread_<over>d, the small index's return less the
    large one's. Dates are those of the first index that has bars; a bar before or without a price gives NULL. One row a date and index."""
    own = Window.partitionBy("code").orderBy("date")
    every = sorted({n for i in indices for n in i.returns} | {20, over})
    r = bars.filter(F.col("code").isin([i.code for i in indices])).select("code", "date", *((sdiv(F.col("close"), F.lag("close", n).over(own)) - 1).alias(f"r{n}") for n in every))
    widths = sorted({i.deviation for i in indices if i.deviation})
    r = r.withColumns({f"d{w}": F.stddev_samp("r20").over(own.rowsBetween(1 - w, 0)) for w in widths}) if widths else r
    wide = r.groupBy("date").agg(
        *(F.max(F.when(F.col("code") == i.code, F.lit(True))).alias(f"has_{i.name}") for i in indices), *(F.max(F.when(F.col("code") == i.code, F.col(f"r{n}"))).alias(f"{i.name}_return_{n}d") for i in indices for n in sorted({*i.returns, over})),
        *(F.max(F.when(F.col("code") == i.code, F.col(f"d{i.deviation}"))).alias(f"{i.name}_volatility_20d") for i in indices if i.deviation),
    )
    named = {i.name: i for i in indices}
    first = reduce(lambda a, b: F.when(a.isNotNull(), a).otherwise(b), (F.max(F.when(F.col(f"has_{n}"), F.lit(n))).over(Window.partitionBy()) for n in named))  # one row a date
    kept = wide.withColumn("_first", first).filter(reduce(lambda a, b: a | b, ((F.col("_first") == n) & F.col(f"has_{n}") for n in named)))
    spread = [(F.col(f"{small}_return_{over}d") - F.col(f"{large}_return_{over}d")).alias(f"size_spread_{over}d")] if small and large else []
    return kept.select("date", *(f"{i.name}_return_{n}d" for i in indices for n in i.returns), *(f"{i.name}_volatility_20d" for i in indices if i.deviation), *spread)
