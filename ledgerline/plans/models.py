"""Queries of trained models and of the features chosen for them. Training has no SQL; correlations have."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import sanitised
from ledgerline.operators import panel
from ledgerline.operators.boosting import Model, Rules, fit, out_of_fold
from ledgerline.operators.selection import correlations, select
from ledgerline.plans.catalogue import _NEW, _OLD, QUERIES, B, U, new_rows, old_rows, query, sup
from ledgerline.sources import bars, layout

_BYC = "over (partition by code order by date)"
_FEATURES = {
    "return_1d": f"close / lag(close) {_BYC} - 1", "return_5d": f"close / lag(close, 5) {_BYC} - 1", "gap": f"open / lag(close) {_BYC} - 1", "intraday": "close / open - 1", "range": "(high - low) / close",
    "mean_ratio": f"close / avg(close) {_BYC[:-1]} rows 19 preceding) - 1", "volume": "volume", "amount": "amount", "mean_price": "amount / volume",
}


def featured(spark: SparkSession, d: str) -> DataFrame:
    """Bars with nine features and the change from the close to the next open."""
    b = sup(spark, d)
    return sanitised(b.select("code", "date", *(F.expr(e.replace("lag(close) ", "lag(close, 1) ")).cast("double").alias(f) for f, e in _FEATURES.items()), (F.lead("open").over(panel.by_code()) / F.col("close") - 1).alias("label")), [*_FEATURES, "label"])


_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, count(*) filter (where {a} is not null and {b} is not null) as n, round(corr({a}, {b}), 6) + 0.0 as corr from f" for a, b in combinations(_FEATURES, 2))
query("feature_correlations", lambda spark, d: correlations(featured(spark, d), list(_FEATURES)), f"with {B}, f as (select {', '.join(f'{e} as {f}' for f, e in _FEATURES.items())} from b) {_PAIRS}")
query("selected_features", lambda spark, d: select(featured(spark, d), list(_FEATURES), "label", 0.6, parts=bars.parts(spark, d)))
_USED = ["return_1d", "return_5d", "gap", "intraday", "range", "mean_ratio"]
# a third of the dates comes before the first segment, so that each table size trains a few models
_GAP = Rules(loss="l2", rounds=4, depth=3, rate=0.3, bins=32, least=50, ridge=1.0)
query("boosted_out_of_fold", lambda spark, d: out_of_fold(featured(spark, d), _USED, "label", first=960, every=800, buffer=6, least=1000, rules=_GAP).select("code", "date", "label", F.col("score").alias("gb_gap_1d")))


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Trained with the absolute loss on the dates before 2000, calibrated on the last of them, then scored from the model's text as a daily run would: scores of the
    first half of 2000 times the slope, and the zero that they are sold at."""
    rows = featured(spark, d)
    past = rows.filter("date < date '2000-01-01'")
    model = Model.loads(fit(past, _USED, "label", rules=Rules(loss="l1", rounds=8, depth=3, rate=0.3, bins=32, least=50)).dumps())
    known = panel.calibration(model.predict(past).select("code", "date", "score", "label"), "score", "label", F.lit("2000-01-01").cast("date"))
    live = model.predict(rows.filter("date between date '2000-01-01' and date '2000-06-30'")).select("code", "date", "score")
    return live.crossJoin(known.select("slope", F.col("median").alias("zero"))).select("code", "date", (F.col("score") * F.col("slope")).alias("score"), "zero")


query("boosted_scores", _live)


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert into a bucketed table says and leaves; the table goes when that is known."""
    name = f"panel_{uuid.uuid4().hex}"
    layout.save(old_rows(spark, d), name, 8)
    said = layout.upsert(spark, name, new_rows(spark, d))
    left = spark.table(name).agg(F.count("volume").alias("n_volume"), F.count("extra").alias("n_extra"), F.round(F.sum("close"), 2).alias("total")).first()
    spark.sql(f"drop table {name}")
    return spark.createDataFrame([(said.rows, said.inserted, said.updated, *left)], "n_rows long, inserted long, updated long, n_volume long, n_extra long, total double")


query("bucketed_upsert", _bucketed,
      f"""with {U}, {_OLD}, {_NEW}, j as (select code, date, o.code is not null as was, n.code is not null as now, case when n.code is not null then n.close else o.close end as close, volume, extra from o full join n using (code, date))
      select count(*) as n_rows, count(*) filter (where not was) as inserted, count(*) filter (where was and now) as updated, count(volume) as n_volume, count(extra) as n_extra, round(sum(close), 2) + 0.0 as total from j""")  # fmt: skip
