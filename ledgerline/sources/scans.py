"""Scans: panels by codes, dates and columns, files of other formats, calendars, and what a catalogue holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["code", "date"]


def panel_scan(panel: DataFrame, codes: DataFrame | None = None, columns: list[str] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of the panel: keys and the columns asked for (None: all; an empty list: keys only), dates from start to end, both
    included, codes by a semi join. Filters and columns reach the scan. Unknown columns raise."""
    if columns is not None and (unknown := set(columns) - set(panel.columns)):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    rows = panel if columns is None else panel.select(*KEYS, *(c for c in columns if c not in KEYS))
    rows = rows if start is None else rows.filter(F.col("date") >= start)
    rows = rows if end is None else rows.filter(F.col("date") <= end)
    return rows if codes is None else rows.join(codes.select("code").distinct(), "code", "left_semi")


def label_scan(bars: DataFrame, start: Column, end: Column, rows_ahead: int) -> DataFrame:
    """Opens that labels of dates from start to end need: up to rows_ahead open days after end, or the last there is."""
    after = bars.select("date").distinct().filter(F.col("date") > end).orderBy("date").limit(rows_ahead)
    last = after.agg(F.coalesce(F.max("date"), end).alias("_last"))
    return bars.join(F.broadcast(last), (F.col("date") >= start) & (F.col("date") <= F.col("_last"))).select(*KEYS, "open")


def trading_bars(bars: DataFrame, flags: DataFrame, codes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Bars of the codes with a price to open at, from start to end, with is_st of the same day, 0 where no flag says otherwise. Dealt by code, so that what
    follows a code needs no further exchange."""
    own = panel_scan(bars, codes, [c for c in bars.columns if c not in KEYS], start, end).filter("open > 0")
    joined = own.join(flags.select(*KEYS, "is_st"), KEYS, "left").withColumn("is_st", F.coalesce(F.col("is_st").cast("int"), F.lit(0)))
    return joined.repartition("code").sortWithinPartitions(*KEYS)


def with_levels(rows: DataFrame, levels: list[DataFrame], key: str = "code") -> DataFrame:
    """rows with the columns of each level by the key, NULL where a level lacks it. A level that names a key twice would double rows; it raises."""
    from ledgerline.sources.layout import unique

    for level in levels:
        rows = rows.join(unique(level, [key]), key, "left")
    return rows


def label_bars(bars: DataFrame, codes: DataFrame, floor: Column, start: Column | None = None) -> DataFrame:
    """Opens and closes of the codes from start on, but never from before floor, whatever is asked for."""
    first = floor if start is None else F.greatest(start, floor)
    return panel_scan(bars, codes, ["open", "close"], first)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
    """A table of the catalogue, or, where there is none of the name, no rows: a source that has not come in yet takes nothing out."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def market_values(bars: DataFrame, values: DataFrame) -> DataFrame:
    """Bars with total and float market value, NULL where a day has none."""
    return bars.join(values.select(*KEYS, "total_mv", "circ_mv"), KEYS, "left")


def calendar_days(spans: DataFrame) -> DataFrame:
    """Every day of the spans (start, end), both included; none where end is before start."""
    return spans.filter("start <= end").select(F.explode(F.sequence("start", "end")).alias("date")).distinct()


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Codes stay strings, dates are parsed; a malformed row raises."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).option("mode", "FAILFAST").csv(path)


def json_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def columns_of(rows: DataFrame) -> DataFrame:
    """Position, name and type of each column."""
    return rows.sparkSession.createDataFrame([(i, c, k) for i, (c, k) in enumerate(rows.dtypes)], "position int, name string, type string")


def tables_of(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Names of tables and views that begin with the prefix."""
    return spark.sql("show tables").select(F.col("tableName").alias("name")).filter(F.startswith("name", F.lit(prefix)))


def encoded(rows: DataFrame, column: str, to: str) -> DataFrame:
    """The distinct values, each with its place in their order, from 0."""
    from pyspark.sql import Window

    return rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn(to, F.row_number().over(Window.orderBy(column)).cast("long") - 1)


def looked_up(rows: DataFrame, codes: DataFrame, key: str, value: str, unknown: int = -1) -> DataFrame:
    """A column from a small table of unique keys; unknown keys get the default."""
    return rows.join(codes.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(unknown).cast(codes.schema[value].dataType)))
