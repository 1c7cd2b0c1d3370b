"""Sources and sinks: configs, pages, wide tables, tapes, datasets, fitted matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG = "tickers array<string>, start_date string, end_date string, interval string, transaction_fee_percent double, data_window_days bigint"
SYMBOL = r"^[\^a-zA-Z0-9_.-]+$"  # fixed value: characters of a symbol


def read_universe(spark: SparkSession, paths: str | list[str], days: int = 730, fee: float = 0.0005) -> DataFrame:
    """symbol, days, fee and dates of every ticker in the run configs (JSON files)."""
    df = spark.read.schema(CONFIG).option("multiLine", True).json(paths)
    return universe(df, days, fee)


def universe(configs: DataFrame, days: int = 730, fee: float = 0.0005) -> DataFrame:
    return configs.select(
        F.explode("tickers").alias("symbol"), "start_date", "end_date", "interval",
        F.coalesce("transaction_fee_percent", F.lit(fee)).alias("fee"), F.coalesce("data_window_days", F.lit(days)).alias("days"),
    )


def normalize_pages(df: DataFrame) -> DataFrame:
    """Pages of [epoch_ms, o, h, l, c, v] arrays to typed rows; rows that pages share are there once, per (symbol, ts)."""
    rows = df.select("symbol", F.explode("page").alias("r"))
    names = ("open", "high", "low", "close", "volume")
    rows = rows.select("symbol", to_ntz(F.timestamp_millis(F.col("r")[0].cast("bigint"))).alias("ts"), *(F.col("r")[k + 1].alias(n) for k, n in enumerate(names)))
    return rows.dropDuplicates(["symbol", "ts"])


def wide_to_long(df: DataFrame, symbols: list[str], ts: str = "ts") -> DataFrame:
    """Columns <symbol>_<field> to rows (symbol, ts, open .. volume); symbols without columns and rows without a close are left out."""
    fields = ("open", "high", "low", "close", "volume")
    there = [s for s in symbols if all(f"{s}_{f}" in df.columns for f in fields)]
    each = F.array(*(F.struct(F.lit(s).alias("symbol"), *(F.col(f"`{s}_{f}`").cast("double").alias(f) for f in fields)) for s in there))
    return df.select(ts, F.explode(each).alias("r")).select("r.symbol", ts, *(f"r.{f}" for f in fields)).filter("close is not null")


def valid_symbols(df: DataFrame, col: str = "symbol") -> DataFrame:
    """The base name of each symbol; rows with other characters than the allowed ones go."""
    return df.withColumn(col, F.regexp_extract(col, r"([^/\\]*)$", 1)).filter(F.col(col).rlike(SYMBOL))


def lookback(df: DataFrame, days: int) -> DataFrame:
    """Rows of each symbol's last ``days`` days; the newest row of a symbol is an aggregate, joined back."""
    last = df.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return df.join(last, "symbol").filter(F.col("ts") >= F.col("_last") - F.expr(f"interval {int(days)} days")).drop("_last")


def to_ntz(col: Column) -> Column:
    return col.cast(T.TimestampNTZType())


def coverage(universe: DataFrame, bars: DataFrame, min_rows: int) -> DataFrame:
    """symbol, n, reason of requested symbols with no rows or too few."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    out = universe.select("symbol").distinct().join(n, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.filter(F.col("n") < min_rows).withColumn("reason", F.when(F.col("n") == 0, "no data").otherwise("too few rows"))


def time_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV per symbol and time window; ``seq`` orders ticks of equal time."""
    at = F.struct("ts", "seq")
    out = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def write_dataset(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A folder for each split and symbol; ``kind`` is ``parquet`` or ``csv`` (with a header)."""
    df.write.partitionBy("split", "symbol").mode("overwrite").option("header", True).format(kind).save(path)


def read_dataset(spark: SparkSession, path: str, required: list[str], min_rows: int = 20, kind: str = "parquet", schema: str | T.StructType | None = None) -> DataFrame:
    """Complete rows of a dataset that has the required columns; symbols with fewer than ``min_rows`` are left out. CSV needs a schema."""
    reader = spark.read.format(kind).option("header", True)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if missing := set(required) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = df.na.drop()
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "split"))
    return df.withColumn("_n", n).filter(F.col("_n") >= min_rows).drop("_n")


def write_matrices(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
