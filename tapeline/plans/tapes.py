"""Tapes of the given tables: ticks (symbol, ts, seq, price, volume, dv in cents), and rule-based signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import written
from ..functions.windows import by_symbol, sequenced
from ..operators import bars
from ..sources import io


def tape_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five symbols whose length grows with the data."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = e.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), k.cast("double").alias("volume"), (F.round(F.col("value") * 100).cast("bigint") * k).alias("dv"))
    return sequenced(rows, ["ts", "event_id"], F.to_date("ts")).select("symbol", "ts", "seq", "price", "volume", "dv")


def tape_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each supplier, about 600 ticks each."""
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_quantity", *order)
    seq = F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)).cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), seq.alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("dv"),
    )


def as_bars(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol", "seq", "ts", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), "volume")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(bars.dollar_bars(tape_events(spark, sf_dir), chunk_rows=1_000_000), "bars")  # a symbol grows with the data; most queries read its bars more than once


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, numbered by time."""
    hours = io.time_bars(tape_events(spark, sf_dir)).select("symbol", "ts", "open", "high", "low", "close", "volume")
    return sequenced(hours, ["ts"], F.to_date("ts"))


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.dollar_bars(tape_lineitem(spark, sf_dir))


def signals(df: DataFrame) -> DataFrame:
    """Adds signal (side of the mean of the five closes before), prob, bet and fixed barriers."""
    before = F.avg("close").over(by_symbol().rowsBetween(-5, -1))
    signal = F.coalesce(F.signum(F.round(F.col("close") - before, 6)).cast("int"), F.lit(0))
    return df.withColumns({
        "signal": signal, "prob": 0.5 + (F.col("seq") % 50) / 100, "bet": (F.col("seq") % 11) / 10, "optimal_pt": F.lit(2.0), "optimal_sl": F.lit(2.0),
    })


TICKS_E = """ticks AS MATERIALIZED (
  SELECT event_type AS symbol, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, value AS price,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS volume, CAST(round(value * 100) AS BIGINT) * CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS dv
  FROM events WHERE value > 0)"""
TICKS_L = """ticks AS MATERIALIZED (
  SELECT l_suppkey AS symbol, l_shipdate AS ts, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq,
         l_extendedprice / l_quantity AS price, l_quantity AS volume, CAST(round(l_extendedprice * 100) AS BIGINT) AS dv
  FROM lineitem)"""
THRESHOLD = """summed AS (SELECT *, CAST(sum(dv) OVER (PARTITION BY symbol ORDER BY seq) AS BIGINT) AS run FROM ticks),
thr AS MATERIALIZED (SELECT *, coalesce(CASE WHEN seq >= 210 THEN run - coalesce(lag(run, 210) OVER (PARTITION BY symbol ORDER BY seq), 0) END,
         max(CASE WHEN seq = 210 THEN run END) OVER (PARTITION BY symbol)) AS bar_sum FROM summed)"""
BARS = THRESHOLD + """,
scan AS (
  SELECT symbol, seq, CAST(0 AS BIGINT) AS bar_id, dv AS cum, 300 * dv >= bar_sum AS breach FROM thr WHERE seq = 1 AND bar_sum IS NOT NULL
  UNION ALL
  SELECT t.symbol, t.seq, s.bar_id + CASE WHEN s.breach THEN 1 ELSE 0 END, CASE WHEN s.breach THEN 0 ELSE s.cum END + t.dv,
         300 * (CASE WHEN s.breach THEN 0 ELSE s.cum END + t.dv) >= t.bar_sum
  FROM scan s JOIN thr t ON t.symbol = s.symbol AND t.seq = s.seq + 1),
bars AS MATERIALIZED (
  SELECT symbol, bar_id + 1 AS seq, max(ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume
  FROM scan JOIN ticks USING (symbol, seq) GROUP BY symbol, bar_id HAVING bool_or(breach))"""
EVENT_BARS = f"WITH RECURSIVE {TICKS_E}, {BARS}"
LINEITEM_BARS = f"WITH RECURSIVE {TICKS_L}, {BARS}"
#: Ticks of the lineitem tape as bars, with signals.
SIGNALS = f"""{TICKS_L}, sig AS MATERIALIZED (
  SELECT symbol, seq, ts, price AS close, volume,
         coalesce(CAST(sign(round(price - avg(price) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6)) AS INTEGER), 0) AS signal,
         0.5 + (seq % 50) / 100 AS prob, (seq % 11) / 10 AS bet, 2.0 AS optimal_pt, 2.0 AS optimal_sl
  FROM ticks)"""
