"""Streams over the events tape, read to their end, against the batch's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import folder, written
from ..operators import model, prepare
from ..streaming import stream
from . import dataset, tapes
from .tapes import EVENT_BARS, TICKS_E

SLICES = 6
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape in a folder of its own, a file for each of ``SLICES`` equal spans of time, one after the other, and a stream that reads a
    file a batch: state and watermark go from batch to batch, and a batch is the largest part of a symbol that is held."""
    path = folder(spark, "ticks")
    ticks = written(tapes.tape_events(spark, sf_dir), "tape")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = ticks.agg(F.min(at), F.max(at)).first()
    span = ((hi or 0) - (lo or 0)) // SLICES + 1
    for k in range(SLICES):
        begin = (lo or 0) + k * span
        ticks.filter((at >= begin) & (at < begin + span)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(out: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    path = folder(spark, "stream")
    q = out.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def stream_time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars that the watermark has closed."""
    bars = drained(stream.stream_time_bars(staged(spark, sf_dir)), spark)
    return bars.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return drained(stream.stream_dollar_bars(staged(spark, sf_dir)), spark)


def stream_dollar_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).select("symbol", "seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest scored bar of each symbol, batch by batch: here the side of the bar's range that its close is on."""
    path, out = folder(spark, "bars"), folder(spark, "signals")
    _bars(spark, sf_dir).write.parquet(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    score = lambda df: df.withColumn("signal", F.when(F.col("close") * 2 > F.col("high") + F.col("low"), 1).when(F.col("close") * 2 < F.col("high") + F.col("low"), -1).otherwise(0))
    writer = stream.stream_signals(source, score, lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n}"))
    writer.option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/*").groupBy("symbol").agg(F.max_by(F.struct("seq", "signal"), "seq").alias("r")).select("symbol", "r.*")


def stream_dollar_bars_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the ticks that the watermark, an hour behind the newest, has passed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bars = drained(stream.stream_dollar_bars(staged(spark, sf_dir), late="1 hour"), spark)
    return bars.select("symbol", "seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


def streamed_bars(bars: DataFrame) -> DataFrame:
    """Bars of a table as a stream of ``SLICES`` batches, in order of seq."""
    spark, path = bars.sparkSession, folder(bars.sparkSession, "bars")
    bars = written(bars.select(*(x.split()[0] for x in stream.BARS.split(", "))), "all-bars")
    last = bars.agg(F.max("seq")).first()[0] or 0
    for k in range(SLICES):
        bars.filter((F.col("seq") > last * k // SLICES) & (F.col("seq") <= last * (k + 1) // SLICES)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars of the tape with the features that the stream gives them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return drained(stream.stream_features(streamed_bars(tapes.event_bars(spark, sf_dir))), spark)


def with_model(classifier, matrices: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The score of ``stream_signals`` for bars with features: complete rows, scaled and rotated by their symbol's matrices, and classified."""

    def run(rows: DataFrame) -> DataFrame:
        ready = dataset.rotate(rows.na.drop(subset=prepare.FEATURES), matrices)
        return model.score(classifier.transform(ready)).select("symbol", "seq", "signal", "prob")

    return run


def scored_stream(bars: DataFrame, classifier, matrices: DataFrame) -> DataFrame:
    """symbol, seq, action, conviction of the newest bar of each symbol after a stream of bars has been scored to its end."""
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    featured, out = drained(stream.stream_features(streamed_bars(bars)), spark), folder(spark, "signals")
    writer = stream.stream_signals(streamed_rows(featured), with_model(classifier, matrices), lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/{n}"))
    writer.option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return model.latest_signals(spark.read.parquet(f"{out}/*"))


def streamed_rows(rows: DataFrame) -> DataFrame:
    spark, path = rows.sparkSession, folder(rows.sparkSession, "rows")
    rows.repartition(SLICES).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
STREAMS = {
    "stream_time_bars": (stream_time_bars, f"""WITH {TICKS_E}, hours AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)
SELECT symbol, {TS}, open, high, low, close, volume FROM hours WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)"""),
    "stream_dollar_bars": (stream_dollar_bars, f"{EVENT_BARS} SELECT symbol, seq, {TS}, open, high, low, close, volume FROM bars"),
    "stream_dollar_bars_timed": (stream_dollar_bars_timed, f"""{EVENT_BARS} SELECT symbol, seq, {TS}, open, high, low, close, volume FROM bars
WHERE date_trunc('hour', bars.ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)"""),
    "stream_signals": (stream_signals, f"""{EVENT_BARS}, l AS (SELECT symbol, max(seq) AS seq FROM bars GROUP BY 1)
SELECT symbol, seq, CASE WHEN close * 2 > high + low THEN 1 WHEN close * 2 < high + low THEN -1 ELSE 0 END AS signal FROM bars JOIN l USING (symbol, seq)"""),
}
