"""Probability of backtest overfitting by combinatorially symmetric cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import sequenced


#: Values of t that are numbered in one task.
RUN = 4096


def chunks(perf: DataFrame, s: int = 16) -> DataFrame:
    """Adds chunk (from 0) to (trial, t, ret): the distinct times in s runs, the first ones one longer."""
    times = perf.select("t").distinct()
    n = times.count()
    at = sequenced(times.withColumn("symbol", F.lit(0)), ["t"], F.floor(F.col("t") / RUN)).select("t", (F.col("seq") - 1).alias("i"))
    long, width = n % s, n // s
    edge = long * (width + 1)
    chunk = F.when(F.col("i") < edge, F.floor(F.col("i") / (width + 1))).otherwise(long + F.floor((F.col("i") - edge) / max(width, 1)))
    return perf.join(at.select("t", chunk.cast("int").alias("chunk")), "t")


def combinations(spark: SparkSession, s: int = 16) -> DataFrame:
    """mask: every choice of s/2 of s chunks, as bits."""
    return spark.range(1 << s).filter(F.bit_count("id") == s // 2).select(F.col("id").alias("mask"))


def pbo_logits(perf: DataFrame, s: int = 16) -> DataFrame:
    """mask, trial (best in sample), omega, logit of its rank out of sample.

    Sums by (chunk, trial) are taken once, of returns less the trial's mean; every choice then adds at most s rows a trial. The masks
    are a constant table of C(s, s/2) rows.
    """
    spark = perf.sparkSession
    mean = perf.groupBy("trial").agg(F.avg("ret").alias("mean"))
    rows = chunks(perf, s).join(mean, "trial").withColumn("x", F.col("ret") - F.col("mean"))
    part = rows.groupBy("trial", "mean", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("a"), F.sum(F.col("x") * F.col("x")).alias("b"))
    packed = part.groupBy("trial", "mean").agg(F.collect_list(F.struct("chunk", "n", "a", "b")).alias("c"))  # s entries
    both = packed.join(F.broadcast(combinations(spark, s)))
    inside = F.expr("filter(c, e -> shiftright(mask, e.chunk) & 1 = 1)")
    outside = F.expr("filter(c, e -> shiftright(mask, e.chunk) & 1 = 0)")

    def sharpe(c):
        total = lambda k: F.aggregate(c, F.lit(0.0), lambda acc, e: acc + e[k])
        n, a, b = total("n"), total("a"), total("b")
        return (a / n + F.col("mean")) / (F.sqrt(F.greatest(b / n - (a / n) * (a / n), F.lit(0.0))) + 1e-8)

    both = both.select("mask", "trial", F.round(sharpe(inside), 12).alias("is_sharpe"), F.round(sharpe(outside), 12).alias("oos_sharpe"))
    w = W.partitionBy("mask")
    ranked = both.select(
        "mask", "trial", F.row_number().over(w.orderBy(F.desc("is_sharpe"), "trial")).alias("k"), F.count(F.lit(1)).over(w).alias("n"),
        (F.rank().over(w.orderBy("oos_sharpe")) + (F.count(F.lit(1)).over(W.partitionBy("mask", "oos_sharpe")) - 1) / 2).alias("rank"),
    ).filter("k = 1")
    omega = F.col("rank") / (F.col("n") + 1)
    return ranked.select("mask", "trial", omega.alias("omega"), F.log(omega / (1 - omega)).alias("logit"))


def pbo(logits: DataFrame) -> DataFrame:
    return logits.agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("combos"))
