"""How well signals classify the next bar's direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_symbol


def direction_truth(df: DataFrame) -> DataFrame:
    """Adds truth (next close higher) and pred (act above 0); a symbol's last row has no truth and goes."""
    nxt = F.lead("close").over(by_symbol())
    return df.withColumn("_next", nxt).filter("_next is not null").withColumns({"truth": (F.col("_next") > F.col("close")).cast("int"), "pred": (F.col("act") > 0).cast("int")}).drop("_next")


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    cell = lambda t, p: F.count(F.when((F.col("truth") == t) & (F.col("pred") == p), 1))
    return df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))


def binary_metrics(cells: DataFrame) -> DataFrame:
    """Adds precision, recall, accuracy and f1; 0 where the denominator is."""
    over = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cells.withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "accuracy": over(tp + tn, tp + tn + fp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)})


def log_loss(df: DataFrame, by: list[str], eps: float = 1e-15) -> DataFrame:
    """Mean log loss of the probability of a rise: prob for long signals, else 0, clipped."""
    p = F.greatest(F.least(F.when(F.col("signal") > 0, F.col("prob")).otherwise(0.0), F.lit(1 - eps)), F.lit(eps))
    return df.groupBy(*by).agg(F.avg(-F.when(F.col("truth") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def precision_delta(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """symbol, delta: precision of strategy a less that of b."""
    of = lambda s, name: metrics.filter(F.col("agent") == s).select("symbol", F.col("precision").alias(name))
    return of(a, "pa").join(of(b, "pb"), "symbol").select("symbol", (F.col("pa") - F.col("pb")).alias("delta"))


def prob_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """bin (from 1), n of equal bins between the least and the largest prob, the last one closed; empty bins have 0."""
    ends = df.agg(F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("prob") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    n = df.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
