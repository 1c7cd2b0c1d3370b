"""Triple-barrier labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_symbol


def triple_barrier(df: DataFrame, horizon: int = 15, atr_pct: float = 0.02, pt: str = "optimal_pt", sl: str = "optimal_sl") -> DataFrame:
    """Adds label: 1 if one of the next ``horizon`` closes reaches close + atr pt first, -1 if close - atr sl, else 0."""
    ahead = F.collect_list("close").over(by_symbol().rowsBetween(1, horizon))
    atr = F.col("close") * atr_pct
    rows = df.withColumns({"_a": ahead, "_up": F.col("close") + atr * F.col(pt), "_low": F.col("close") - atr * F.col(sl)})
    up = F.array_position(F.transform("_a", lambda x: x >= F.col("_up")), True)
    low = F.array_position(F.transform("_a", lambda x: x <= F.col("_low")), True)
    rows = rows.withColumns({"_u": up, "_l": low})
    hit = F.when((F.col("_u") > 0) & ((F.col("_l") == 0) | (F.col("_u") < F.col("_l"))), 1).when(F.col("_l") > 0, -1).otherwise(0)
    return rows.withColumn("label", hit).drop("_a", "_up", "_low", "_u", "_l")


def label_classes(df: DataFrame) -> DataFrame:
    return df.withColumn("cls", F.col("label") + 1)


def label_distribution(df: DataFrame) -> DataFrame:
    return label_classes(df).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
