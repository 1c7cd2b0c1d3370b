"""Profit and stop barriers from Ornstein-Uhlenbeck fits and simulated paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.storage import written
from ..functions.windows import scanned

GRID = [0.5 + 0.25 * k for k in range(11)]


def rolling_slices(df: DataFrame, window: int = 60, step: int = 20) -> DataFrame:
    """Each row of (symbol, seq, close) once for every slice it lies in; ``start`` (rows from 0) is where the slice's result begins to
    hold: a multiple of ``step`` with a full window before it and a row of the symbol at it."""
    at = F.col("seq") - 1
    first = (F.floor(at / step) + 1) * step
    n = df.groupBy("symbol").agg(F.max("seq").alias("_n"))
    return df.join(n, "symbol").select("*", F.explode(F.sequence(first, at + window, F.lit(step).cast("bigint"))).alias("start")).filter((F.col("start") >= window) & (F.col("start") < F.col("_n"))).drop("_n")


def ou_fit(slices: DataFrame, window: int = 15) -> DataFrame:
    """symbol, start, phi, sigma of each slice; null without two usable points or without variance."""
    w = W.partitionBy("symbol", "start").orderBy("seq")
    frame = w.rowsBetween(-(window - 1), 0)
    z = F.when(F.count("close").over(frame) == window, F.avg("close").over(frame))
    rows = slices.withColumn("z", z).withColumn("x", F.lag("close").over(w) - F.lag("z").over(w)).filter("z is not null and x is not null")
    whole = W.partitionBy("symbol", "start")  # a slice; its order and place serve the fit and the rest alike
    rows = rows.withColumns({"c": F.covar_samp("close", "x").over(whole), "v": F.var_samp("x").over(whole)})
    rows = rows.withColumn("phi", F.when(F.col("v") > 0, F.col("c") / F.col("v")))
    rest = F.col("close") - F.col("z") - F.col("phi") * F.col("x")
    return rows.groupBy("symbol", "start", "phi").agg(F.stddev_samp(rest).alias("sigma"))


def barrier_grid(paths: DataFrame, sigma: float, grid: list[float] = GRID) -> DataFrame:
    """pt, sl, sharpe, best of every cell for paths (path_id, p array): the exit is the level hit first, else the last price."""
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("pt"), F.lit(b).alias("sl")) for a in grid for b in grid))).alias("cell")
    rows = paths.select("p", cells).select("p", "cell.*")
    up = F.array_position(F.transform("p", lambda x: x >= F.col("pt") * sigma), True)
    low = F.array_position(F.transform("p", lambda x: x <= -F.col("sl") * sigma), True)
    rows = rows.withColumns({"up": up, "low": low})
    pnl = F.when((F.col("up") > 0) & ((F.col("low") == 0) | (F.col("up") < F.col("low"))), F.col("pt") * sigma).when(F.col("low") > 0, -F.col("sl") * sigma).otherwise(F.element_at("p", -1))
    out = rows.withColumn("pnl", pnl).groupBy("pt", "sl").agg(F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"))
    out = out.select("pt", "sl", F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0).alias("sharpe"))
    return out.withColumn("best", F.row_number().over(W.orderBy(F.round(F.col("sharpe"), 12).desc(), "pt", "sl")) == 1)  # 121 rows


def best_for_phi(phis: DataFrame, n_paths: int = 10_000, length: int = 15, seed: int = 7) -> DataFrame:
    """phi, pt, sl: the best cell depends on phi alone, since paths and levels scale with sigma. One seeded noise matrix for all, so
    the result depends on neither partitions nor order. CPU-bound: distinct values are dealt evenly."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        eps = np.asfortranarray(kernels.noise(n_paths, length, seed))  # as the paths read it, step by step
        paths = np.zeros((length, n_paths))
        for f in frames:
            got = [kernels.best_barriers(kernels.ar_paths(x, eps, paths), np.array(GRID))[:2] for x in f["phi"]]
            yield pd.DataFrame({"phi": f["phi"].to_numpy(float), "pt": [g[0] for g in got], "sl": [g[1] for g in got]}, dtype=float)

    spark = phis.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a given number isn't coalesced
    return phis.select("phi").distinct().repartition(tasks, "phi").mapInPandas(run, "phi double, pt double, sl double")


def ar_barriers(noise: DataFrame, phis: list[float], grid: list[float] = GRID) -> DataFrame:
    """phi, pt, sl, sharpe, best of every cell for a few phis, over a table of noise (eps array, of one length) of any size.

    Paths are p_0 = 0, p_t = phi p_(t-1) + eps_t. Each batch gives its counts and sums of all cells, which add up.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            eps = np.stack([np.asarray(x, float) for x in f["eps"]]) if len(f) else np.empty((0, 1))
            if len(f):
                yield pd.concat([pd.DataFrame({"phi": phi, "cell": np.arange(len(grid) ** 2), "n": len(eps), **dict(zip("abcd", kernels.cell_sums(kernels.ar_paths(phi, eps), np.array(grid)).reshape(4, -1), strict=True))}) for phi in phis])

    sums = noise.filter("eps is not null").select("eps").mapInPandas(run, "phi double, cell int, n bigint, a double, b double, c double, d double")
    sums = sums.groupBy("phi", "cell").agg(*(F.sum(x).alias(x) for x in "nabcd"))
    levels = F.array(*(F.lit(float(g)) for g in grid))
    sums = sums.withColumns({"pt": F.get(levels, F.floor(F.col("cell") / len(grid)).cast("int")), "sl": F.get(levels, F.col("cell") % len(grid))})
    mean = (F.col("a") * F.col("pt") - F.col("b") * F.col("sl") + F.col("c")) / F.col("n")
    square = (F.col("a") * F.col("pt") * F.col("pt") + F.col("b") * F.col("sl") * F.col("sl") + F.col("d")) / F.col("n")
    sums = sums.withColumns({"m": mean, "v": square - mean * mean})
    out = sums.select("phi", "pt", "sl", F.when(F.col("v") > 1e-18, F.col("m") / F.sqrt("v")).otherwise(0.0).alias("sharpe"))
    return out.withColumn("best", F.row_number().over(W.partitionBy("phi").orderBy(F.round("sharpe", 12).desc(), "pt", "sl")) == 1)  # a few hundred rows a phi


def rolling_barriers(df: DataFrame, window: int = 60, step: int = 20, n_paths: int = 10_000, seed: int = 7, digits: int | None = None) -> DataFrame:
    """Adds optimal_pt and optimal_sl to rows (symbol, seq, close): a slice's result holds for the next ``step`` rows, failures take
    the one before, and the head has 2.0. ``digits`` rounds phi, so that fewer values are simulated."""
    fit = ou_fit(rolling_slices(df, window, step)).filter("phi is not null and sigma > 0")
    fit = fit.withColumn("phi", F.round("phi", digits)) if digits is not None else fit
    fit = written(fit, "ou-fits")  # its phis are simulated, and joined to what they give
    found = written(fit.join(best_for_phi(fit, n_paths, seed=seed), "phi").select("symbol", "start", "pt", "sl"), "barriers")  # simulated once
    rows = df.withColumn("start", F.floor((F.col("seq") - 1) / step) * step).join(found, ["symbol", "start"], "left")
    rows = scanned(rows, ["symbol"], lasts={"optimal_pt": F.col("pt"), "optimal_sl": F.col("sl")})
    return rows.fillna(2.0, ["optimal_pt", "optimal_sl"]).drop("start", "pt", "sl")
