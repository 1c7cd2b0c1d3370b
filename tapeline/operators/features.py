"""Microstructure features and fractional differences of bars (symbol, seq from 1, close, volume)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.storage import written
from ..functions.windows import by_symbol, rolling, scanned, with_halo

CHUNK = 20_000  # rows of a symbol that one helper call sees, besides the halo


def volume_imbalance(df: DataFrame) -> DataFrame:
    """Tick rule: all volume buys after a rise and sells after a fall, half each without a change; none on the first bar."""
    d = F.col("close") - F.lag("close").over(by_symbol())
    side = lambda up: F.when(up, F.col("volume")).when(d == 0, F.col("volume") / 2).otherwise(0.0)
    return df.withColumns({"buy": side(d > 0), "sell": side(d < 0)}).withColumn("imbalance", F.abs(F.col("buy") - F.col("sell")))


def vpin(df: DataFrame, window: int = 50) -> DataFrame:
    out = volume_imbalance(df)
    c = lambda name: rolling(F.sum(name), F.col(name), window)
    return out.withColumn("vpin", c("imbalance") / c("volume"))


def _returns(df: DataFrame) -> DataFrame:
    r = F.col("close") / F.lag("close").over(by_symbol()) - 1
    return df.withColumn("_r", r / (F.col("close") * F.col("volume") + 1e-8))


def amihud(df: DataFrame, window: int = 50) -> DataFrame:
    out = _returns(df).withColumn("_r", F.abs("_r"))
    return out.withColumn("amihud", rolling(F.avg("_r"), F.col("_r"), window)).drop("_r")


def kyles_lambda(df: DataFrame, window: int = 50) -> DataFrame:
    return _returns(df).withColumn("kyles_lambda", rolling(F.avg("_r"), F.col("_r"), window)).drop("_r")


def df_tstat(df: DataFrame, points: int = 31) -> DataFrame:
    """Dickey-Fuller t of the last ``points`` closes of each row, from running sums of frames; 0 for degenerate ones."""
    w = by_symbol()
    out = df.withColumns({"_x": F.lag("close").over(w), "_d": F.col("close") - F.lag("close").over(w)})
    m = points - 1
    frame = w.rowsBetween(-(m - 1), 0)
    sxx, syy = F.regr_sxx("_d", "_x").over(frame), F.regr_syy("_d", "_x").over(frame)
    sxy = F.regr_sxy("_d", "_x").over(frame)
    out = out.withColumns({"_n": F.count("_x").over(frame), "_sxx": sxx, "_syy": syy, "_sxy": sxy})
    ssr = F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")
    se = F.sqrt(ssr / (m - 2) / F.col("_sxx"))
    t = F.when((F.col("_sxx") < 1e-10) | (ssr < 1e-10) | (se < 1e-10), 0.0).otherwise(F.col("_sxy") / F.col("_sxx") / se)
    return out.withColumn("df_tstat", F.when(F.col("_n") == m, t)).drop("_x", "_d", "_n", "_sxx", "_syy", "_sxy")


def _chunked(df: DataFrame, before: int, fn, name: str) -> DataFrame:
    """Adds a column that fn(closes of a chunk with its halo) gives; chunks of a symbol are groups of their own."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        got = fn(f["close"].to_numpy(float))
        f = f.assign(**{name: pd.Series(got, index=f.index).astype(object).where(~np.isnan(got), None)})
        return f[f["own"]].drop(columns=["own", "chunk"])

    size = max(CHUNK, before)
    return with_halo(df, size, before).groupBy("symbol", "chunk").applyInPandas(run, f"{kinds}, {name} double")


def sadf(df: DataFrame, min_len: int = 30, window: int = 100) -> DataFrame:
    """Supremum of Dickey-Fuller t's over backward-expanding windows; null for the first ``window`` rows."""
    return _chunked(df, window, lambda y: kernels.sadf(y, min_len, window), "sadf")


def ffd(df: DataFrame, d: float, thres: float = 1e-4, narrow: int = 64) -> DataFrame:
    """Fractional difference of the forward-filled close; null for the first rows. Few weights stay in SQL, many are a convolution."""
    w = kernels.ffd_weights(d, thres)
    rows = scanned(df, ["symbol"], lasts={"_fill": F.col("close")}).withColumn("close", F.col("_fill")).drop("_fill").filter("close is not null").select(df.columns)
    if len(w) - 1 > narrow:
        return _chunked(rows, len(w) - 1, lambda y: kernels.ffd(y, w), "ffd")
    past = F.collect_list("close").over(by_symbol().rowsBetween(-(len(w) - 1), 0))
    weights = F.array(*(F.lit(x) for x in reversed(w)))
    dot = F.aggregate(F.zip_with("_past", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("_past", past).withColumn("ffd", F.when(F.size("_past") == len(w), dot)).drop("_past")


def adf_test(df: DataFrame, d_grid: list[float], thres: float = 1e-4, lag: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """symbol, d, n, t, lag, p of the augmented Dickey-Fuller test on each fractional difference. The lag has the least AIC, or is given.
    Differences with 30 values or fewer have no test.

    Rows (symbol, seq from 1 without gaps, close) are dealt to chunks with a halo. A chunk gives the moments of its rows of the regressions
    with all lags, which add up over chunks in a sum by element; what is solved is one small matrix a symbol and d. Missing closes take
    the one before.
    """
    weights = {float(d): kernels.ffd_weights(d, thres) for d in d_grid}
    sizes = df.groupBy("symbol").agg(F.max("seq").alias("_rows"))
    longest = sizes.agg(F.max("_rows")).first()[0] or 0
    least, most = min(map(len, weights.values())), max(map(len, weights.values()))
    before = most + max(kernels.adf_lags(max(longest - least + 1, 3)), lag or 0) + 2
    kind = df.schema["symbol"].dataType.simpleString()

    def moments(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        x, at, out = f["close"].to_numpy(float), f["seq"].to_numpy(np.int64) - 1, []
        own = f["own"].to_numpy(bool)
        for d, w in weights.items():
            n = int(f["_rows"].iat[0]) - len(w) + 1
            if n <= 30:
                continue
            lags = kernels.adf_lags(n) if lag is None else lag
            y = kernels.ffd(x, w)[len(w) - 1 :]  # values of rows at[len(w) - 1:]
            head = y[: lags + 1] if at[0] == 0 else None
            out.append((f["symbol"].iat[0], d, n, kernels.adf_moments(y, lags, own[len(w) - 1 :]).ravel(), head))  # own by the row of the next change
        return pd.DataFrame(out, columns=["symbol", "d", "n", "m", "head"])

    def solve(frames):
        for f in frames:
            out = []
            for s, d, n, m, head in f[["symbol", "d", "n", "m", "head"]].itertuples(index=False):
                m = np.asarray(m, float)
                side = int(round(len(m) ** 0.5))
                t, k = kernels.adf_of_moments(m.reshape(side, side), np.asarray(head, float), lag)
                out.append((s, d, n, t, k, kernels.adf_pvalue(t)))
            yield pd.DataFrame(out, columns=["symbol", "d", "n", "t", "lag", "p"])

    rows = scanned(df.select("symbol", "seq", "close"), ["symbol"], lasts={"_close": F.when(~F.isnan("close"), F.col("close"))})
    rows = rows.select("symbol", "seq", F.col("_close").alias("close")).join(sizes, "symbol")
    parts = with_halo(rows, max(chunk, before), before).groupBy("symbol", "chunk").applyInPandas(moments, f"symbol {kind}, d double, n bigint, m array<double>, head array<double>")
    parts = written(parts, "adf-moments")
    sums = parts.select("symbol", "d", "n", F.posexplode("m").alias("k", "x")).groupBy("symbol", "d", "n", "k").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("symbol", "d", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("m"))
    heads = parts.filter("head is not null").select("symbol", "d", "head")
    tested = sums.join(heads, ["symbol", "d"]).mapInPandas(solve, f"symbol {kind}, d double, n bigint, t double, lag bigint, p double")
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(len(w)).alias("w")) for d, w in weights.items()))).alias("g")
    all_ = sizes.select("symbol", "_rows", each).select("symbol", "g.d", F.greatest(F.col("_rows") - F.col("g.w") + 1, F.lit(0)).cast("bigint").alias("n"))
    return all_.join(tested.drop("n"), ["symbol", "d"], "left").select("symbol", "d", "n", "t", "lag", "p")


D_GRID = [k / 10 for k in range(1, 10)]


def min_ffd(df: DataFrame, d_grid: list[float] = D_GRID, alpha: float = 0.05, thres: float = 1e-4) -> DataFrame:
    """symbol, d: the smallest d whose difference passes the test, else 1."""
    return adf_test(df, d_grid, thres).groupBy("symbol").agg(F.coalesce(F.min(F.when(F.col("p") < alpha, F.col("d"))), F.lit(1.0)).alias("d"))
