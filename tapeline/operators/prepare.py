"""Datasets: complete rows, split, embargo, scaling and rotation fitted on the train side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import nth_row

FEATURES = ["vpin", "amihud", "kyles_lambda", "sadf"]


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop()


def chrono_split(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Adds split: train before the time of row int(ratio n) of the symbol, test from it on. That row is found in counts by day."""
    cut = nth_row(df, lambda n: F.floor(n * ratio), F.to_date("ts")).select("symbol", F.col("nth_ts").alias("_cut"))
    return df.join(cut, "symbol").withColumn("split", F.when(F.col("ts") < F.col("_cut"), "train").otherwise("test")).drop("_cut")


def embargo(df: DataFrame, rows: int = 60) -> DataFrame:
    """Drop the first rows of a test side that has more than ``rows``."""
    last = nth_row(df.filter("split = 'test'"), lambda n: F.when(n > rows, rows - 1).otherwise(-1), F.to_date("ts"))
    out = df.join(last.select("symbol", F.col("nth_seq").alias("_last")), "symbol", "left")
    return out.filter((F.col("split") == "train") | F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")


def fit_scaler(df: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """symbol, mean, scale of the train side; population deviation, 1 where it is 0."""
    sd = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return df.filter("split = 'train'").groupBy("symbol").agg(F.array(*(F.avg(c) for c in cols)).alias("mean"), F.array(*(sd(c) for c in cols)).alias("scale"))


def apply_scaler(df: DataFrame, fitted: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    out = df.join(fitted.select("symbol", "mean", "scale"), "symbol")
    return out.withColumns({c: (F.col(c) - F.col("mean")[k]) / F.col("scale")[k] for k, c in enumerate(cols)}).drop("mean", "scale")


def feature_cov(df: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """symbol and cov_i_j (sample covariance) of the train side of scaled features, i <= j."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.filter("split = 'train'").groupBy("symbol").agg(*(F.covar_samp(cols[i], cols[j]).alias(f"cov_{i}_{j}") for i, j in pairs))


def _rotated(acc: Column, p: Column, q: Column, n: int) -> Column:
    """The struct (a, v) of a symmetric matrix and its rotations after the rotation that makes the element p, q zero (Jacobi)."""
    a = lambda i, j: F.get(acc["a"], i * n + j)
    tau = (a(q, q) - a(p, p)) / (2 * a(p, q))
    t = F.when(a(p, q) == 0, 0.0).otherwise(F.when(tau < 0, -1.0).otherwise(1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau)))
    with_t = F.transform(F.array(t), lambda t: F.struct((1 / F.sqrt(1 + t * t)).alias("c"), (t / F.sqrt(1 + t * t)).alias("s")))

    def turned(m: Column, r: Column, columns: bool) -> Column:
        def element(x: Column, k: Column) -> Column:
            i, j = F.floor(k / n).cast("int"), (k % n).cast("int")
            here = j if columns else i
            at = lambda z: F.get(m, i * n + z) if columns else F.get(m, z * n + j)
            return F.when(here == p, r["c"] * at(p) - r["s"] * at(q)).when(here == q, r["s"] * at(p) + r["c"] * at(q)).otherwise(x)

        return F.transform(m, element)

    def applied(r: Column) -> Column:
        half = F.transform(F.array(F.struct(turned(acc["a"], r, True).alias("m"))), lambda h: turned(h["m"], r, False))
        return F.struct(F.get(half, F.lit(0)).alias("a"), turned(acc["v"], r, True).alias("v"))

    return F.get(F.transform(with_t, applied), F.lit(0))


def fit_pca(cov: DataFrame, n: int = len(FEATURES), sweeps: int = 8) -> DataFrame:
    """symbol, components (rows by falling eigenvalue, largest loading positive), explained, from a row of covariances a symbol.

    Eigenvectors come from Jacobi rotations, a fold over all pairs of columns, ``sweeps`` times: plain expressions. Symbols with a
    covariance of null (a train side of one row) have no rotation.
    """
    zero = F.lit(0.0)
    cell = lambda i, j: F.col(f"cov_{min(i, j)}_{max(i, j)}")
    start = F.struct(F.array(*(cell(i, j) for i in range(n) for j in range(n))).alias("a"), F.array(*(F.lit(float(i == j)) for i in range(n) for j in range(n))).alias("v"))
    turns = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(sweeps) for p in range(n) for q in range(p + 1, n)))
    done = cov.na.drop().withColumn("_r", F.aggregate(turns, start, lambda acc, r: _rotated(acc, r["p"], r["q"], n)))
    column = lambda k: F.array(*(F.get("_r.v", F.lit(i * n + k)) for i in range(n)))
    pairs = F.sort_array(F.array(*(F.struct(F.get("_r.a", F.lit(k * n + k)).alias("value"), column(k).alias("v")) for k in range(n))), asc=False)

    def signed(v: Column) -> Column:
        top = F.array_max(F.transform(v, F.abs))
        lead = F.get(F.filter(v, lambda x: F.abs(x) == top), F.lit(0))
        return F.transform(v, lambda x: F.when(lead < zero, -x).otherwise(x))

    done = done.withColumn("_p", pairs)
    return done.select("symbol", F.transform("_p", lambda x: signed(x["v"])).alias("components"), F.transform("_p", lambda x: x["value"]).alias("explained"))


def apply_pca(df: DataFrame, fitted: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """Adds pca_1.. to rows of scaled features (whose train mean is 0)."""
    out = df.join(fitted.select("symbol", "components"), "symbol")
    dot = lambda k: sum((F.col(c) * F.col("components")[k][j] for j, c in enumerate(cols)), F.lit(0.0))
    return out.withColumns({f"pca_{k + 1}": dot(k) for k in range(len(cols))}).drop("components")


def matrices(scaler: DataFrame, pca: DataFrame) -> DataFrame:
    """symbol, mean, scale, components, explained: what scoring needs."""
    return scaler.join(pca, "symbol")
