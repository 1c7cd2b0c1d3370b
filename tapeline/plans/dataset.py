"""The dataset build: bars, features, barriers and the fractional close, then split, embargo, scaling and rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from ..functions.windows import in_chunks
from ..operators import barriers, features, prepare
from ..operators.prepare import FEATURES


def with_features(bars: DataFrame) -> DataFrame:
    """Bars with the four microstructure features; null where a window isn't full. Chunks of a symbol are windowed side by side."""
    flow = in_chunks(bars, lambda part: features.kyles_lambda(features.amihud(features.vpin(part))).drop("buy", "sell", "imbalance"), features.CHUNK, before=50)
    return features.sadf(flow.select(*bars.columns, "vpin", "amihud", "kyles_lambda"))


def fractional_close(bars: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """symbol, seq, close_ffd: each symbol's close differenced by the least d that makes it stationary on ``fitted_on`` (the grid has nine
    values, so there are at most ten differences to take)."""
    best = written(features.min_ffd(fitted_on), "min-ffd")
    out = None
    for d in sorted(r["d"] for r in best.select("d").distinct().collect()):
        of = features.ffd(bars.select("symbol", "seq", "close").join(best.filter(F.col("d") == d).select("symbol"), "symbol", "left_semi"), d)
        of = of.select("symbol", "seq", F.col("ffd").alias("close_ffd"))
        out = of if out is None else out.unionByName(of)
    return out if out is not None else bars.select("symbol", "seq", F.lit(None).cast("double").alias("close_ffd"))


def build(bars: DataFrame, fit_on: str = "all") -> tuple[DataFrame, DataFrame]:
    """(rows, matrices). Rows: symbol, seq, ts, open .. volume, optimal_pt, optimal_sl, close_ffd, pca_1 .. pca_4, split; complete ones only.

    d of the fractional close is fitted on all bars of a symbol or on its train side (``fit_on`` is ``all`` or ``train``). Scaler and
    rotation are fitted on the train side; the first rows of the test side are left out. Bars are written once and read by each step.
    """
    bars = written(bars, "bars")
    rows = written(barriers.rolling_barriers(written(with_features(bars), "features")), "bars-with-barriers")
    if fit_on == "train":
        cut = prepare.chrono_split(prepare.complete_rows(rows)).filter("split = 'train'").groupBy("symbol").agg(F.max("seq").alias("last"))
        fitted_on = bars.join(cut, "symbol").filter("seq <= last").drop("last")
    else:
        fitted_on = bars
    rows = written(prepare.complete_rows(rows.join(fractional_close(bars, fitted_on), ["symbol", "seq"])), "complete")  # split and embargo read them seven times
    rows = written(prepare.embargo(prepare.chrono_split(rows)), "dataset")
    scaler = prepare.fit_scaler(rows)
    pca = prepare.fit_pca(prepare.feature_cov(prepare.apply_scaler(rows, scaler)))
    matrices = written(prepare.matrices(scaler, pca), "matrices")
    return rotate(rows, matrices), matrices


def rotate(rows: DataFrame, matrices: DataFrame) -> DataFrame:
    """Rows with features, scaled and rotated by their symbol's matrices; symbols without matrices go."""
    return prepare.apply_pca(prepare.apply_scaler(rows, matrices), matrices)


def newest(rows: DataFrame) -> DataFrame:
    """The row with the largest seq of each symbol, an aggregate."""
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "symbol")), "seq").alias("_row")).select("symbol", "_row.*")
