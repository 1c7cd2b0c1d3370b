"""Edge cases of sources, bars, labels and metrics on hand-made rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeline.operators import backtest, bars, labels, pbo, telemetry
from tapeline.sources import io


def ticks(spark, dv):
    rows = [("a", datetime(2024, 1, 1, 0, 0, 0), k + 1, 1.0 + k, 1.0, d) for k, d in enumerate(dv)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq bigint, price double, volume double, dv bigint")


def test_configs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tickers": ["X", "Y"], "transaction_fee_percent": 0.1}))
    (tmp_path / "b.json").write_text(json.dumps({"tickers": ["Z"], "data_window_days": 60}))
    got = {r.symbol: (r.fee, r.days) for r in io.read_universe(spark, str(tmp_path)).collect()}
    assert got == {"X": (0.1, 730), "Y": (0.1, 730), "Z": (0.0005, 60)}


def test_bars_need_a_full_window(spark):
    assert bars.dollar_bars(ticks(spark, [10] * 209)).count() == 0
    got = bars.dollar_bars(ticks(spark, [10] * 210)).orderBy("seq").collect()  # 2100 / 300 = 7: every tick ends a bar
    assert len(got) == 210
    got = bars.dollar_bars(ticks(spark, [10] * 211), divisor=100).orderBy("seq").collect()  # 21: three ticks a bar, the last is open
    assert len(got) == 70 and got[0].open == 1.0 and got[0].close == 3.0 and got[0].volume == 3.0
    assert bars.dollar_bars(ticks(spark, [10] * 211), warmup="skip").count() == 2


def test_dataset_round_trip(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 2).cast("string").alias("symbol"), F.when(F.col("id") < 40, "train").otherwise("test").alias("split"), F.col("id").cast("double").alias("close"))
    io.write_dataset(df, str(tmp_path / "d"))
    assert io.read_dataset(spark, str(tmp_path / "d"), ["close"], 20).count() == 40
    with pytest.raises(ValueError):
        io.read_dataset(spark, str(tmp_path / "d"), ["open"])


def test_labels_touch_and_horizon(spark):
    rows = [("a", 1, 100.0)] + [("a", k, 100.0) for k in range(2, 17)] + [("a", 17, 104.0), ("a", 18, 90.0)]
    df = spark.createDataFrame(rows, "symbol string, seq bigint, close double").withColumns({"optimal_pt": F.lit(2.0), "optimal_sl": F.lit(2.0)})
    got = [r.label for r in labels.triple_barrier(df).orderBy("seq").collect()]
    assert got[0] == 0 and got[1] == 1 and got[16] == -1 and got[17] == 0


def test_cagr_and_confusion(spark):
    d = spark.createDataFrame([(100.0, 121.0, "2020-01-01", "2022-01-01"), (100.0, 0.0, "2020-01-01", "2022-01-01"), (100.0, 5.0, "2020-01-01", "2020-01-01")], "a double, b double, s string, e string")
    got = [r.g for r in d.select(backtest.cagr(F.col("a"), F.col("b"), F.to_timestamp("s"), F.to_timestamp("e")).alias("g")).collect()]
    assert abs(got[0] - 0.1) < 1e-3 and got[1:] == [-1.0, 0.0]
    m = telemetry.binary_metrics(spark.createDataFrame([(0, 5, 0, 0)], "tp int, tn int, fp int, fn int")).first()
    assert (m.precision, m.recall, m.accuracy, m.f1) == (0.0, 0.0, 1.0, 0.0)


def test_pbo_of_a_dominant_trial(spark):
    df = spark.range(64).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("trial"), F.col("id").alias("t"))
    df = df.withColumn("ret", F.when(F.col("trial") == 2, 1.0).otherwise(0.0) + F.sin(F.col("t") * 7 + F.col("trial") * 3) / 10)
    got = pbo.pbo(pbo.pbo_logits(df, 8)).first()
    assert got.pbo == 0.0 and got.combos == 70


def test_matrices_round_trip_and_projection(spark, tmp_path):
    from tapeline.operators import prepare

    cols = ["a", "b", "c", "d"]
    df = spark.range(200).select(
        F.lit("x").alias("symbol"), F.col("id").alias("seq"), F.when(F.col("id") < 150, "train").otherwise("test").alias("split"),
        F.sin("id").alias("a"), (F.sin("id") * 2 + F.cos(F.col("id") * 3)).alias("b"), F.cos(F.col("id") * 5).alias("c"), F.lit(4.0).alias("d"),
    )
    scaler = prepare.fit_scaler(df, cols)
    scaled = prepare.apply_scaler(df, scaler, cols)
    pca = prepare.fit_pca(prepare.feature_cov(scaled, cols))
    io.write_matrices(prepare.matrices(scaler, pca), str(tmp_path / "m"))
    m = io.read_matrices(spark, str(tmp_path / "m"))
    row = m.first()
    assert row.scale[3] == 1.0 and row.explained == sorted(row.explained, reverse=True) and all(max(c, key=abs) > 0 for c in row.components)
    out = prepare.apply_pca(prepare.apply_scaler(df, m, cols), m, cols).filter("split = 'train'")
    assert abs(out.agg(F.corr("pca_1", "pca_2")).first()[0]) < 1e-9


def test_time_zone_free_lookback_and_pages(spark):
    pages = [("a", [[0.0, 1, 2, 0.5, 1.5, 10.0], [3_600_000.0, 1, 2, 0.5, 1.5, 10.0]]), ("a", [[3_600_000.0, 1, 2, 0.5, 1.5, 10.0], [864_000_000.0, 1, 1, 1, 1, 1.0]])]
    rows = io.normalize_pages(spark.createDataFrame([(s, [[float(x) for x in r] for r in p]) for s, p in pages], "symbol string, page array<array<double>>"))
    assert rows.count() == 3 and io.lookback(rows, 5).count() == 1
    assert dict(rows.dtypes)["ts"] == "timestamp_ntz"


def test_per_symbol_models(spark):
    from tapeline.operators import model

    df = spark.range(600).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("symbol"), F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("f"), (F.col("id") % 3).cast("int").alias("cls"))
    data = model.split_random(model.training_set(df, ["f"]))
    fitted = model.fit_per_symbol(data, ["f"], ["x"], trees=2, depth=2)
    out = model.score(fitted["x"].transform(data.filter("symbol = 'x'"))).first()
    assert abs(sum(out.probs) - 1) < 1e-9 and out.prediction in (0, 1, 2) and out.signal == out.prediction - 1
