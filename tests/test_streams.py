"""Streams by event time, their features, and models that are saved."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.functions import kernels
from tapeline.functions.storage import folder
from tapeline.operators import bars, features, model, prepare
from tapeline.plans import dataset, streams
from tapeline.streaming import stream

START = dt.datetime(2024, 1, 1)


def ticks_of(spark, rows):
    """rows: (symbol, seq, seconds from the start, price, volume)."""
    full = [(s, q, START + dt.timedelta(seconds=t), float(p), float(v), round(p * 100) * int(v)) for s, q, t, p, v in rows]
    return spark.createDataFrame(full, "symbol string, seq bigint, ts timestamp_ntz, price double, volume double, dv bigint")


def played(spark, batches, late):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    path = folder(spark, "ticks")
    for b in batches:  # files are read in the order in which they were written
        ticks_of(spark, b).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(ticks_of(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return streams.drained(stream.stream_dollar_bars(source, rows=5, divisor=3, late=late), spark)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "seq", "ts", "open", "high", "low", "close", "volume").collect())


def test_ticks_within_the_watermark_are_put_in_order_and_later_ones_dropped(spark):
    rng = np.random.default_rng(1)
    rows = [("a", k + 1, 600 * k, 10 + float(rng.integers(0, 9)), int(rng.integers(1, 9))) for k in range(60)]
    rows += [("b", k + 1, 600 * k + 1, 20 + float(rng.integers(0, 9)), 2) for k in range(60)]
    first, second, third = (sorted((r for r in rows if lo <= r[2] < hi), key=lambda r: r[2]) for lo, hi in ((0, 12_000), (12_000, 24_000), (24_000, 40_000)))
    moved = first[-6:]  # up to an hour behind the newest of the second batch: still in time
    late = [("a", 999, 100, 50.0, 9)]  # hours behind the watermark: dropped
    got = played(spark, [first[:-6], moved[::-1] + second[:4][::-1], second[4:], late + third], "2 hours")
    end = max(r[2] for r in rows) - 7200
    want = bars.dollar_bars(ticks_of(spark, rows), rows=5, divisor=3)
    want = [r for r in rows_of(want) if (r[2] - START).total_seconds() // 3600 * 3600 + 3600 <= end]
    assert want and rows_of(got) == want


@pytest.fixture(scope="module")
def some_bars(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 700), ("b", 640), ("short", 90)):
        close = 100 + np.cumsum(rng.normal(size=n))
        rows += [(s, k + 1, START + dt.timedelta(hours=k), *(float(c),) * 4, float(rng.integers(1, 50))) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, stream.BARS)


def test_stream_features_are_those_of_the_batch(spark, some_bars):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    got = streams.drained(stream.stream_features(streams.streamed_bars(some_bars)), spark)
    want = dataset.with_features(some_bars)
    cols = ["symbol", "seq", *(F.round(F.col(c) * (1e6 if c in ("amihud", "kyles_lambda") else 1), 7).alias(c) for c in prepare.FEATURES)]
    a, b = (sorted(df.select(*cols).collect(), key=str) for df in (got, want))
    assert len(a) == 1430 and a == b


def test_saved_model_scores_alike_in_batch_and_stream(spark, some_bars):
    rows, matrices = dataset.build(some_bars)
    assert rows.count() > 100
    ready = rows.withColumn("cls", F.col("seq") % 3)
    pca = [f"pca_{k}" for k in range(1, 5)]
    fitted = model.fit_classifier(model.split_random(model.training_set(ready, pca)), pca, trees=2, depth=2)
    path = folder(spark, "model")
    fitted.save(path, matrices)
    loaded, stored = model.Classifier.load(spark, path)
    assert loaded.features == pca and sorted(map(str, stored.collect())) == sorted(map(str, matrices.collect()))
    a, b = (sorted((r["symbol"], r["seq"], *r["probs"]) for r in m.transform(ready).collect()) for m in (fitted, loaded))
    assert a == b
    newest = dataset.newest(prepare.complete_rows(dataset.with_features(some_bars)))
    want = model.latest_signals(model.score(loaded.transform(dataset.rotate(newest, stored))))
    got = streams.scored_stream(some_bars, loaded, stored)
    clean = lambda df: sorted((r["symbol"], r["seq"], r["action"], round(r["conviction"], 9)) for r in df.collect())
    assert clean(got) == clean(want) and len(clean(got)) == 2

    fitted.save(bare := folder(spark, "model"))
    assert model.Classifier.load(spark, bare)[1] is None


@pytest.mark.parametrize("fit_on", ["all", "train"])
def test_dataset_build_against_single_steps(spark, some_bars, fit_on):
    """The composed build, column by column against its operators on plain windows, and d fitted on the side that was asked for."""
    rng = np.random.default_rng(6)
    close = 500 + np.cumsum(rng.integers(-2, 3, 1400))  # with bars that don't move
    more = [("long", k + 1, START + dt.timedelta(hours=k), *(float(c),) * 4, float(rng.integers(1, 50))) for k, c in enumerate(close)]
    bars_of = some_bars.filter("symbol = 'short'").unionByName(spark.createDataFrame(more, stream.BARS))
    rows, matrices = dataset.build(bars_of, fit_on)
    got = {(r["symbol"], r["seq"]): r for r in rows.collect()}
    feats = {(r["symbol"], r["seq"]): r for r in dataset.with_features(bars_of).collect()}
    for s, n in (("long", 1400),):
        closes = np.array([feats[s, k]["close"] for k in range(1, n + 1)])
        clean = [k for k in range(1, n + 1) if all(feats[s, k][c] is not None for c in prepare.FEATURES)]
        last = clean[int(len(clean) * 0.8)] - 1 if fit_on == "train" else n
        best = 1.0
        for d in features.D_GRID:
            y = kernels.ffd(closes[:last], kernels.ffd_weights(d))
            y = y[~np.isnan(y)]
            if len(y) > 30 and kernels.adf_pvalue(kernels.adf(y)[0]) < 0.05:
                best = d
                break
        ffd = kernels.ffd(closes, kernels.ffd_weights(best))
        mine = sorted(k for x, k in got if x == s)
        full = [k for k in clean if not np.isnan(ffd[k - 1])]
        cut = full[int(len(full) * 0.8)]
        test = [k for k in full if k >= cut]
        assert mine == [k for k in full if k < cut] + (test[60:] if len(test) > 60 else test)
        train = [k for k in mine if k < cut]
        x = np.array([[feats[s, k][c] for c in prepare.FEATURES] for k in mine])
        t = x[: len(train)]
        z = (x - t.mean(axis=0)) / t.std(axis=0)
        assert (t.std(axis=0) > 0).all() and len(train) > 100
        value, vector = np.linalg.eigh(np.cov(z[: len(train)].T))
        v = vector[:, ::-1].T
        v = v * np.sign(v[np.arange(4), np.abs(v).argmax(axis=1)])[:, None]
        for k, want in zip(mine, z @ v.T, strict=True):
            r = got[s, k]
            assert np.allclose([r[f"pca_{j}"] for j in range(1, 5)], want, atol=1e-6) and abs(r["close_ffd"] - ffd[k - 1]) < 1e-8
            assert r["split"] == ("train" if k < cut else "test") and 0.5 <= r["optimal_pt"] <= 3.0
    assert not any(s == "short" for s, _ in got)
