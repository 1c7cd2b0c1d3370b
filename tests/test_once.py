"""Queries at size: streams instead of groups, and steps that run once."""

import random

import numpy as np
from pyspark.sql import functions as F

from tapeline.functions import kernels
from tapeline.operators import backtest, barriers, bars, features, model
from tapeline.plans import dataset

FEES = (0.0005, 3, 0.02, True)


def nodes(df, name):
    """How often a plan runs a step of its own; exchanges that are read again count once."""
    return df._jdf.queryExecution().sparkPlan().toString().count(name)


def ledger_input(spark, lengths):
    rng = random.Random(4)
    rows = [(s, w, "a", k, 100 * rng.uniform(0.8, 1.2), rng.choice([-1.0, 0.0, 0.4, 1.0]), 2.0, 2.0) for s, n in enumerate(lengths) for w in range(2) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol bigint, win int, agent string, step bigint, close double, act double, optimal_pt double, optimal_sl double")
    return rows, df.withColumn("ts", F.timestamp_seconds(F.col("step") * 86400))


def test_replay_streams_episodes_over_batches(spark):
    rows, df = ledger_input(spark, [1, 2, 3, 70, 9, 1, 40])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = backtest.replay(df, *FEES[:3])
        assert nodes(got, "FlatMapGroups") == 0
        got = {(r.symbol, r.win, r.step): tuple(r[5:]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s, w in {r[:2] for r in rows}:
        e = [r for r in rows if r[:2] == (s, w)]
        want |= {(s, w, k): x for k, x in enumerate(kernels.replay(*([r[c] for r in e] for c in (4, 5, 6, 7)), *FEES))}
    assert got == want and len(got) == 2 * (1 + 2 + 69 + 8 + 39)


def test_a_ruined_episode_ends_and_the_next_begins_anew():
    price, new = [100.0, 1.0, 100.0, 100.0, 100.0, 200.0, 100.0], [True, False, False, False, True, False, False]
    act = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    at, got, _ = kernels.replay_rows(price, act, [2.0] * 7, [2.0] * 7, new, None, *FEES)
    assert at == [0, 4, 5] and got[1:] == kernels.replay(price[4:], act[4:], [2.0] * 3, [2.0] * 3, *FEES)


def test_the_ledger_is_replayed_once(spark):
    _, df = ledger_input(spark, [30, 5])
    equity = backtest.with_equity(backtest.replay(df))
    for out in (equity, backtest.round_trips(equity), backtest.window_metrics(equity, df)):
        assert nodes(out, "MapInArrow") == 1
    trips = {(r.symbol, r.win): [] for r in df.collect()}
    for r in backtest.round_trips(equity).collect():
        trips[r.symbol, r.win].append(r.won)
    rows = backtest.window_metrics(equity, df).collect()
    assert len(rows) == 4
    for r in rows:
        won = trips[r.symbol, r.win]
        mine = equity.filter((F.col("symbol") == r.symbol) & (F.col("win") == r.win)).collect()
        assert abs(r.win_rate - (100 * sum(won) / len(won) if won else 0)) < 1e-9 and abs(r.profit - sum(x.reward for x in mine)) < 1e-9
        assert r.trades == sum(x.fee > 0.01 for x in mine) and abs(r.max_drawdown - 100 * max(x.drawdown for x in mine)) < 1e-9


def test_bar_scans_stream_batches(spark):
    """Chunks and whole symbols in small Arrow batches, against one scan of each symbol in plain Python."""
    rng = random.Random(8)
    ticks = [(s, k + 1, rng.randrange(1, 900), rng.randrange(30_000, 600_000), float(k)) for s, n in (("a", 1), ("b", 700), ("c", 2), ("d", 333)) for k in range(n)]
    df = spark.createDataFrame(ticks, "symbol string, seq bigint, dv bigint, bar_sum bigint, price double")
    want = {}
    for s in "abcd":
        mine = [t for t in ticks if t[0] == s]
        ids, breach, _, _ = kernels.reset_scan([t[2] for t in mine], [t[3] for t in mine], 300, 0, 0)
        want |= {(s, t[1]): (i, b) for t, i, b in zip(mine, ids, breach, strict=True)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for got in (bars.assign_bars(df), bars.assign_bars_chunked(df, chunk_rows=50), bars.assign_bars_chunked(df)):
            assert nodes(got, "FlatMapGroups") == 0  # no task holds a chunk
            assert {(r.symbol, r.seq): (r.bar_id, r.breach) for r in got.collect()} == want
            assert got.columns == [*df.columns, "bar_id", "breach"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bars.assign_bars_chunked(df.filter("false")).count() == 0


def test_event_bars_are_scanned_once_a_query(spark):
    from tapeline.plans import tapes

    got = tapes.event_bars(spark, "/root/testdata/sf0.001")
    assert nodes(got, "MapInArrow") == 0 and got.count() > 0


def test_feature_rows_are_a_table(spark):
    from tapeline.plans import queries

    got = queries.feature_rows(spark, "/root/testdata/sf0.001")
    assert nodes(got, "Window") <= 1 and got.count() > 0  # the cut's row number; no feature is computed again by what reads the rows


def test_phis_are_simulated_once(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("a", k + 1, 100 + rng.gauss(0, 1)) for k in range(300)], "symbol string, seq bigint, close double")
    got = barriers.rolling_barriers(df, n_paths=50)
    assert nodes(got, "MapInPandas") == 0 and got.count() == 300  # written, so whoever reads the rows twice does not simulate twice
    fit = barriers.ou_fit(barriers.rolling_slices(df))
    assert nodes(fit, "Join") == nodes(barriers.rolling_slices(df), "Join")


def test_cells_of_any_grid():
    eps = kernels.noise(200, 15, 1)
    for grid in (np.array(barriers.GRID), np.array([0.3, 0.7, 1.1]), np.array([1.0])):
        paths = kernels.ar_paths(0.8, eps)
        got, side = kernels.cell_sums(paths, grid), len(grid)
        for i in range(side):
            for j in range(side):
                first = lambda hit: np.where(hit.any(1), hit.argmax(1), 99)
                up, low = first(paths >= grid[i]), first(paths <= -grid[j])
                left = paths[(up == 99) & (low == 99), -1]
                assert np.allclose(got[:, i, j], [(up < low).sum(), (low < up).sum(), left.sum(), (left * left).sum()])

    assert kernels.best_barriers(np.full((5, 15), np.nan), np.array(barriers.GRID))[:2] == (0.5, 0.5)


def test_the_dataset_runs_its_steps_once(spark):
    rng = random.Random(6)
    rows = [(s, k + 1, 100 + rng.gauss(0, 1), 1.0 + rng.random()) for s in "ab" for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, seq bigint, close double, volume double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 7000).cast("timestamp_ntz"))
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    featured = dataset.with_features(df)
    plain = features.kyles_lambda(features.amihud(features.vpin(df)))
    got, want = ({(r.symbol, r.seq): (r.vpin, r.amihud, r.kyles_lambda) for r in x.collect()} for x in (featured, plain))
    assert got.keys() == want.keys() and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for k in want for a, b in zip(got[k], want[k], strict=True))
    out, _ = dataset.build(df)
    assert not any(nodes(out, x) for x in ("Window", "FlatMapGroups", "MapInPandas")) and out.count() > 0  # all in tables


def test_folds_read_written_rows(spark):
    df = spark.createDataFrame([("a", k + 1, k) for k in range(90)], "symbol string, seq bigint, t bigint").withColumn("ts", F.timestamp_seconds(F.col("t") * 40_000))
    spans = model.label_spans(df.select("symbol", "seq", "ts"), 5)
    assert nodes(spans, "Window") and nodes(model.purged_folds(spans, 3), "Window") == 0
