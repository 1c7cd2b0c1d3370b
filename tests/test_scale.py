"""Operators that don't take a symbol as one task, against plain forms of the same."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions import kernels
from tapeline.functions.windows import nth_row, scanned
from tapeline.operators import features, model, prepare


@pytest.fixture(scope="module")
def closes(spark):
    """Symbols of several lengths: seq from 1 without gaps, some values missing."""
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 1500), ("b", 700), ("c", 31), ("d", 1), ("e", 540)):
        y = 100 + np.cumsum(rng.normal(size=n)) * (s != "b") + rng.normal(size=n)
        rows += [(s, k + 1, float(v), None if k % 7 == 3 else float(k % 11)) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "symbol string, seq bigint, close double, x double")
    return df.withColumn("ts", (F.timestamp_seconds(F.lit(1_600_000_000) + F.col("seq") * 3000)).cast("timestamp_ntz"))


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 100, 100_000])
def test_scan_in_two_levels_equals_plain_windows(closes, chunk):
    got = scanned(closes, ["symbol"], sums={"s": F.col("x")}, tops={"t": F.col("close")}, lasts={"l": F.col("x")}, prevs={"p": F.col("close")}, chunk=chunk)
    w = W.partitionBy("symbol").orderBy("seq")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    want = closes.withColumns({"s": F.sum("x").over(run), "t": F.max("close").over(run), "l": F.last("x", ignorenulls=True).over(run), "p": F.lag("close").over(w)})
    assert rows_of(got, "symbol", "seq", "s", "t", "l", "p") == rows_of(want, "symbol", "seq", "s", "t", "l", "p")
    assert scanned(closes.filter("false"), ["symbol"], sums={"s": F.col("x")}).count() == 0


def test_order_statistic_by_counts(closes):
    got = {r["symbol"]: (r["n"], r["nth_seq"]) for r in nth_row(closes.filter("x is not null"), lambda n: F.floor(n * 0.8), F.to_date("ts")).collect()}
    for s in "abcde":
        seqs = sorted(r["seq"] for r in closes.filter((F.col("symbol") == s) & F.col("x").isNotNull()).collect())
        assert got[s] == (len(seqs), seqs[int(len(seqs) * 0.8)])


def test_split_and_embargo_number_no_whole_symbol(closes):
    out = prepare.embargo(prepare.chrono_split(closes), 60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    frames = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert frames and all("_part" in line.split("windowspecdefinition")[1] for line in frames)
    kept = {}
    for r in out.collect():
        kept.setdefault((r["symbol"], r["split"]), []).append(r["seq"])
    assert min(kept["a", "test"]) == 1201 + 60 and max(kept["a", "train"]) == 1200
    assert min(kept["e", "test"]) == 433 + 60 and len(kept["c", "test"]) == 31 - 24 and len(kept["d", "test"]) == 1


@pytest.mark.parametrize("chunk", [1, 600, 5000])
def test_adf_over_chunks_equals_one_pass(closes, chunk):
    grid = [0.3, 0.9]
    got = {(r["symbol"], r["d"]): r for r in features.adf_test(closes, grid, chunk=chunk).collect()}
    assert len(got) == 10
    for s in "abcde":
        y = np.array([r["close"] for r in closes.filter(F.col("symbol") == s).orderBy("seq").collect()])
        for d in grid:
            v = kernels.ffd(y, kernels.ffd_weights(d))
            v, r = v[~np.isnan(v)], got[s, d]
            assert r["n"] == len(v)
            if len(v) <= 30:
                assert r["t"] is None and r["lag"] is None and r["p"] is None
                continue
            t, lag = kernels.adf(v)
            assert r["lag"] == lag and abs(r["t"] - t) < 1e-6 and abs(r["p"] - kernels.adf_pvalue(t)) < 1e-6


def test_adf_has_no_group_by_symbol(closes):
    plan = features.adf_test(closes, [0.9])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_jacobi_equals_lapack(spark):
    rng = np.random.default_rng(2)
    mats = [np.cov(rng.normal(size=(4, 50)) * np.array([1, 2, 5, 0.1])[:, None]) for _ in range(5)] + [np.diag([3.0, 1.0, 2.0, 0.5])]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    rows = [(f"s{k}", *(float(m[i, j]) for i, j in pairs)) for k, m in enumerate(mats)] + [("none", *[None] * 10)]
    df = spark.createDataFrame(rows, "symbol string, " + ", ".join(f"cov_{i}_{j} double" for i, j in pairs))
    got = {r["symbol"]: r for r in prepare.fit_pca(df).collect()}
    assert set(got) == {f"s{k}" for k in range(6)}
    for k, m in enumerate(mats):
        value, vector = np.linalg.eigh(m)
        v = vector[:, ::-1].T
        v = v * np.sign(v[np.arange(4), np.abs(v).argmax(axis=1)])[:, None]
        assert np.allclose(got[f"s{k}"]["explained"], value[::-1], atol=1e-10) and np.allclose(got[f"s{k}"]["components"], v, atol=1e-8)


def test_no_train_label_ends_in_a_test_span(closes):
    rows = model.label_spans(closes.select("symbol", "seq", "ts"), 15, chunk=20)
    until = {(r["symbol"], r["seq"]): (r["ts"], r["until"]) for r in rows.collect()}
    ahead = {(s, k): until.get((s, k + 15), until[s, n])[0] for (s, n) in (("a", 1500), ("e", 540)) for k in range(1, n + 1)}
    assert all(until[k][1] == t for k, t in ahead.items())
    folds = {}
    for r in model.purged_folds(rows, 4).collect():
        folds.setdefault((r["fold"], r["part"]), []).append((r["symbol"], r["seq"]))
    tested = [x for (_, part), rows_ in folds.items() if part == "test" for x in rows_]
    assert sorted(tested) == sorted(until)  # each row is tested once
    for f in range(4):
        lo, hi = min(until[x][0] for x in folds[f, "test"]), max(until[x][0] for x in folds[f, "test"])
        train = folds[f, "train"]
        assert train and not any(until[x][0] <= hi and until[x][1] >= lo for x in train)
        gone = set(until) - set(train) - set(folds[f, "test"])
        assert all(until[x][0] <= hi and until[x][1] >= lo for x in gone)
