"""Helpers against naive loops."""

import math
import tracemalloc

import numpy as np

from tapeline.functions import kernels as k


def naive_t(y):
    x, d = y[:-1], np.diff(y)
    a = np.stack([np.ones(len(x)), x], axis=1)
    b, *_ = np.linalg.lstsq(a, d, rcond=None)
    res = d - a @ b
    se = math.sqrt((res @ res) / (len(d) - 2) / ((x - x.mean()) ** 2).sum())
    return b[1] / se


def test_sadf_matches_loops_and_ignores_level():
    y = np.cumsum(np.random.default_rng(1).standard_normal(160)) + 50
    got = k.sadf(y)
    assert np.isnan(got[:100]).all()
    for t in (100, 123, 159):
        assert abs(got[t] - max(naive_t(y[s : t + 1]) for s in range(t - 100, t - 29))) < 1e-8
    assert np.allclose(got[100:], k.sadf(y + 1000)[100:], atol=1e-6)
    assert (k.sadf(np.full(150, 3.0))[100:] == 0).all()


def test_ffd():
    assert k.ffd_weights(1.0) == [1.0, -1.0]
    assert len(k.ffd_weights(0.4)) - 1 == 281 and len(k.ffd_weights(0.9)) - 1 == 37
    y = np.arange(50.0) ** 2
    assert np.allclose(k.ffd(y, k.ffd_weights(1.0))[1:], np.diff(y))
    assert np.isnan(k.ffd(y, k.ffd_weights(0.4))).all()


def test_adf_rejects_noise_and_not_a_walk():
    rng = np.random.default_rng(3)
    e = rng.standard_normal(600)
    assert k.adf_pvalue(k.adf(e)[0]) < 0.01 and k.adf_pvalue(k.adf(np.cumsum(e))[0]) > 0.1
    assert abs(k.adf_pvalue(-2.8615) - 0.05) < 1e-3


def test_barriers_depend_on_phi_alone():
    eps = k.noise(500, 15, 7)
    grid = np.array([0.5 + 0.25 * i for i in range(11)])
    p = k.ar_paths(0.6, eps)
    assert p.shape == (500, 15) and (p[:, 0] == 0).all()
    pt, sl, sharpe = k.best_barriers(p, grid)
    best = -math.inf
    for a in grid:
        for b in grid:
            pnl = []
            for path in p:
                hit = next((a if x >= a else -b for x in path if x >= a or x <= -b), path[-1])
                pnl.append(hit)
            best = max(best, np.mean(pnl) / np.std(pnl))
        if a > 1:
            break
    assert sharpe >= best - 1e-9 and pt in grid and sl in grid


def test_replay_rules():
    up = k.replay([100, 103, 105, 100], [1.0, 0.0, 0.0, 0.0], [2.0] * 4, [2.0] * 4, 0.0, 15, 0.02, True)
    assert [round(x[1], 6) for x in up] == [100.0, 100.0, 0.0] and up[2][5] and up[2][0] == 10_500
    hold = k.replay([100, 103, 105, 100], [1.0, 0.0, 0.0, 0.0], [2.0] * 4, [2.0] * 4, 0.0, 15, 0.02, False)
    assert hold[2][1] == 100.0 and hold[2][5]
    late = k.replay([100.0] * 20, [1.0] + [0.0] * 19, [2.0] * 20, [2.0] * 20, 0.0, 15, 0.02, True)
    assert [i for i, x in enumerate(late) if x[5]] == [15]
    bust = k.replay([100, 5, 5, 5], [1.0, 0, 0, 0], [2.0] * 4, [2.0] * 4, 0.0, 15, 0.02, True)
    assert len(bust) == 1


def test_reset_scan_carries_over():
    dv, bar = [5, 5, 5, 5, 5], [1500] * 5
    assert k.reset_scan(dv, bar, 150, 0, 0)[:2] == ([0, 0, 1, 1, 2], [False, True, False, True, False])
    a = k.reset_scan(dv[:3], bar[:3], 150, 0, 0)
    b = k.reset_scan(dv[3:], bar[3:], 150, a[2], a[3])
    assert a[0] + b[0] == [0, 0, 1, 1, 2]


def test_hit_time_sums_give_the_cells_of_single_passes():
    grid = np.array([0.5 + 0.25 * g for g in range(11)])
    eps = k.noise(2000, 15, 3)
    for phi in (-1.1, -0.4, 0.0, 0.6, 0.99, 1.3):
        paths = k.ar_paths(phi, eps)
        want = {}
        for pt in grid:
            for sl in grid:
                pnl = []
                for p in paths[:300]:
                    hit = next((pt if x >= pt else -sl for x in p if x >= pt or x <= -sl), p[-1])
                    pnl.append(hit)
                want[pt, sl] = np.mean(pnl) / np.std(pnl) if np.std(pnl) > 1e-9 else 0.0
        sums = k.cell_sums(paths[:300], grid)
        pt, sl, sharpe = k.best_cell(sums, 300, grid)
        assert abs(sharpe - max(want.values())) < 1e-9 and abs(want[pt, sl] - sharpe) < 1e-9
        assert np.allclose(k.cell_sums(paths, grid), k.cell_sums(paths[:700], grid) + k.cell_sums(paths[700:], grid))


def test_adf_of_moments_equals_least_squares():
    rng = np.random.default_rng(0)
    for n in (31, 60, 200, 2500):
        for y in (np.cumsum(rng.normal(size=n)), rng.normal(size=n) + 50, np.cumsum(rng.normal(size=n)) * 0.1 + rng.normal(size=n)):
            lags = k.adf_lags(n)
            rows = k.adf_design(y, lags)
            parts = [r.T @ r for r in np.array_split(rows, 4)]
            t, lag = k.adf_of_moments(sum(parts), y[: lags + 1])
            want = k.adf(y)
            assert lag == want[1] and abs(t - want[0]) < 1e-6 * max(1, abs(t))


def _peak_mb(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_sadf_lays_out_slices():
    y = 50 + np.cumsum(np.random.default_rng(2).normal(size=20_100))
    got, peak = _peak_mb(lambda: k.sadf(y))
    assert peak < 25
    for at in (100, 1123, 1124, 1125, 20_099):  # around the first edge of a slice
        assert got[at] == k.sadf(y[at - 100 : at + 1])[100]


def test_adf_moments_lay_out_slices():
    y = 50 + np.cumsum(np.random.default_rng(2).normal(size=20_100))
    own, lags = np.arange(len(y)) >= 150, 112
    got, peak = _peak_mb(lambda: k.adf_moments(y, lags, own))
    rows = k.adf_design(y, lags)[own[lags + 1 :]]
    assert peak < 10 and np.allclose(got, rows.T @ rows, rtol=1e-9, atol=1e-6)
    assert not k.adf_moments(y[:0], 2, own[:0]).any() and not k.adf_moments(y[:3], 2, own[-3:]).any()
