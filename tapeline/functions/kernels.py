"""Small vectorised helpers: scans and dense algebra that SQL can't express well."""

from __future__ import annotations

import functools
import math

import numpy as np


def reset_scan(dv: list[int], bar: list[int], divisor: int, cum: int, bar_id: int) -> tuple[list[int], list[bool], int, int]:
    """Bar number and breach of each tick: a bar ends where divisor times its sum reaches ``bar``; the sum then starts at 0."""
    ids, breach = [], []
    for x, m in zip(dv, bar, strict=True):
        cum += x
        ids.append(bar_id)
        if divisor * cum >= m:
            breach.append(True)
            cum, bar_id = 0, bar_id + 1
        else:
            breach.append(False)
    return ids, breach, cum, bar_id


#: Rows whose windows or lags are laid out at once.
SLICE = 1024


def sadf(y: np.ndarray, min_len: int = 30, window: int = 100) -> np.ndarray:
    """Largest Dickey-Fuller t over the starts t-window .. t-min_len, for each row t >= window (NaN before).

    The regression of the change on the level doesn't mind a shift of the level, so windows are centred on their last price; sums
    over all starts are one reversed cumulative sum.
    """
    out = np.full(len(y), np.nan)
    if len(y) <= window:
        return out
    for at in range(window, len(y), SLICE):
        part = np.lib.stride_tricks.sliding_window_view(y[at - window : at + SLICE], window + 1)
        part = part - part[:, -1:]
        x, d = part[:, :-1], np.diff(part, axis=1)
        back = lambda v: np.cumsum(v[:, ::-1], axis=1)[:, ::-1][:, : window - min_len + 1]
        m = np.arange(window, min_len - 1, -1)
        sx, sd, sxx, sxd, sdd = back(x), back(d), back(x * x), back(x * d), back(d * d)
        var = sxx - sx * sx / m
        cov = sxd - sx * sd / m
        with np.errstate(all="ignore"):
            beta = cov / var
            ssr = sdd - sd * sd / m - beta * cov
            se = np.sqrt(ssr / (m - 2) / var)
            t = np.where((var < 1e-10) | (ssr < 1e-10) | (se < 1e-10), 0.0, beta / se)
        out[at : at + len(t)] = t.max(axis=1)
    return out


def ffd_weights(d: float, thres: float = 1e-4) -> list[float]:
    """w0 = 1, w_k = -w_(k-1) (d - k + 1) / k, up to the first one below ``thres``."""
    w = [1.0]
    while abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= thres:
        w.append(nxt)
    return w


def ffd(y: np.ndarray, w: list[float]) -> np.ndarray:
    out = np.full(len(y), np.nan)
    if len(y) >= len(w):
        out[len(w) - 1 :] = np.convolve(y, w, "valid")
    return out


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, float(((y - x @ beta) ** 2).sum()), np.linalg.pinv(x.T @ x)


def adf(y: np.ndarray) -> tuple[float, int]:
    """Augmented Dickey-Fuller t with a constant and the lag that has the least AIC on the common sample; (t, lag)."""
    n = len(y) - 1
    dy = np.diff(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def design(lag: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, n)
        cols = [np.ones(len(rows)), y[rows]] + [dy[rows - k] for k in range(1, lag + 1)]
        return np.stack(cols, axis=1), dy[rows]

    best, lag = math.inf, 0
    for k in range(top + 1):
        x, z = design(k, top)
        _, ssr, _ = _ols(x, z)
        aic = len(z) * (math.log(max(ssr, 1e-300) / len(z)) + 1 + math.log(2 * math.pi)) + 2 * x.shape[1]
        if aic < best - 1e-9:
            best, lag = aic, k
    x, z = design(lag, lag)
    beta, ssr, inv = _ols(x, z)
    se = math.sqrt(max(ssr / (len(z) - x.shape[1]) * inv[1, 1], 0.0))
    return (float(beta[1]) / se if se > 0 else 0.0), lag


def adf_lags(n: int) -> int:
    """Most lags that are tried for n values."""
    n -= 1
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def adf_design(y: np.ndarray, lags: int) -> np.ndarray:
    """Rows (1, level, last ``lags`` changes, next change) of each value of y that has them all."""
    dy = np.diff(y)
    if len(dy) <= lags:
        return np.empty((0, lags + 3))
    past = np.lib.stride_tricks.sliding_window_view(dy, lags + 1)[:, ::-1]  # next change, then the last ones backward
    return np.column_stack([np.ones(len(past)), y[lags:-1], past[:, 1:], past[:, 0]])


def adf_moments(y: np.ndarray, lags: int, own: np.ndarray) -> np.ndarray:
    """X'X of those rows of ``adf_design`` whose next change belongs to a value that is ``own``, laid out ``SLICE`` rows at a time."""
    m = np.zeros((lags + 3, lags + 3))
    for at in range(0, len(y) - lags - 1, SLICE):
        rows = adf_design(y[at : at + SLICE + lags + 1], lags)
        rows = rows[own[at + lags + 1 : at + lags + 1 + len(rows)]]
        m += rows.T @ rows
    return m


def adf_of_moments(m: np.ndarray, head: np.ndarray, lag: int | None = None) -> tuple[float, int]:
    """(t, lag) of the augmented Dickey-Fuller test from the moments X'X of ``adf_design`` with all lags (the common sample).

    One Cholesky factor gives the residual sums of all nested lags, and so the one with the least AIC (or ``lag`` is given). The rows before the common sample,
    which that lag can use too, come from the series' first values, ``head``.
    """
    top, n = m.shape[0] - 3, m[0, 0]
    if lag is None:
        scale = np.sqrt(np.maximum(np.diag(m), 1e-300))  # columns of one size
        x = m[:-1, :-1] / np.outer(scale[:-1], scale[:-1])
        c = np.linalg.cholesky(x + 1e-14 * np.eye(len(x)))
        w = np.linalg.solve(c, m[:-1, -1] / scale[:-1])
        ssr = m[-1, -1] - np.cumsum(w * w)[1:]  # with 0, 1, .. lags
        aic = n * (np.log(np.maximum(ssr, 1e-300) / n) + 1 + math.log(2 * math.pi)) + 2 * (np.arange(top + 1) + 2)
        lag = 0
        for k in range(1, top + 1):
            if aic[k] < aic[lag] - 1e-9:
                lag = k
    use = [*range(lag + 2), top + 2]
    full = m[np.ix_(use, use)]
    if lag < top:
        first = adf_design(head[: top + 1], lag)
        full = full + first.T @ first
    inv = np.linalg.pinv(full[:-1, :-1], hermitian=True)
    beta = inv @ full[:-1, -1]
    ssr = full[-1, -1] - beta @ full[:-1, -1]
    se = math.sqrt(max(ssr / (full[0, 0] - len(beta)) * inv[1, 1], 0.0))
    return (float(beta[1]) / se if se > 0 else 0.0), lag


def adf_pvalue(t: float) -> float:
    """MacKinnon's (1994) approximation for a constant, one variable."""
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    z = 2.1659 + 1.4412 * t + 0.038269 * t * t if t <= -1.61 else 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t**3
    return 0.5 * math.erfc(-z / math.sqrt(2))


def noise(n: int, length: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, length - 1))


def ar_paths(phi: float, eps: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """p_0 = 0, p_t = phi p_(t-1) + eps_t; one row a path. ``out``: an array (steps, paths) of zeros or of earlier paths to be filled."""
    steps = np.ascontiguousarray(eps.T)
    out = np.zeros((len(steps) + 1, len(eps))) if out is None else out
    for t, e in enumerate(steps):
        np.multiply(out[t], phi, out=out[t + 1])
        out[t + 1] += e
    return out.T


@functools.lru_cache(maxsize=1)
def _work(steps: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays that ``cell_sums`` fills again at each call; new ones cost more than what is done with them."""
    return np.empty((steps, n)), np.zeros((steps + 1, n), np.uint8), np.empty((steps, n), np.intp)


def cell_sums(paths: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Of each cell (pt, sl) of the grid: paths that hit pt first, that hit sl first, and the sum and sum of squares of the last prices of
    the others; shape (4, cells, cells). Sums of parts of the paths add up.

    A path's running maximum (minimum) has reached a number of levels at each step. Where it goes from a to b levels up with c down, the
    cells a <= pt < b, c <= sl are hit: histograms over all steps of (before, down) and (after, down), summed up over cells, differ
    by these hits. Both come from one histogram of the states before and after each step.
    """
    p, k = np.ascontiguousarray(paths.T), len(grid) + 1
    assert k <= 15  # a state is a number below 2^8
    q, states, pairs = _work(*p.shape)
    h = grid[1] - grid[0] if len(grid) > 1 else 0.0
    if h > 0 and math.frexp(h)[0] == 0.5 and grid[0] >= h and grid[0] % h == 0 and np.array_equal(grid, grid[0] + h * np.arange(len(grid))):
        least = int(grid[0] / h) - 1  # steps of a power of two: the whole part of the exact quotient is the level
        q = np.clip(p, -grid[-1], grid[-1], out=q)
        q *= 1 / h
        if np.isnan(q.sum()):
            q = np.nan_to_num(q)
        level = lambda x: x.astype(np.uint8) - np.uint8(least)
    else:
        q, least = p, -np.inf
        level = lambda x: np.searchsorted(grid, x, side="right").astype(np.uint8)
    high, low, other = np.full((3, len(paths)), float(least))
    for t, x in enumerate(q):
        np.maximum(high, x, out=high)
        np.maximum(low, np.negative(x, out=other), out=low)
        np.multiply(level(high), np.uint8(k), out=states[t + 1])
        states[t + 1] += level(low)
    np.multiply(states[:-1], k * k, out=pairs, dtype=np.intp)
    pairs += states[1:]
    steps = np.bincount(pairs.ravel(), minlength=k**4).reshape(k, k, k, k)  # up and down before, up and down after
    left = lambda w: np.bincount(states[-1], w, k * k).reshape(k, k)
    total = lambda m: m.cumsum(0).cumsum(1)[:-1, :-1]
    after, last = steps.sum((0, 1)), p[-1]
    return np.stack([total(steps.sum((1, 2)) - after), total(steps.sum((0, 3)).T - after), total(left(last)), total(left(last * last))])


def best_cell(sums: np.ndarray, n: int, grid: np.ndarray) -> tuple[float, float, float]:
    """(pt, sl, sharpe) of the best cell by ``cell_sums`` of n paths; the first on ties, 0 without deviation."""
    pt, sl = grid[:, None], grid[None, :]
    mean = (sums[0] * pt - sums[1] * sl + sums[2]) / n
    var = (sums[0] * pt * pt + sums[1] * sl * sl + sums[3]) / n - mean * mean
    sharpe = np.where(var > 1e-18, mean / np.sqrt(np.maximum(var, 1e-18)), 0.0)
    i, j = np.unravel_index(np.argmax(sharpe), sharpe.shape)
    return float(grid[i]), float(grid[j]), float(sharpe[i, j])


def best_barriers(paths: np.ndarray, grid: np.ndarray) -> tuple[float, float, float]:
    """(pt, sl, sharpe) of the best cell for paths in units of sigma: the level hit first, else the last price; first cell on ties."""
    return best_cell(cell_sums(paths, grid), len(paths), grid)


def replay_rows(price: list[float], act: list[float], pt: list[float], sl: list[float], new: list[bool], state: tuple | None, fee: float, horizon: int, atr_pct: float, liquidate: bool, capital: float = 10_000.0) -> tuple[list[int], list[tuple], tuple | None]:
    """Steps of episodes whose rows come one after the other; ``new`` marks an episode's first row. (number of the row, (cash, shares, fee,
    prev_value, value, forced)) of each step, and the state before the last row, which waits for the next price: it is the first row
    of the next call."""
    cash, shares, entry, entry_at, atr, i, over = state or (capital, 0.0, 0.0, 0, 0.0, 0, False)
    at, out = [], []
    for j in range(len(price) - 1):
        if new[j]:
            cash, shares, entry, entry_at, atr, i, over = capital, 0.0, 0.0, 0, 0.0, 0, False
        if over or new[j + 1]:  # the last price of an episode has no step
            continue
        p, a, forced, paid = price[j], act[j], False, 0.0
        if shares > 0 and entry > 0:
            forced = p >= entry + atr * pt[j] or p <= entry - atr * sl[j] or i - entry_at >= horizon
        if forced:
            a = -1.0 if liquidate else 0.0
        before = cash + shares * p
        if a > 0:
            amount = cash * a
            paid = amount * fee
            if amount - paid > 0 and p > 0:
                cash -= amount
                shares += (amount - paid) / p
                if entry == 0.0:
                    entry, entry_at, atr = p, i, atr_pct * p
        elif a < 0:
            sold = shares * -a
            paid = sold * p * fee
            cash += sold * p - paid
            shares -= sold
            if shares <= 1e-6:
                shares, entry, entry_at, atr = 0.0, 0.0, 0, 0.0
        value = cash + shares * price[j + 1]
        at.append(j)
        out.append((cash, shares, paid, before, value, forced))
        over = value < 1000
        i += 1
    return at, out, (cash, shares, entry, entry_at, atr, i, over)


def replay(price: list[float], act: list[float], pt: list[float], sl: list[float], fee: float, horizon: int, atr_pct: float, liquidate: bool, capital: float = 10_000.0) -> list[tuple]:
    """(cash, shares, fee, prev_value, value, forced) of each step of an episode; the last price has no step."""
    return replay_rows(price, act, pt, sl, [k == 0 for k in range(len(price))], None, fee, horizon, atr_pct, liquidate, capital)[1]
