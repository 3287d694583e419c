"""The stacked order search against one series at a time."""

import time

import numpy as np
import pandas as pd
import pytest

from pricewatch.operators import sarima
from pricewatch.operators.sarima import LONG_AR, MAX_ROOT, MIN_GAIN, SEASON


def plain_moments(gamma: np.ndarray, long: int = LONG_AR) -> tuple[np.ndarray, np.ndarray]:
    """Second moments of (v, its lags 1..7, residual lags 1..7) and the long filter.

    Residuals are ``sum_j a_j v(t-j)`` with an autoregression of ``long`` lags as filter
    ``a``, so every moment is a weighted sum of autocovariances.
    """
    lags = np.arange(1, long + 1)
    toeplitz = gamma[np.abs(lags[:, None] - lags[None, :])]
    ridge = np.eye(long) * gamma[0] * 1e-9
    phi = np.linalg.solve(toeplitz + ridge, gamma[lags])
    filt = np.concatenate([[1.0], -phi])
    rows = np.zeros((1 + 2 * SEASON, long + SEASON + 1))
    for i in range(SEASON + 1):
        rows[i, i] = 1.0
    for i in range(1, SEASON + 1):
        rows[SEASON + i, i : i + long + 1] = filt
    index = np.arange(rows.shape[1])
    return rows @ gamma[np.abs(index[:, None] - index[None, :])] @ rows.T, filt


def plain_dense(lags: list[int], values: np.ndarray) -> np.ndarray:
    out = np.zeros(SEASON)
    for lag, value in zip(lags, values):
        out[lag - 1] = value
    return out


def largest_root(ar: np.ndarray) -> float:
    companion = np.zeros((SEASON, SEASON))
    companion[0] = ar
    companion[1:, :-1] = np.eye(SEASON - 1)
    return float(np.abs(np.linalg.eigvals(companion)).max())


def plain_search(moments: np.ndarray, n: int):
    """(order, ar, ma, aicc): smallest order whose criterion is within the minimum gain."""
    tried = []
    for p, q, sp, sq in sarima._candidates():
        ar = list(range(1, p + 1)) + [SEASON] * sp
        ma = list(range(1, q + 1)) + [SEASON] * sq
        at = ar + [SEASON + lag for lag in ma]
        k = len(at) + 1
        if n <= k + 1:
            continue
        cross = moments[at, 0]
        square = moments[np.ix_(at, at)] + np.eye(len(at)) * moments[0, 0] * 1e-9
        beta = np.linalg.solve(square, cross) if at else np.zeros(0)
        variance = max(moments[0, 0] - beta @ cross, moments[0, 0] * 1e-12)
        ar_dense = plain_dense(ar, beta[: len(ar)])
        if largest_root(ar_dense) > MAX_ROOT:
            continue
        aicc = n * np.log(variance) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        tried.append(((p, q, sp, sq), ar_dense, plain_dense(ma, beta[len(ar) :]), float(aicc)))
    if not tried:
        return None
    best = min(item[3] for item in tried)
    return next(item for item in tried if item[3] <= best + MIN_GAIN)


def plain_forecast(ar, ma, filt, weights, centre: float, tail: np.ndarray, steps: int) -> np.ndarray:
    """Log prices of the next ``steps`` days from the last days of the series."""
    v = np.convolve(tail, weights, mode="valid") - centre
    residuals = np.convolve(v, filt, mode="valid")[-SEASON:]
    e = np.concatenate([np.zeros(SEASON - len(residuals)), residuals, np.zeros(steps)])
    v = np.concatenate([np.zeros(max(0, SEASON - len(v))), v])[-SEASON:]
    v = np.concatenate([v, np.zeros(steps)])
    back = len(weights) - 1
    y = np.concatenate([tail[len(tail) - back :], np.zeros(steps)])
    for h in range(steps):
        now = SEASON + h
        v[now] = ar @ v[now - SEASON : now][::-1] + ma @ e[now - SEASON : now][::-1]
        y[back + h] = v[now] + centre - weights[1:] @ y[h : back + h][::-1]
    return y[back:]


def plain_fit(d, seasonal_d, centre, n, covariances, tail, steps):
    """Fit and path of one series; one that cannot be fitted keeps its last price and says why in ``status``."""
    tail = np.asarray(tail, dtype=float)
    gamma = np.asarray(covariances, dtype=float) / max(n, 1)
    flat = {
        "p": 0, "q": 0, "seasonal_p": 0, "seasonal_q": 0, "aicc": None, "ar": [], "ma": [],
        "path": np.full(steps, np.exp(tail[-1])).tolist() if len(tail) else None,
    }
    if gamma[0] <= 1e-16:
        return flat | {"status": "constant"}
    weights = sarima._difference_weights(int(d), int(seasonal_d))
    long = min(LONG_AR, int(n) // 5)  # a short series carries a shorter autoregression
    if long < 1 or len(tail) < len(weights) + long:
        return flat | {"status": "too short"}
    moments, filt = plain_moments(gamma, long)
    found = plain_search(moments, int(n))
    if found is None:
        return flat | {"status": "no candidate"}
    (p, q, sp, sq), ar, ma, aicc = found
    path = np.exp(plain_forecast(ar, ma, filt, weights, centre, tail, int(steps)))
    if not np.isfinite(path).all():
        return flat | {"status": "not finite"}
    return {
        "p": p, "q": q, "seasonal_p": sp, "seasonal_q": sq, "aicc": aicc,
        "ar": ar.tolist(), "ma": ma.tolist(), "path": path.tolist(), "status": "fitted",
    }


def some_series(count, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        size = int(rng.choice([9, 30, 60, 200, 900]))
        shocks = rng.standard_normal(size + 60)
        y = np.zeros(size + 60)
        a, b, season = rng.uniform(-0.8, 0.95), rng.uniform(-0.5, 0.5), rng.uniform(0, 0.6)
        for t in range(8, len(y)):
            y[t] = a * y[t - 1] + season * (1 - abs(a)) * y[t - 7] + shocks[t] + b * shocks[t - 1]
        y = 5 + 0.1 * y[60:]
        if i % 11 == 0:
            y[:] = 5.0
        d, sd = int(rng.integers(0, 3)), int(rng.integers(0, 2))
        v = np.convolve(y, sarima._difference_weights(d, sd), mode="valid") if len(y) > d + 7 * sd else np.zeros(0)
        centre = float(v.mean()) if d == sd == 0 and len(v) else 0.0
        v = v - centre
        gamma = [float(v[k:] @ v[: len(v) - k]) if len(v) > k else 0.0 for k in range(sarima.COVARIANCES + 1)]
        rows.append((d, sd, centre, len(v), gamma, y[-sarima.TAIL :].tolist(), int(rng.choice([5, 90]))))
    return rows


def test_batches_equal_single_fits():
    rows = some_series(250, 1)
    got = sarima._fit_batch(*[pd.Series(c) for c in zip(*rows)]).to_dict("records")
    seen = set()
    for row, g in zip(rows, got):
        w = plain_fit(*row)
        seen.add(w["status"])
        assert g["status"] == w["status"]
        assert [g[k] for k in ("p", "q", "seasonal_p", "seasonal_q")] == [w[k] for k in ("p", "q", "seasonal_p", "seasonal_q")]
        assert g["path"] == pytest.approx(w["path"], rel=1e-8)
        assert (g["aicc"] is None or np.isnan(g["aicc"])) == (w["aicc"] is None)
        assert g["ar"] == pytest.approx(w["ar"], abs=1e-9) and g["ma"] == pytest.approx(w["ma"], abs=1e-9)
    assert {"fitted", "constant", "too short"} <= seen


def test_stability_agrees_with_the_roots():
    ar = np.random.default_rng(3).uniform(-1, 1, (3000, SEASON)) * np.random.default_rng(4).uniform(0, 1, (3000, 1))
    ar[::3, 3:] = 0
    want = np.array([largest_root(a) for a in ar])
    clear = np.abs(want - MAX_ROOT) > 1e-9
    assert (sarima._stable(ar)[clear] == (want <= MAX_ROOT)[clear]).all() and 0.2 < (want <= MAX_ROOT).mean() < 0.95


def test_a_singular_system_leaves_the_others_alone():
    a = np.stack([np.eye(2), np.zeros((2, 2)), 2 * np.eye(2)])
    out = sarima._stacked_solve(a, np.ones((3, 2)))
    assert out[0].tolist() == [1, 1] and np.isnan(out[1]).all() and out[2].tolist() == [0.5, 0.5]


def test_stacking_saves_time():
    rows = [r[:6] + (90,) for r in some_series(125, 2)]
    columns = [pd.Series(c) for c in zip(*rows)]
    start = time.process_time()
    sarima._fit_batch(*columns)
    batch = time.process_time() - start
    start = time.process_time()
    for r in rows:
        plain_fit(*r)
    single = time.process_time() - start
    print(f"single {single:.2f} s, stacked {batch:.2f} s")
    assert batch < single
