"""Seasonal ARIMA on log prices with an order search, for many series at once.

The long part runs on Spark: differencing orders from regression and
stationarity statistics, then the autocovariances of the differenced series, all
by windows over one sort and one aggregation. A series leaves that as some forty
numbers. Everything after follows from the autocovariances, so a small Arrow
function solves the candidate orders of each series without its days.

Orders: p, q <= 3, P, Q <= 1 with weekly seasons and p + q + P + Q <= 6; d <= 2,
D <= 1. Candidates are fitted in two regressions (Hannan and Rissanen): a long
autoregression gives residuals, then the value is regressed on its own lags and
on lagged residuals. The corrected information criterion picks the order; it
is compared among candidates of equal differencing only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.operators.regularise import FORECAST, KEYS, Filling, explode_days, price_on

SEASON = 7
# Bounds of the search.
MAX_P = MAX_Q = 3
MAX_SEASONAL = 1
MAX_ORDER = 6
# Critical value of the seasonal regression test for weekly data
# and of the 5 % level-stationarity test.
SEASONAL_CRITICAL = -1.845
STATIONARY_CRITICAL = 0.463
LONG_AR = 14
# Residual lags reach 7, own lags 7, both through the long autoregression.
COVARIANCES = LONG_AR + SEASON + LONG_AR
TAIL = LONG_AR + 2 * SEASON + 2
# A larger order must beat a smaller one by this much.
MIN_GAIN = 2.0
# Candidates with autoregressive roots this close to one or beyond are left out.
MAX_ROOT = 0.999

FIT_TYPE = (
    "struct<p:int,q:int,seasonal_p:int,seasonal_q:int,aicc:double,"
    "ar:array<double>,ma:array<double>,path:array<double>,status:string>"
)


def _windows(keys: Sequence[str]):
    ordered = Window.partitionBy(*keys).orderBy("date")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered, whole, running


def daily_logs(
    segs: DataFrame,
    keys: Sequence[str] = KEYS,
    fill: Filling = FORECAST,
    last: Column | None = None,
) -> DataFrame:
    """Log price of every training day; days without a positive price are left out."""
    price = price_on(F.col("day"), fill)
    days = explode_days(segs, last=last).select(
        *keys, F.col("day").alias("date"), price.alias("price")
    )
    return days.filter(F.col("price") > 0).select(*keys, "date", F.ln("price").alias("y"))


def with_seasonal_order(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``seasonal_d``: 1 when the weekly root is not rejected.

    Regression of the doubly differenced series on the seasonal difference one
    day back and the daily difference one season back; the t-value of the latter
    decides.
    """
    ordered, whole, _ = _windows(keys)
    y = F.col("y")

    def lag(k: int) -> Column:
        return F.lag("y", k).over(ordered)

    z, u, v = F.col("_z"), F.col("_u"), F.col("_v")
    det = F.col("_uu") * F.col("_vv") - F.col("_uv") * F.col("_uv")
    safe = F.when(det > 0, det)
    b_v = (F.col("_uu") * F.col("_vz") - F.col("_uv") * F.col("_uz")) / safe
    b_u = (F.col("_vv") * F.col("_uz") - F.col("_uv") * F.col("_vz")) / safe
    rss = F.col("_zz") - b_u * F.col("_uz") - b_v * F.col("_vz")
    error = F.sqrt(F.greatest(rss, F.lit(0.0)) / (F.col("_n") - 2) * F.col("_uu") / safe)
    t_value = b_v / F.when(error > 0, error)
    return (
        rows.select(
            "*",
            (y - lag(1) - lag(SEASON) + lag(SEASON + 1)).alias("_z"),
            (lag(1) - lag(SEASON + 1)).alias("_u"),
            (lag(SEASON) - lag(SEASON + 1)).alias("_v"),
        )
        .select(
            *rows.columns,
            *[
                F.sum(F.when(z.isNotNull(), a * b)).over(whole).alias(name)
                for name, a, b in (
                    ("_zz", z, z),
                    ("_uz", u, z),
                    ("_vz", v, z),
                    ("_uu", u, u),
                    ("_vv", v, v),
                    ("_uv", u, v),
                )
            ],
            F.count("_z").over(whole).alias("_n"),
        )
        .select(
            *rows.columns,
            F.when((F.col("_n") > 2) & (t_value > SEASONAL_CRITICAL), 1)
            .otherwise(0)
            .alias("seasonal_d"),
        )
    )


def _moves(values: np.ndarray) -> bool:
    """Whether level stationarity is rejected: cumulated deviations against the long-run variance
    with Bartlett weights over floor(3 sqrt(n) / 13) lags."""
    known = ~np.isnan(values)
    n = int(known.sum())
    if not n:
        return False
    e = values - values[known].mean()
    lags = int(3 * np.sqrt(n) / 13)
    variance = np.nansum(e * e)
    for k in range(1, min(lags, len(e) - 1) + 1):
        variance += 2 * (1 - k / (lags + 1)) * np.nansum(e[k:] * e[:-k])
    cumulated = np.cumsum(np.where(known, e, 0.0))[known]
    return bool(variance > 0 and (cumulated**2).sum() / n / variance > STATIONARY_CRITICAL)


def _difference_orders(values: pd.Series) -> pd.Series:
    """Differences until the statistic no longer rejects, at most two."""
    orders = []
    for row in values:
        w = np.array(row, dtype=float)
        orders.append(0 if not _moves(w) else 1 if not _moves(np.diff(w)) else 2)
    return pd.Series(orders, dtype="int32")


def with_difference_order(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``v``, the differenced series, and ``d``, the number of differences.

    The values of a series, one per calendar day, go to the statistic as one array; its lags grow
    with the series. Array and rows have the same placement, so the join back needs no exchange.
    """
    ordered, _, _ = _windows(keys)
    seasonal = F.when(F.col("seasonal_d") == 1, F.col("y") - F.lag("y", SEASON).over(ordered))
    w0 = rows.withColumn("_w0", F.when(F.col("seasonal_d") == 0, F.col("y")).otherwise(seasonal))
    w1 = w0.withColumn("_w1", F.col("_w0") - F.lag("_w0").over(ordered))
    w2 = w1.withColumn("_w2", F.col("_w1") - F.lag("_w1").over(ordered))
    days = w0.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "_w0"))).alias("_days"))
    order = F.pandas_udf(_difference_orders, "int")
    found = days.select(*keys, order(F.transform("_days", lambda day: day["_w0"])).alias("d"))
    v = (
        F.when(F.col("d") == 0, F.col("_w0"))
        .when(F.col("d") == 1, F.col("_w1"))
        .otherwise(F.col("_w2"))
    )
    return w2.join(found, list(keys)).select(*rows.columns, "d", v.alias("v"))


def summarise(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series: differencing orders, autocovariances of ``v``, last days of ``y``.

    An undifferenced series is centred; differenced ones have no constant.
    """
    ordered, whole, _ = _windows(keys)
    undifferenced = (F.col("d") == 0) & (F.col("seasonal_d") == 0)
    centre = F.when(undifferenced, F.avg("v").over(whole)).otherwise(F.lit(0.0))
    centred = rows.select(
        *keys, "date", "y", "d", "seasonal_d", centre.alias("centre"),
        F.max("date").over(whole).alias("last_date"), "v",
    ).withColumn("v", F.col("v") - F.col("centre"))
    lagged = centred.select(
        "*", *[F.lag("v", k).over(ordered).alias(f"_v{k}") for k in range(1, COVARIANCES + 1)]
    )
    recent = F.datediff("last_date", "date") < TAIL
    return lagged.groupBy(*keys).agg(
        F.first("last_date").alias("last_date"),
        F.first("d").alias("d"),
        F.first("seasonal_d").alias("seasonal_d"),
        F.first("centre").alias("centre"),
        F.count("v").alias("n"),
        F.array(
            *[
                F.coalesce(F.sum(F.col("v") * (F.col("v") if k == 0 else F.col(f"_v{k}"))), F.lit(0.0))
                for k in range(COVARIANCES + 1)
            ]
        ).alias("covariances"),
        F.transform(
            F.array_sort(F.collect_list(F.when(recent, F.struct("date", "y")))),
            lambda item: item["y"],
        ).alias("tail"),
    )


def _candidates() -> list[tuple[int, int, int, int]]:
    """All orders, smallest first."""
    grid = [
        (p, q, sp, sq)
        for p in range(MAX_P + 1)
        for q in range(MAX_Q + 1)
        for sp in range(MAX_SEASONAL + 1)
        for sq in range(MAX_SEASONAL + 1)
        if p + q + sp + sq <= MAX_ORDER
    ]
    return sorted(grid, key=lambda order: (sum(order), order))


def _difference_weights(d: int, seasonal_d: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^7)^D."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    if seasonal_d:
        season = np.zeros(SEASON + 1)
        season[0], season[SEASON] = 1.0, -1.0
        poly = np.convolve(poly, season)
    return poly


def _stacked_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems; a singular one gets NaN and leaves the others alone."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = np.full(b.shape, np.nan)
        for i in range(len(a)):
            try:
                out[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                continue
        return out


def _moments(gamma: np.ndarray, long: int = LONG_AR) -> tuple[np.ndarray, np.ndarray]:
    """Per series: second moments of (v, its lags 1..7, residual lags 1..7) and the long filter.

    Residuals are ``sum_j a_j v(t-j)`` with an autoregression of ``long`` lags as filter
    ``a``, so every moment is a weighted sum of autocovariances (the rows of ``gamma``).
    """
    lags = np.arange(1, long + 1)
    ridge = np.eye(long) * gamma[:, 0, None, None] * 1e-9
    phi = _stacked_solve(gamma[:, np.abs(lags[:, None] - lags[None, :])] + ridge, gamma[:, lags])
    filt = np.concatenate([np.ones((len(gamma), 1)), -phi], axis=1)
    rows = np.zeros((len(gamma), 1 + 2 * SEASON, long + SEASON + 1))
    for i in range(SEASON + 1):
        rows[:, i, i] = 1.0
    for i in range(1, SEASON + 1):
        rows[:, SEASON + i, i : i + long + 1] = filt
    index = np.arange(rows.shape[2])
    return rows @ gamma[:, np.abs(index[:, None] - index[None, :])] @ rows.transpose(0, 2, 1), filt


def _dense(lags: list[int], values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(values), SEASON))
    for at, lag in enumerate(lags):
        out[:, lag - 1] = values[:, at]
    return out


def _stable(ar: np.ndarray) -> np.ndarray:
    """Whether all roots of each autoregression lie within ``MAX_ROOT``, by stepping its order down.

    Scaled by powers of the bound, the roots must lie within the unit circle: that is so when every
    reflection coefficient met on the way down is smaller than one.
    """
    a = ar / MAX_ROOT ** np.arange(1, SEASON + 1)
    fine = np.ones(len(a), dtype=bool)
    for order in range(SEASON, 0, -1):
        k = a[:, order - 1]
        fine &= np.abs(k) < 1
        safe = np.where(fine, 1 - k * k, 1.0)
        a = (a[:, : order - 1] + k[:, None] * a[:, : order - 1][:, ::-1]) / safe[:, None]
    return fine


def _search(moments: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per series: place of its order in :func:`_candidates` (-1: none), ar, ma, aicc.

    The smallest order whose criterion is within the minimum gain wins. One stacked solve per order
    serves all series.
    """
    orders = _candidates()
    count = len(n)
    aicc = np.full((count, len(orders)), np.inf)
    ar_all, ma_all = np.zeros((2, count, len(orders), SEASON))
    power = moments[:, 0, 0]
    for c, (p, q, sp, sq) in enumerate(orders):
        ar = list(range(1, p + 1)) + [SEASON] * sp
        ma = list(range(1, q + 1)) + [SEASON] * sq
        at = ar + [SEASON + lag for lag in ma]
        k = len(at) + 1
        cross = moments[:, at, 0]
        square = moments[:, np.array(at, dtype=int)[:, None], at] + np.eye(len(at)) * power[:, None, None] * 1e-9
        beta = _stacked_solve(square, cross) if at else np.zeros((count, 0))
        variance = np.maximum(power - (beta * cross).sum(axis=1), power * 1e-12)
        ar_all[:, c], ma_all[:, c] = _dense(ar, beta[:, : len(ar)]), _dense(ma, beta[:, len(ar) :])
        fine = (n > k + 1) & _stable(np.nan_to_num(ar_all[:, c], nan=9.0)) & np.isfinite(variance)
        rest = np.where(fine, n - k - 1, 1)
        value = n * np.log(np.where(fine, variance, 1.0)) + 2 * k + 2 * k * (k + 1) / rest
        aicc[fine, c] = value[fine]
    near = aicc <= aicc.min(axis=1, keepdims=True) + MIN_GAIN
    best = np.where(np.isfinite(aicc).any(axis=1), near.argmax(axis=1), -1)
    row = np.arange(count)
    return best, ar_all[row, best], ma_all[row, best], aicc[row, best]


def _forecast(ar, ma, filt, weights, centre, tail: np.ndarray, steps: int) -> np.ndarray:
    """Log prices of the next ``steps`` days from the last days of each series; series are rows."""
    count, back = len(tail), len(weights) - 1

    def filtered(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Sums of ``by`` (a filter per row) over the rows, newest last."""
        m = by.shape[1]
        return sum(by[:, j, None] * rows[:, m - 1 - j : rows.shape[1] - j] for j in range(m))

    def last(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((count, max(0, SEASON - rows.shape[1]))), rows[:, -SEASON:]], axis=1)

    past = filtered(tail, np.tile(weights, (count, 1))) - centre[:, None]
    ahead = np.zeros((count, steps))
    e = np.concatenate([last(filtered(past, filt)), ahead], axis=1)
    v = np.concatenate([last(past), ahead], axis=1)
    y = np.concatenate([tail[:, tail.shape[1] - back :], ahead], axis=1)
    for h in range(steps):
        now = SEASON + h
        v[:, now] = (ar * v[:, h:now][:, ::-1]).sum(axis=1) + (ma * e[:, h:now][:, ::-1]).sum(axis=1)
        y[:, back + h] = v[:, now] + centre - y[:, h : back + h][:, ::-1] @ weights[1:]
    return y[:, back:]


def _flat(tail: np.ndarray, steps: int, status: str) -> dict:
    """Result of a series that is not fitted: its last price, and why in ``status``."""
    path = np.full(steps, np.exp(tail[-1])).tolist() if len(tail) else None
    return {
        "p": 0, "q": 0, "seasonal_p": 0, "seasonal_q": 0, "aicc": None, "ar": [], "ma": [], "path": path, "status": status,
    }


def _fit_alike(d: int, seasonal_d: int, long: int, steps: int, gamma, n, centre, tail) -> list[dict]:
    """Fits and paths of series of the same differencing, filter length, tail length and steps."""
    weights = _difference_weights(d, seasonal_d)
    moments, filt = _moments(gamma, long)
    known = np.isfinite(filt).all(axis=1)
    best, ar, ma, aicc = _search(np.where(known[:, None, None], moments, 0.0), n)
    with np.errstate(over="ignore", invalid="ignore"):
        paths = np.exp(_forecast(ar, ma, np.where(known[:, None], filt, 0.0), weights, centre, tail, steps))
    orders = _candidates()
    out = []
    for i, c in enumerate(best.tolist()):
        if c < 0 or not known[i]:
            out.append(_flat(tail[i], steps, "no candidate"))
        elif not np.isfinite(paths[i]).all():
            out.append(_flat(tail[i], steps, "not finite"))
        else:
            p, q, sp, sq = orders[c]
            out.append(
                {
                    "p": p, "q": q, "seasonal_p": sp, "seasonal_q": sq, "aicc": float(aicc[i]), "ar": ar[i].tolist(),
                    "ma": ma[i].tolist(), "path": paths[i].tolist(), "status": "fitted",
                }
            )
    return out


def _fit_batch(
    d: pd.Series,
    seasonal_d: pd.Series,
    centre: pd.Series,
    n: pd.Series,
    covariances: pd.Series,
    tail: pd.Series,
    steps: pd.Series,
) -> pd.DataFrame:
    """Fits of a batch of series. Series that share a shape are fitted together, as stacked systems."""
    tails = [np.asarray(t, dtype=float) for t in tail]
    gamma = np.stack([np.asarray(c, dtype=float) for c in covariances]) / np.maximum(n.to_numpy(float), 1)[:, None]
    out: list = [None] * len(tails)
    alike: dict[tuple, list[int]] = {}
    for i, (dd, sd, size, ahead) in enumerate(zip(d.tolist(), seasonal_d.tolist(), n.tolist(), steps.tolist())):
        long = min(LONG_AR, int(size) // 5)  # a short series carries a shorter autoregression
        if gamma[i, 0] <= 1e-16:
            out[i] = _flat(tails[i], ahead, "constant")
        elif long < 1 or len(tails[i]) < 1 + dd + SEASON * sd + long:
            out[i] = _flat(tails[i], ahead, "too short")
        else:
            alike.setdefault((dd, sd, long, ahead, len(tails[i])), []).append(i)
    size, middle = n.to_numpy(float), centre.to_numpy(float)
    for (dd, sd, long, ahead, _), rows in alike.items():
        stacked = np.stack([tails[i] for i in rows])
        fitted = _fit_alike(dd, sd, long, ahead, gamma[rows], size[rows], middle[rows], stacked)
        for i, result in zip(rows, fitted):
            out[i] = result
    return pd.DataFrame(out)


def fit_sarima(
    rows: DataFrame, steps: Column, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Order, parameters and price path of every series of ``daily_logs`` rows."""
    summary = summarise(with_difference_order(with_seasonal_order(rows, keys), keys), keys)
    solve = F.pandas_udf(_fit_batch, FIT_TYPE)
    inputs = ("d", "seasonal_d", "centre", "n", "covariances", "tail")
    return summary.withColumn("fit", solve(*inputs, steps.cast("int"))).select(
        *keys, "last_date", "d", "seasonal_d", "fit.*"
    )
