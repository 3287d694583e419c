"""Additive trend-and-seasonality model with changepoints, one fit per series.

Piecewise-linear trend with 25 possible slope changes in the first 80 % of the
history, yearly (10) and weekly (3) Fourier terms, fitted as a posterior mode:
Gaussian priors on the seasonal terms, a Laplace prior on the slope changes
(Taylor and Letham, "Forecasting at scale", 2018). The Laplace prior is handled by
reweighted ridge regressions. ``log`` fits ln(price + 1) with seasonality
proportional to the trend.

The additive fit needs the days only through the products of its columns. Days
stream through the partition of their series in order of date, and what is kept is
one matrix of some fifty columns for the series at hand; a series leaves as that
matrix, and all series of a batch are solved as stacked systems. Knots are days of
the calendar, so they follow from the first day and the number of days.

With ``log`` the seasonality multiplies the trend, which no fixed matrix tells: that
variant is a grouped-map function over the calendar days of one series and cut-off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.operators.regularise import KEYS

# Model size and prior scales.
CHANGEPOINTS = 25
CHANGE_SHARE = 0.8
YEARLY_TERMS = 10
WEEKLY_TERMS = 3
YEAR_DAYS = 365.25
WEEK_DAYS = 7.0
TREND_SCALE = 5.0
CHANGE_SCALE = 0.05
SEASON_SCALE = 10.0
Z95 = 1.959964
ROUNDS = 12

_SOLVED = ("first_day", "last_day", "n", "scale", "steps", "gram")
RESULT = (
    "last_date date, yhat array<double>, yhat_lower array<double>, yhat_upper array<double>"
)


def _seasonal(days: np.ndarray) -> np.ndarray:
    """Fourier columns of day numbers."""
    columns = []
    for period, terms in ((YEAR_DAYS, YEARLY_TERMS), (WEEK_DAYS, WEEKLY_TERMS)):
        for k in range(1, terms + 1):
            angle = 2 * np.pi * k * days / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def _trend(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Level, slope and slope-change columns on scaled time."""
    return np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - knots[None, :], 0.0)])


def _solve(x: np.ndarray, y: np.ndarray, scales: np.ndarray, changes: slice) -> tuple:
    """Posterior mode and noise variance."""
    square, cross = x.T @ x, x.T @ y
    beta = np.zeros(x.shape[1])
    precision = 1.0 / scales**2
    noise = max(float(np.var(y)), 1e-8)
    for _ in range(ROUNDS):
        beta = np.linalg.solve(square + np.diag(noise * precision), cross)
        precision[changes] = 1.0 / (CHANGE_SCALE * np.maximum(np.abs(beta[changes]), 1e-6))
        miss = y - x @ beta
        noise = max(float(miss @ miss) / len(y), 1e-12)
    return beta, noise


def knot_places(n: int) -> np.ndarray:
    """Places of the possible slope changes among ``n`` days."""
    count = min(CHANGEPOINTS, max(int(n * CHANGE_SHARE) - 1, 0))
    return np.linspace(0, int(n * CHANGE_SHARE) - 1, count + 1).round().astype(int)[1:] if count else np.zeros(0, int)


def _columns(days: np.ndarray, first: float, span: float, knots: np.ndarray) -> np.ndarray:
    """Columns of the additive model on day numbers; ``knots`` are days."""
    return np.hstack([_trend((days - first) / span, (knots - first) / span), _seasonal(days)])


def _matrices(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Product sums of every series from rows that arrive by series and date.

    Rows carry ``first_day``, ``last_day``, ``n`` and ``scale`` of their series. Only the matrix of the series
    at hand is kept from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, total = None, None, None

        def closed() -> pa.RecordBatch:
            return held.append_column("gram", pa.array([total.ravel()], pa.list_(pa.float64())))

        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            days, price = (batch.column(c).to_numpy().astype(float) for c in ("day_no", "price"))
            for a, b in zip(cuts, cuts[1:]):
                if names[a] != current:
                    if held is not None:
                        yield closed()
                    current, held, total = names[a], batch.slice(a, 1).drop_columns(["day_no", "price"]), 0.0
                first, last, n, scale = (held.column(c)[0].as_py() for c in ("first_day", "last_day", "n", "scale"))
                x = _columns(days[a:b], first, max(float(last - first), 1.0), first + knot_places(n))
                x = np.hstack([x, price[a:b, None] / scale])
                total = total + x.T @ x
        if held is not None:
            yield closed()

    return run


def _mode(gram: np.ndarray, n: np.ndarray, knots: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, noise variance) of stacked series with the same number of knots.

    The last column of each matrix is the target; squared misses come from the same sums.
    """
    square, cross, power = gram[:, :-1, :-1], gram[:, :-1, -1], gram[:, -1, -1]
    width = square.shape[1]
    scales = np.array([TREND_SCALE] * 2 + [CHANGE_SCALE] * knots + [SEASON_SCALE] * (width - 2 - knots))
    precision = np.tile(1.0 / scales**2, (len(gram), 1))
    changes = slice(2, 2 + knots)
    noise = np.maximum(power / n - (cross[:, 0] / n) ** 2, 1e-8)
    for _ in range(ROUNDS):
        beta = np.linalg.solve(square + np.eye(width) * (noise[:, None] * precision)[:, None, :], cross[..., None])[..., 0]
        precision[:, changes] = 1.0 / (CHANGE_SCALE * np.maximum(np.abs(beta[:, changes]), 1e-6))
        miss = power - 2 * (beta * cross).sum(axis=1) + np.einsum("si,sij,sj->s", beta, square, beta)
        noise = np.maximum(miss / n, 1e-12)
    return beta, noise


def _forecast_batch(batch: pd.DataFrame) -> pd.DataFrame:
    """Paths of a batch of series from their matrices."""
    out: list = [None] * len(batch)
    counts = [len(knot_places(n)) for n in batch["n"]]
    for knots in set(counts):
        rows = [i for i, k in enumerate(counts) if k == knots]
        width = 3 + knots + 2 * (YEARLY_TERMS + WEEKLY_TERMS)
        gram = np.stack([np.asarray(batch["gram"].iloc[i], dtype=float).reshape(width, width) for i in rows])
        beta, noise = _mode(gram, batch["n"].to_numpy(float)[rows], knots)
        for i, b, v in zip(rows, beta, noise):
            first, last, n, scale, steps = (batch[c].iloc[i] for c in ("first_day", "last_day", "n", "scale", "steps"))
            span = max(float(last - first), 1.0)
            future = float(last) + np.arange(1, int(steps) + 1)
            centre = _columns(future, float(first), span, first + knot_places(int(n))) @ b
            # Slopes keep changing at the historical rate and size.
            size = float(np.abs(b[2 : 2 + knots]).mean()) if knots else 0.0
            half = Z95 * np.sqrt(v + 2 * size**2 * knots * ((future - last) / span) ** 3 / 3)
            out[i] = [(scale * part).tolist() for part in (centre, centre - half, centre + half)]
    columns = ["yhat", "yhat_lower", "yhat_upper"]
    return pd.DataFrame(out, columns=columns)


def model_matrices(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Product sums of the additive model per series, with ``first_day``, ``last_day``, ``n``, ``scale``, ``steps``.

    ``rows`` have ``day_no``, ``price`` and ``steps``. They stay in the partitions of their series.
    """
    series = Window.partitionBy(*keys)
    known = rows.select(
        *keys, "day_no", "price", "steps",
        F.min("day_no").over(series).alias("first_day"),
        F.max("day_no").over(series).alias("last_day"),
        F.count(F.lit(1)).over(series).cast("int").alias("n"),
        F.greatest(F.max(F.abs("price")).over(series), F.lit(1e-12)).alias("scale"),
    ).sortWithinPartitions(*keys, "day_no")
    types = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields if f.name not in ("day_no", "price")
    )
    return known.mapInArrow(_matrices(keys), f"{types}, gram array<double>")


def fit_and_forecast(days: np.ndarray, y: np.ndarray, steps: int, log: bool) -> tuple:
    """(yhat, lower, upper) of the ``steps`` days after the last one."""
    order = np.argsort(days)
    days, y = days[order], y[order]
    future = days[-1] + np.arange(1, steps + 1)
    if log:
        y = np.log1p(y)
    scale = max(float(np.abs(y).max()), 1e-12)
    span = max(float(days[-1] - days[0]), 1.0)
    t, t_next = (days - days[0]) / span, (future - days[0]) / span
    knots = t[knot_places(len(y))]

    trend, trend_next = _trend(t, knots), _trend(t_next, knots)
    season, season_next = _seasonal(days), _seasonal(future)
    n_trend = trend.shape[1]
    scales = np.concatenate(
        [[TREND_SCALE] * 2, [CHANGE_SCALE] * len(knots), [SEASON_SCALE] * season.shape[1]]
    )
    changes = slice(2, n_trend)
    target = y / scale
    if log:
        # Seasonality multiplies the trend: solve for both around the last estimate.
        share, level = np.zeros(len(y)), np.full(len(y), target.mean())
        for _ in range(5):
            x = np.hstack([(1 + share)[:, None] * trend, level[:, None] * season])
            both, noise = _solve(x, target + level * share, scales, changes)
            beta, gamma = both[:n_trend], both[n_trend:]
            level, share = trend @ beta, season @ gamma
        centre = (trend_next @ beta) * (1 + season_next @ gamma)
    else:
        beta, noise = _solve(np.hstack([trend, season]), target, scales, changes)
        centre = np.hstack([trend_next, season_next]) @ beta
    # Slopes keep changing at the historical rate and size.
    size = float(np.abs(beta[changes]).mean()) if len(knots) else 0.0
    ahead = t_next - t[-1]
    drift = 2 * size**2 * len(knots) * ahead**3 / 3
    half = Z95 * np.sqrt(noise + drift)
    values = [scale * part for part in (centre, centre - half, centre + half)]
    return tuple(np.expm1(v) if log else v for v in values)


def _group_fit(keys: Sequence[str], log: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        days = group["day_no"].to_numpy(dtype=float)
        y = group["price"].to_numpy(dtype=float)
        yhat, lower, upper = fit_and_forecast(days, y, int(group["steps"].iloc[0]), log)
        last = pd.Timestamp(0) + pd.Timedelta(days=int(days.max()))
        return pd.DataFrame(
            {
                **{k: [group[k].iloc[0]] for k in keys},
                "last_date": [last.date()],
                "yhat": [yhat.tolist()],
                "yhat_lower": [lower.tolist()],
                "yhat_upper": [upper.tolist()],
            }
        )

    return fit


def fit_seasonal_map(rows: DataFrame, keys: Sequence[str] = KEYS, log: bool = False) -> DataFrame:
    """Forecast paths per series of rows with ``date``, ``price`` and ``steps``."""
    epoch = F.lit("1970-01-01").cast("date")
    slim = rows.filter(F.col("price").isNotNull()).select(
        *keys, F.datediff("date", epoch).alias("day_no"), "price", "steps"
    )
    if log:
        types = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
        return slim.groupBy(*keys).applyInPandas(_group_fit(keys, log), f"{types}, {RESULT}")
    solve = F.pandas_udf(
        lambda *c: _forecast_batch(pd.DataFrame(dict(zip(_SOLVED, c)))),
        "struct<yhat:array<double>,yhat_lower:array<double>,yhat_upper:array<double>>",
    )
    fitted = model_matrices(slim, keys).withColumn("_path", solve(*_SOLVED))
    return fitted.select(*keys, F.date_from_unix_date("last_day").alias("last_date"), "_path.*")
