"""Closed-form forecasts: log-difference AR(1) and trend plus seasonality.

Each series is reduced to at most 84 (month, weekday) cells of moments by one
hash aggregation; both models follow from those cells. No window, sort or join
runs over the training rows, no Python is involved, and rows are combined before
any shuffle. A fit is one row of parameters; forecasts are expressions over it.

Cell moments are kept as means and centred sums, which stay exact for constant
and trending series where raw sums of squares would cancel.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.operators.flat_tail import TAIL_ROWS, trim_cells
from pricewatch.operators.regularise import (
    FORECAST,
    KEYS,
    Filling,
    explode_days,
    price_before,
    price_on,
    with_tails,
)

# Normal quantile of a two-sided 95 % interval.
Z95 = 1.959964
# Autoregressive coefficients are kept inside the stationary range.
PHI_MAX = 0.999
# Differences that vary less than this share of their square sum do not vary.
FLAT_SHARE = 1e-12
MONTHS = 12
WEEKDAYS = 7
# Day 0 of the time axis while moments are gathered.
ORIGIN = date(2000, 1, 1)


def lagged_days(
    segs: DataFrame,
    keys: Sequence[str] = KEYS,
    fill: Filling = FORECAST,
    last: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Daily rows up to ``last`` with the prices one and two days earlier.

    ``segs`` are segments with tails (``regularise.with_tails``); ``carry``
    names more of their columns to keep.
    """
    day = F.col("day")
    return explode_days(segs, last=last).select(
        *keys,
        day.alias("date"),
        price_on(day, fill).alias("price"),
        price_before(day, 1, fill).alias("price_1"),
        price_before(day, 2, fill).alias("price_2"),
        *carry,
    )


def _log(name: str) -> Column:
    return F.when(F.col(name) > 0, F.ln(name))


def _ari_sums() -> dict[str, Column]:
    """Moments of ``dy(t)`` against ``dy(t-1)``, and the last level and difference."""
    y, dy, dx = F.col("y"), F.col("dy"), F.col("dx")
    pair = dx.isNotNull() & dy.isNotNull()
    return {
        "k": F.count(F.when(pair, F.lit(1))),
        "sx": F.sum(F.when(pair, dx)),
        "sy": F.sum(F.when(pair, dy)),
        "sxx": F.sum(F.when(pair, dx * dx)),
        "sxy": F.sum(F.when(pair, dx * dy)),
        "y_last": F.max_by(y, "date"),
        "d_last": F.max_by(dy, "date"),
        "last_date": F.max("date"),
    }


def _with_differences(rows: DataFrame) -> DataFrame:
    y, y1, y2 = _log("price"), _log("price_1"), _log("price_2")
    return rows.withColumns({"y": y, "dy": y - y1, "dx": y1 - y2})


def _solve_ari(sums: DataFrame) -> DataFrame:
    """``phi`` and ``mu = c / (1 - phi)`` of ``dy(t) = c + phi * dy(t-1)``.

    A series whose differences do not vary has no slope and is forecast flat.
    """
    k = F.when(F.col("k") > 1, F.col("k"))
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / k
    varies = spread > F.col("sxx") * FLAT_SHARE
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / k) / F.when(varies, spread)
    bounded = F.greatest(F.lit(-PHI_MAX), F.least(F.col("_slope"), F.lit(PHI_MAX)))
    # The intercept belongs to the bounded slope, else momentum survives the bound.
    intercept = (F.col("sy") - bounded * F.col("sx")) / k
    known = F.col("_slope").isNotNull()
    return (
        sums.withColumn("_slope", slope)
        .withColumns(
            {
                "phi": F.when(known, bounded).otherwise(F.lit(0.0)),
                "mu": F.when(known, intercept / (1 - bounded)).otherwise(F.lit(0.0)),
                "d_last": F.when(known, F.col("d_last")).otherwise(F.lit(0.0)),
            }
        )
        .drop("_slope", "k", "sx", "sy", "sxx", "sxy")
    )


def fit_ari(
    segs: DataFrame, keys: Sequence[str] = KEYS, fill: Filling = FORECAST
) -> DataFrame:
    """One row per series: ``last_date``, ``y_last``, ``d_last``, ``phi``, ``mu``."""
    rows = _with_differences(lagged_days(with_tails(segs, keys, fill), keys, fill))
    sums = (
        rows.filter(F.col("y").isNotNull())
        .groupBy(*keys)
        .agg(*[value.alias(name) for name, value in _ari_sums().items()])
    )
    return _solve_ari(sums)


def ari_at(step: Column) -> Column:
    """Price ``step`` days after the last training day."""
    phi, mu = F.col("phi"), F.col("mu")
    momentum = (F.col("d_last") - mu) * phi * (1 - F.pow(phi, step)) / (1 - phi)
    return F.exp(F.col("y_last") + step * mu + momentum)


def _trend_moments(target: Column) -> dict[str, Column]:
    t = F.datediff("date", F.lit(ORIGIN)).cast("double")
    n = F.count(target)
    return {
        "n": n,
        "t_mean": F.avg(F.when(target.isNotNull(), t)),
        "z_mean": F.avg(target),
        "t_dev": F.var_pop(F.when(target.isNotNull(), t)) * n,
        "z_dev": F.var_pop(target) * n,
        "tz_dev": F.covar_pop(t, target) * n,
        "last_date": F.max("date"),
    }


def _cells(
    rows: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], *extra: str
) -> DataFrame:
    return rows.groupBy(
        *keys, F.month("date").alias("month"), F.dayofweek("date").alias("weekday"), *extra
    ).agg(*[value.alias(name) for name, value in aggregates.items()])


def fold_seasons(cells: DataFrame, keys: Sequence[str], ari: bool = False) -> DataFrame:
    """Parameters of each series from its cells.

    Least-squares trend first, then month means of the residuals, then weekday
    means of what is left; ``sigma`` is the spread of the rest. ``level`` is the
    trend value on the last training day.
    """
    series = Window.partitionBy(*keys)
    by_month = Window.partitionBy(*keys, "month")
    by_weekday = Window.partitionBy(*keys, "weekday")
    n, t, z = F.col("n"), F.col("t_mean"), F.col("z_mean")
    t_off, z_off = t - F.col("t_all"), z - F.col("z_all")
    rest = F.col("r") - F.col("m") - F.col("w")
    sse = F.sum(
        F.col("z_dev")
        - 2 * F.col("slope") * F.col("tz_dev")
        + F.col("slope") * F.col("slope") * F.col("t_dev")
        + n * rest * rest
    )
    aggregates = {
        "_last": F.max("last_date"),
        "slope": F.first("slope"),
        "_a": F.first("a"),
        "n_train": F.sum("n"),
        "month_effect": F.array(
            *[F.max(F.when(F.col("month") == i, F.col("m"))) for i in range(1, MONTHS + 1)]
        ),
        "weekday_effect": F.array(
            *[F.max(F.when(F.col("weekday") == i, F.col("w"))) for i in range(1, WEEKDAYS + 1)]
        ),
        "_sse": sse,
    }
    if ari:
        aggregates |= {name: F.sum(name) for name in ("k", "sx", "sy", "sxx", "sxy")}
        aggregates |= {name: F.max_by(name, "last_date") for name in ("y_last", "d_last")}
    days = F.datediff("_last", F.lit(ORIGIN))
    folded = (
        cells.filter(n > 0)
        .withColumns(
            {
                "n_all": F.sum("n").over(series),
                "t_all": F.sum(n * t).over(series) / F.sum("n").over(series),
                "z_all": F.sum(n * z).over(series) / F.sum("n").over(series),
            }
        )
        .withColumns(
            {
                "_tt": F.sum(F.col("t_dev") + n * t_off * t_off).over(series),
                "_tz": F.sum(F.col("tz_dev") + n * t_off * z_off).over(series),
            }
        )
        .withColumn(
            "slope",
            F.when(F.col("_tt") > 0, F.col("_tz") / F.col("_tt")).otherwise(F.lit(0.0)),
        )
        .withColumn("a", F.col("z_all") - F.col("slope") * F.col("t_all"))
        .withColumn("r", z - F.col("a") - F.col("slope") * t)
        .withColumn("m", F.sum(n * F.col("r")).over(by_month) / F.sum("n").over(by_month))
        .withColumn(
            "w",
            F.sum(n * (F.col("r") - F.col("m"))).over(by_weekday) / F.sum("n").over(by_weekday),
        )
        .groupBy(*keys)
        .agg(*[value.alias(name) for name, value in aggregates.items()])
        .withColumns(
            {
                "last_date": F.col("_last"),
                "level": F.col("_a") + F.col("slope") * days,
                "sigma": F.when(
                    F.col("n_train") > 1,
                    F.sqrt(F.greatest(F.col("_sse"), F.lit(0.0)) / (F.col("n_train") - 1)),
                ).otherwise(F.lit(0.0)),
            }
        )
        .drop("_last", "_a", "_sse")
    )
    return _solve_ari(folded) if ari else folded


def fit_seasonal(rows: DataFrame, keys: Sequence[str] = KEYS, log: bool = False) -> DataFrame:
    """Trend plus month-of-year and weekday effects; ``log`` fits ln(price + 1).

    Works on any rows with ``date`` and ``price``; rows without a price are skipped.
    """
    target = F.log1p("price") if log else F.col("price")
    return fold_seasons(_cells(rows, keys, _trend_moments(target)), keys)


def fit_seasonal_variants(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both variants in one job; the column ``model`` is ``no_log`` or ``log``."""
    both = rows.withColumn("model", F.explode(F.array(F.lit("no_log"), F.lit("log"))))
    target = F.when(F.col("model") == "log", F.log1p("price")).otherwise(F.col("price"))
    keyed = (*keys, "model")
    return fold_seasons(_cells(both, keyed, _trend_moments(target)), keyed)


def _centred_sums(at: Column) -> dict[str, Column]:
    """Plain sums around ``base_price`` and the day ``at``, both constant per series."""
    t = F.datediff("date", at).cast("double")
    z = F.col("price") - F.col("base_price")
    return {
        "n": F.count("price"),
        "_t": F.sum(t),
        "_z": F.sum(z),
        "_tt": F.sum(t * t),
        "_zz": F.sum(z * z),
        "_tz": F.sum(t * z),
        "_base": F.first("base_price"),
    }


def _moments_of_sums(cells: DataFrame, at: Column) -> DataFrame:
    """The columns of :func:`_trend_moments` from centred sums."""
    n, t, z = F.col("n"), F.col("_t"), F.col("_z")
    return cells.withColumns(
        {
            "t_mean": t / n + F.datediff(at, F.lit(ORIGIN)),
            "z_mean": z / n + F.col("_base"),
            "t_dev": F.col("_tt") - t * t / n,
            "z_dev": F.col("_zz") - z * z / n,
            "tz_dev": F.col("_tz") - t * z / n,
        }
    ).drop("_t", "_z", "_tt", "_zz", "_tz", "_base")


def fit_hybrid(
    days: DataFrame, keys: Sequence[str], at: Column, last: Column | None = None
) -> DataFrame:
    """Both models of the blend from the same lagged days, in one aggregation.

    ``days`` carry ``base_price``; ``at`` is a day constant per group. With
    ``last``, the last training day, flat tails are trimmed: the few days that
    may be dropped stay cells of their own until the tail is known.

    This is the widest loop of the engine, so its sums are plain ones; centred
    on a price and a day of the series they keep their precision.
    """
    aggregates = {**_centred_sums(at), **_ari_sums()}
    rows = _with_differences(days.filter(F.col("price").isNotNull()))
    extra = ()
    if last is not None:
        rn = F.datediff(last, "date") + 1
        rows = rows.withColumn("tail_rn", F.when(rn <= TAIL_ROWS, rn).otherwise(0))
        extra = ("tail_rn",)
    cells = _moments_of_sums(_cells(rows, keys, aggregates, *extra), at)
    if last is not None:
        cells = trim_cells(cells, keys)
    return fold_seasons(cells, keys, ari=True)


def seasonal_part(step: Column) -> Column:
    """Model-scale value ``step`` days after ``last_date``; unseen months count as 0."""
    day = F.date_add("last_date", step.cast("int"))
    return (
        F.col("level")
        + F.col("slope") * step
        + F.coalesce(F.element_at("month_effect", F.month(day)), F.lit(0.0))
        + F.coalesce(F.element_at("weekday_effect", F.dayofweek(day)), F.lit(0.0))
    )


def seasonal_at(step: Column, log: Column | bool = False) -> tuple[Column, Column, Column]:
    """(yhat, lower, upper) with a 95 % interval, back on the price scale."""
    centre = seasonal_part(step)
    half = Z95 * F.col("sigma")
    values = (centre, centre - half, centre + half)
    if log is False:
        return values
    if log is True:
        return tuple(F.expm1(v) for v in values)
    return tuple(F.when(log, F.expm1(v)).otherwise(v) for v in values)
