"""Operational forecasts and backtests of whole panels.

One plan covers all series and horizons: prepare the series, cut the training
days, fit both models, blend, label. The panel is exchanged once, on the series;
everything after that stays in the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch.config import DEFAULT, Settings
from pricewatch.functions import literals
from pricewatch.operators import calendar, closed_form, flat_tail, moment_blocks, sarima, seasonal_map
from pricewatch.operators.regularise import (
    Filling,
    explode_days,
    price_on,
    regularise,
    segments,
    with_tails,
)

CUT_KEYS = ("series_id", "train_end")


def filling(settings: Settings = DEFAULT) -> Filling:
    return Filling(limit=settings.interpolation_limit)


def panel_partitions(spark: SparkSession) -> int:
    """A quarter of the shuffle partitions, but four for each core; at most all of them.

    A task that fits series takes about 0.5 GB however few it has, so more partitions would only cost time.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(most // 4, 4 * spark.sparkContext.defaultParallelism))


def place(obs: DataFrame) -> DataFrame:
    """The panel in partitions by series, for plans that read it more than once.

    Rows without a series or a date are no rows of any series. Dropping them
    here keeps the filters that joins and cut-offs would infer from making the
    reads differ.

    The partitions are given by number, so small ones are not merged: a series
    is few bytes here, but its cells and segments take a hundred times as many
    in the task that fits it.
    """
    parts = panel_partitions(obs.sparkSession)
    return (
        obs.filter(F.col("series_id").isNotNull() & F.col("date").isNotNull())
        .select("series_id", "date", "price")
        .repartition(parts, "series_id")
    )


def prepare(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Daily series for the forecast path: zero is missing, gaps filled up to the limit."""
    return regularise(obs, fill=filling(settings)).select("series_id", "date", "price")


def _with_cuts(segs: DataFrame, cuts: Column) -> DataFrame:
    """Segments once per cut-off; ``cut_last`` is the last training day of the series."""
    return segs.withColumn("train_end", F.explode(cuts)).withColumn(
        "cut_last", F.least("last_date", "train_end")
    )


def flat_days_by_cut(segs: DataFrame, cuts: Column, fill: Filling) -> DataFrame:
    """``flat_days`` per series as a map from the cut-off.

    Only the last 59 days before each cut-off are exploded.
    """
    day = F.col("day")
    tail = explode_days(
        _with_cuts(segs, cuts),
        first=F.date_sub("cut_last", flat_tail.TAIL_ROWS - 1),
        last=F.col("cut_last"),
    ).select(
        *CUT_KEYS,
        price_on(day, fill).alias("price"),
        (F.datediff("cut_last", day) + 1).alias("rn"),
        (F.datediff("cut_last", "first_date") + 1).alias("n_priced"),
    )
    found = flat_tail.first_moving(tail.filter(F.col("price").isNotNull()), CUT_KEYS)
    return found.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("train_end", "flat_days"))).alias("flat_days")
    )


def _fits(segs: DataFrame, fill: Filling, trim: bool = False) -> DataFrame:
    """Blend parameters of segments with ``train_end`` and ``cut_last``."""
    last = F.col("cut_last")
    days = closed_form.lagged_days(
        segs, CUT_KEYS, fill, last=last, carry=("base_price", "cut_last")
    )
    return closed_form.fit_hybrid(days, CUT_KEYS, F.col("train_end"), last if trim else None)


def _cut_segments(obs: DataFrame, items, settings: Settings) -> DataFrame:
    """Segments with tails, once per cut-off; ``cut_last`` is the last training day."""
    fill = filling(settings)
    cuts = literals.dates(item.train_end for item in items)
    return _with_cuts(with_tails(segments(obs, fill=fill), fill=fill), cuts)


def _trimmed_segments(obs: DataFrame, settings: Settings) -> DataFrame:
    """:func:`_cut_segments` of the operational horizons, ended before the flat tail."""
    fill = filling(settings)
    cuts = literals.dates(h.train_end for h in settings.horizons)
    segs = segments(obs, fill=fill)
    # Joined before the cut-offs multiply the rows: the segments are still
    # sorted by series here.
    flat = flat_days_by_cut(segs, cuts, fill)
    train = _with_cuts(with_tails(segs, fill=fill).join(flat, "series_id", "left"), cuts)
    n_rows = F.datediff("cut_last", "first_date") + 1
    found = F.coalesce(F.col("flat_days")[F.col("train_end")], F.lit(0))
    return train.withColumn(
        "cut_last", F.date_sub("cut_last", flat_tail.trimmed_days(found, n_rows))
    ).drop("flat_days")


def operational_fits(
    obs: DataFrame, settings: Settings = DEFAULT, trim: bool = True
) -> DataFrame:
    """Blend parameters per series and horizon, after trimming flat tails."""
    fits = _fits(_cut_segments(place(obs), settings.horizons, settings), filling(settings), trim)
    return calendar.horizons_of_cut(fits, settings.horizons, settings)


def backtest_fits(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Blend parameters per series and backtest window; flat tails are kept."""
    fits = _fits(_cut_segments(place(obs), settings.eval_windows, settings), filling(settings))
    return calendar.horizons_of_cut(fits, settings.eval_windows, settings)


def blend(arima: Column, seasonal: Column) -> Column:
    """Weighted sum with the weights of the horizon."""
    return arima * F.col("w_arima") + seasonal * F.col("w_seasonal")


def blended_at(step: Column) -> tuple[Column, Column, Column]:
    """(yhat, lower, upper) of the blend; the band comes from the seasonal model."""
    arima = closed_form.ari_at(step)
    return tuple(blend(arima, part) for part in closed_form.seasonal_at(step))


def _select(rows: DataFrame, model: str, step: Column, day: Column, *extra: Column) -> DataFrame:
    yhat, lower, upper = blended_at(step)
    return rows.select(
        "series_id",
        "horizon",
        F.lit(model).alias("model"),
        F.col("step").cast("int").alias("step"),
        day.alias("forecast_date"),
        yhat.alias("yhat"),
        lower.alias("yhat_lower"),
        upper.alias("yhat_upper"),
        *extra,
    )


def forecast_operational(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Forecast of every horizon, labelled by position from ``train_end + 1``.

    The labels ignore where the training rows end, so a trimmed or short series
    is forecast under shifted dates; ``origin_gap_days`` tells by how much.
    """
    return operational_rows(calendar.with_steps(operational_fits(obs, settings)))


def operational_rows(rows: DataFrame) -> DataFrame:
    """Forecast rows of fitted parameters, one per step."""
    gap = F.datediff("train_end", "last_date").alias("origin_gap_days")
    return _select(rows, "hybrid", F.col("step"), calendar.label(F.col("step")), gap)


def forecast_endpoints(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Only the last step of each operational forecast, as the risk score needs it."""
    rows = operational_fits(obs, settings).withColumn("step", F.col("steps"))
    return _select(rows, "hybrid", F.col("step"), calendar.label(F.col("step")))


def forecast_backtest(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Backtest forecasts on the test calendar, aligned by date.

    The models count steps from the last training row. Test days beyond their
    last step have no forecast and stay null.
    """
    return backtest_rows(calendar.with_steps(backtest_fits(obs, settings)))


def forecast_backtest_from_blocks(blocks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """:func:`forecast_backtest` from moment blocks; no day of the panel is read."""
    cuts = [w.train_end for w in settings.eval_windows]
    fits = moment_blocks.fits(blocks, cuts, filling(settings))
    return backtest_rows(calendar.with_steps(calendar.horizons_of_cut(fits, settings.eval_windows, settings)))


def backtest_rows(rows: DataFrame) -> DataFrame:
    """Forecast rows of fitted parameters on the test calendar, one per step."""
    day = calendar.label(F.col("step"))
    ahead = F.datediff(day, "last_date")
    known = (ahead >= 1) & (ahead <= F.col("steps"))
    return _select(rows, "hybrid", F.when(known, ahead), day)


def _searched_paths(train: DataFrame, fill: Filling, steps: int) -> DataFrame:
    """Price paths of the order-searched and the changepoint model per series and cut-off."""
    last = F.col("cut_last")
    arima = sarima.fit_sarima(
        sarima.daily_logs(train, CUT_KEYS, fill, last), F.lit(steps), CUT_KEYS
    ).select(*CUT_KEYS, F.col("path").alias("arima_path"))
    rows = explode_days(train, last=last).select(
        *CUT_KEYS,
        F.col("day").alias("date"),
        price_on(F.col("day"), fill).alias("price"),
        F.lit(steps).alias("steps"),
    )
    seasonal = seasonal_map.fit_seasonal_map(rows, CUT_KEYS)
    return seasonal.join(arima, list(CUT_KEYS), "left")  # a failed search leaves its path empty


def _stepped(paths: DataFrame, ahead: Column) -> DataFrame:
    """One row per horizon and step; ``ahead`` is the step of the models behind it."""

    def blended(name: str) -> Column:
        at = F.col("_ahead") - 1
        return blend(F.get(F.col("arima_path"), at), F.get(F.col(name), at)).alias(name)

    return calendar.with_steps(paths).withColumn("_ahead", ahead).select(
        "series_id",
        "horizon",
        F.lit("hybrid").alias("model"),
        F.col("step").cast("int").alias("step"),
        calendar.label(F.col("step")).alias("forecast_date"),
        *[blended(name) for name in ("yhat", "yhat_lower", "yhat_upper")],
        F.datediff("train_end", "last_date").alias("origin_gap_days"),
    )


def forecast_operational_searched(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """:func:`forecast_operational` with searched orders and changepoints.

    The same rows, labels and weights; only the two models are the larger ones.
    """
    train = _trimmed_segments(obs, settings)
    paths = _searched_paths(train, filling(settings), max(h.days for h in settings.horizons))
    rows = calendar.horizons_of_cut(paths, settings.horizons, settings)
    return _stepped(rows, F.col("step"))


def backtest_paths(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Paths of both larger models per series and backtest window."""
    train = _cut_segments(obs, settings.eval_windows, settings)
    paths = _searched_paths(train, filling(settings), max(w.days for w in settings.eval_windows))
    return calendar.horizons_of_cut(paths, settings.eval_windows, settings)


def forecast_backtest_searched(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """:func:`forecast_backtest` with searched orders and changepoints."""
    rows = backtest_paths(obs, settings)
    ahead = F.datediff(calendar.label(F.col("step")), "last_date")
    known = (ahead >= 1) & (ahead <= F.col("steps"))
    return _stepped(rows, F.when(known, ahead)).drop("origin_gap_days")
