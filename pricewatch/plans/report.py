"""Report frames of the dashboard."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.config import DEFAULT, Settings
from pricewatch.functions.numeric import half_even
from pricewatch.operators import calendar, metrics, rolling
from pricewatch.plans import evaluation, forecasting, risk

LINES = (
    "actual",
    "short_eval",
    "mid_eval",
    "long_eval",
    "long_prod",
    "long_lower",
    "long_upper",
)


def chart_prices(obs: DataFrame, chart_range: tuple[date, date]) -> DataFrame:
    """Actual prices inside the chart range (both ends included)."""
    start, end = chart_range
    return obs.filter(F.col("date").between(F.lit(start), F.lit(end))).select(
        "series_id", "date", "price"
    )


def placed_chart_prices(placed: DataFrame, chart_range: tuple[date, date]) -> DataFrame:
    """:func:`chart_prices` of a placed panel that others read too.

    The range is a condition on an exploded value: it stays above the exchange, which is then the same
    for all readers.
    """
    start, end = chart_range
    inside = F.when(F.col("date").between(F.lit(start), F.lit(end)), F.array(F.struct("date", "price")))
    return placed.select("series_id", F.explode(inside).alias("_p")).select("series_id", "_p.date", "_p.price")


def _loose(df: DataFrame) -> DataFrame:
    """``df`` with a computed key, for stacking it on another frame.

    A union of equally placed parts is zipped partition by partition, while adaptive execution may have
    merged the partitions of one part differently. Parts of unknown placement are simply appended.
    """
    return df.withColumn("series_id", F.concat("series_id", F.lit("")))


def timeline(prices: DataFrame, backtest: DataFrame, operational: DataFrame) -> DataFrame:
    """All chart lines on the union of their dates, null where a line has no value.

    The lines are stacked and spread again by one aggregation; five joins on the
    date list would shuffle each line.
    """
    prices = _loose(prices)
    day = F.col("forecast_date").alias("date")
    long_run = operational.filter(F.col("horizon") == "long")
    stacked = prices.select("series_id", "date", F.lit("actual").alias("line"), F.col("price").alias("value"))
    stacked = stacked.unionByName(
        backtest.select(
            "series_id",
            day,
            F.concat(F.col("horizon"), F.lit("_eval")).alias("line"),
            F.col("yhat").alias("value"),
        )
    ).unionByName(
        long_run.select(
            "series_id",
            day,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(line).alias("line"), F.col(column).alias("value"))
                        for line, column in (
                            ("long_prod", "yhat"),
                            ("long_lower", "yhat_lower"),
                            ("long_upper", "yhat_upper"),
                        )
                    ]
                )
            ).alias("_v"),
        ).select("series_id", "date", "_v.line", "_v.value")
    )
    return stacked.groupBy("series_id", "date").agg(
        *[F.max(F.when(F.col("line") == line, F.col("value"))).alias(line) for line in LINES]
    )


def forecast_summary(backtest: DataFrame, obs: DataFrame) -> DataFrame:
    """Average, error and first date of each backtest forecast.

    The average skips missing values (none -> 0); the error is 0.0 without
    overlap or when a matched day has no forecast.
    """
    actual = obs.filter(F.col("price").isNotNull()).select(
        "series_id", F.col("date").alias("forecast_date"), "price"
    )
    rows = backtest.join(actual, ["series_id", "forecast_date"], "left")
    error = metrics.mape(F.col("price"), F.col("yhat"))
    return rows.groupBy("series_id", "horizon").agg(
        F.coalesce(half_even(F.avg("yhat"), 2), F.lit(0.0)).alias("avg_forecast"),
        metrics.mape_or_zero(error).alias("mape"),
        F.min("forecast_date").alias("forecast_start"),
    )


def backtest_summary(placed: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """:func:`forecast_summary` of a placed panel, read once.

    Both numbers come from the same fits:
    the average over their steps, the error over the test days of the panel.
    """
    fits = forecasting.backtest_fits(placed, settings)
    keys = ["series_id", "horizon"]
    steps = forecasting.backtest_rows(calendar.with_steps(fits)).groupBy(*keys).agg(
        F.coalesce(half_even(F.avg("yhat"), 2), F.lit(0.0)).alias("avg_forecast"),
        F.min("forecast_date").alias("forecast_start"),
    )
    error = metrics.mape(F.col("price"), F.col("yhat"))
    days = evaluation.dated_pairs(placed, fits, settings).groupBy(*keys).agg(error.alias("_error"))
    return steps.join(days, keys, "left").select(
        *keys, "avg_forecast", metrics.mape_or_zero(F.col("_error")).alias("mape"), "forecast_start"
    )


def risk_cards(rows: DataFrame) -> DataFrame:
    """Card per series and horizon from risk rows."""
    return rows.select(
        "series_id",
        "horizon",
        "risk_level",
        "risk_score",
        half_even(F.col("fdi_value"), 3).alias("fdi_value"),
        half_even(F.col("vol_ratio"), 2).alias("vol_ratio"),
        "direction",
        "risk_message",
    )


def latest_risk(history: DataFrame) -> DataFrame:
    """Newest stored row per series and horizon; equal times go to the higher row number."""
    newest = F.struct("created_at", "row_no")
    columns = [c for c in history.columns if c not in ("series_id", "horizon")]
    return (
        history.groupBy("series_id", "horizon")
        .agg(F.max_by(F.struct(*columns), newest).alias("_r"))
        .select("series_id", "horizon", "_r.*")
    )


def dashboard(obs: DataFrame, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Every frame of the dashboard, from one placed panel. All are lazy."""
    placed = forecasting.place(obs)
    prices = placed_chart_prices(placed, settings.chart_range)
    backtest = forecasting.forecast_backtest(placed, settings)
    operational = forecasting.forecast_operational(placed, settings)
    start, end = settings.chart_range
    assessed = risk.score(
        risk.with_forecast(
            risk.historical_features(placed, settings),
            forecasting.forecast_endpoints(placed, settings),
            settings,
        )
    )
    return {
        "prices": prices,
        "timeline": timeline(prices, backtest, operational),
        "volatility": rolling.volatility_series(placed, start, end),
        "summary": backtest_summary(placed, settings),
        "forecast": operational,
        "risk": assessed,
        "cards": risk_cards(assessed),
    }


#: Frames of the payload and what orders their rows.
_PARTS = {"timeline": "date", "volatility": "date", "summary": "horizon", "forecast": "horizon", "cards": "horizon"}


def payload(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The whole dashboard as one nested row per series: an array of rows for every frame.

    All frames read one placed panel and are nested in the partitions they are in; a series' arrays
    are as long as its calendar, whatever the number of raw rows. A frame without rows of a series is
    an empty array.
    """
    frames = dashboard(obs, settings)
    whole = None
    for name, first in _PARTS.items():
        frame = frames[name]
        rest = [c for c in frame.columns if c not in ("series_id", first)]
        rows = F.sort_array(F.collect_list(F.struct(first, *rest))).alias(name)
        nested = frame.groupBy("series_id").agg(rows)
        whole = nested if whole is None else whole.join(nested, "series_id", "full")
    return whole.select(
        "series_id", *[F.coalesce(F.col(n), F.array().cast(whole.schema[n].dataType)).alias(n) for n in _PARTS]
    )
