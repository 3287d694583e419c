"""Risk scores of whole panels: historical features joined with forecast endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch.config import DEFAULT, Settings
from pricewatch.functions import numeric, scoring
from pricewatch.operators import features
from pricewatch.plans import forecasting


def historical_features(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Features once per series, shared by all horizons.

    Unlike the forecast path, zero prices count as prices here and gaps of any
    length are interpolated.
    """
    return features.risk_features(obs, settings.risk)


def score(rows: DataFrame) -> DataFrame:
    """Scores rows of features plus ``horizon`` and ``forecast`` (the last forecast value).

    A row whose score is undefined or not finite gets the fallback: 0, Normal, stable, 0.0, 1.0, 0.0.
    """
    fdi, ratio = F.col("fdi_raw"), F.col("vol_ratio")
    text = scoring.message(fdi, ratio, F.col("direction"), F.col("horizon"))
    scored = (
        rows.withColumn(
            "fdi_raw",
            scoring.forecast_deviation(
                F.col("forecast"), F.col("moving_avg"), F.col("rolling_std")
            ),
        )
        .withColumn(
            "seasonal_deviation",
            scoring.seasonal_deviation(F.col("forecast"), F.col("seasonal_baseline")),
        )
        .withColumn(
            "breakdown",
            scoring.breakdown(fdi, ratio, F.col("direction"), F.col("seasonal_deviation")),
        )
    )
    known = F.coalesce(
        F.col("breakdown.total").isNotNull()
        & numeric.is_finite(fdi) & numeric.is_finite(ratio) & numeric.is_finite(F.col("trend_slope"))
        & text.isNotNull(),
        F.lit(False),
    )

    def value(column: Column, fallback) -> Column:
        return F.when(known, column).otherwise(F.lit(fallback))

    return scored.select(
        "series_id",
        F.col("last_date").alias("date"),
        "horizon",
        value(F.col("breakdown.total"), 0).alias("risk_score"),
        value(scoring.level(F.col("breakdown.total")), "Normal").alias("risk_level"),
        value(F.col("direction"), "stable").alias("direction"),
        value(fdi, 0.0).alias("fdi_value"),
        value(ratio, 1.0).alias("vol_ratio"),
        value(F.col("trend_slope"), 0.0).alias("trend_slope"),
        value(text, scoring.FALLBACK_TEXT).alias("risk_message"),
        F.col("seasonal_deviation"),
        F.col("breakdown"),
    )


def with_forecast(
    history: DataFrame, endpoints: DataFrame, settings: Settings = DEFAULT
) -> DataFrame:
    """Features of each series next to the endpoint of each of its forecasts.

    A horizon without a forecast keeps its row with a null endpoint. The few
    endpoints of a series travel as one map, so that both sides join on the
    series alone and stay in the partitions they have.
    """
    per_series = endpoints.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", "yhat"))).alias("_ends")
    )
    names = F.array(*[F.lit(h.name) for h in settings.horizons])
    return (
        history.join(per_series, "series_id", "left")
        .withColumn("horizon", F.explode(names))
        .withColumn("forecast", F.col("_ends")[F.col("horizon")])
        .drop("_ends")
    )


def endpoints_of(forecast: DataFrame) -> DataFrame:
    """Last value of every forecast of a forecast table."""
    return forecast.groupBy("series_id", "horizon").agg(
        F.max_by("yhat", "forecast_date").alias("yhat")
    )


def assess(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Risk of every series and horizon from its prices alone.

    The panel is placed by series once; features and forecasts read that same
    exchange, and their join needs no other.
    """
    placed = forecasting.place(obs)
    return score(
        with_forecast(
            historical_features(placed, settings),
            forecasting.forecast_endpoints(placed, settings),
            settings,
        )
    )
