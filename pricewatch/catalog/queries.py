"""Registered queries, first part: panels, calendars, windows and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch.catalog.fixture import SETTINGS
from pricewatch.operators import calendar, closed_form, features, flat_tail, regularise, rolling
from pricewatch.plans import forecasting
from pricewatch.sources import panels


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def price_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.price_obs(spark, sf_dir).orderBy("series_id", "date")


def calendar_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularise.daily_calendar(panels.price_obs_market(spark, sf_dir))


def interp_limit30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularise.regularise(panels.price_obs_market(spark, sf_dir)).drop("rn")


def interp_limit30_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularise.regularise(panels.price_obs_null(spark, sf_dir)).drop("rn")


def interp_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularise.regularise(panels.price_obs_null(spark, sf_dir), fill=regularise.RISK)


def fill_ff_bf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularise.forward_backward_fill(panels.price_obs_null(spark, sf_dir))


def flat_tail_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_tail.flat_tail(panels.price_obs_edge(spark, sf_dir)).select(
        "series_id", "n_rows", F.col("flat_days").cast("int").alias("flat_days")
    )


def flat_tail_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_tail.trim_flat_tail(panels.price_obs_edge(spark, sf_dir)).drop("rn")


def rolling_mean_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = panels.price_obs_brand(spark, sf_dir)
    return _round(rolling.rolling_mean(obs, 30), 4, "rolling_mean").drop("price")


def rolling_std_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = regularise.regularise(panels.price_obs_brand(spark, sf_dir))
    return _round(rolling.rolling_std(daily, 30), 4, "rolling_std").select(
        "series_id", "date", "rolling_std"
    )


def volatility_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = SETTINGS.chart_range
    obs = panels.price_obs(spark, sf_dir)
    return _round(rolling.volatility_series(obs, start, end), 4, "volatility")


def _features(obs: DataFrame) -> DataFrame:
    return features.risk_features(obs, SETTINGS.risk)


def std_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(panels.price_obs_edge(spark, sf_dir))
    return _round(out.select("series_id", "moving_avg", "rolling_std"), 4, "moving_avg", "rolling_std")


def vol_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = panels.price_obs_edge(spark, sf_dir).unionByName(panels.price_obs_event(spark, sf_dir))
    return _round(_features(both).select("series_id", "vol_ratio"), 6, "vol_ratio")


def vol_ratio_short_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = panels.price_obs_edge(spark, sf_dir)
    return _round(features.volatility_ratios(obs, 7, 30), 6, "vol_ratio")


def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(panels.price_obs_edge(spark, sf_dir))
    return _round(out.select("series_id", "trend_slope", "direction"), 4, "trend_slope")


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_rows(panels.price_obs_brand(spark, sf_dir), 7)


def seasonal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = panels.price_obs(spark, sf_dir).unionByName(panels.price_obs_event(spark, sf_dir))
    return _round(_features(both).select("series_id", "seasonal_baseline"), 4, "seasonal_baseline")


def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.series_stats(panels.price_obs_brand(spark, sf_dir))
    return _round(out, 4, "mean_price", "std_price")


def ari_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = closed_form.fit_ari(regularise.segments(panels.price_obs_brand(spark, sf_dir)))
    return _round(fits, 8, "y_last", "d_last", "phi", "mu")


def _three_month_steps(fits: DataFrame) -> DataFrame:
    return fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(90))))


def ari_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = closed_form.fit_ari(regularise.segments(panels.price_obs_brand(spark, sf_dir)))
    return _three_month_steps(fits).select(
        "series_id",
        F.date_add("last_date", F.col("step")).alias("forecast_date"),
        F.round(closed_form.ari_at(F.col("step")), 2).alias("yhat"),
    )


def seasonal_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = closed_form.fit_seasonal(forecasting.prepare(panels.price_obs_brand(spark, sf_dir)))
    return fits.select(
        "series_id",
        "n_train",
        F.round("level", 3).alias("level"),
        F.round("slope", 6).alias("slope"),
        F.round("sigma", 3).alias("sigma"),
    )


def _seasonal_forecast(spark: SparkSession, sf_dir: str, log: bool) -> DataFrame:
    fits = closed_form.fit_seasonal(
        forecasting.prepare(panels.price_obs_brand(spark, sf_dir)), log=log
    )
    yhat, lower, upper = closed_form.seasonal_at(F.col("step"), log)
    return _three_month_steps(fits).select(
        "series_id",
        F.date_add("last_date", F.col("step")).alias("forecast_date"),
        F.round(yhat, 2).alias("yhat"),
        F.round(lower, 2).alias("yhat_lower"),
        F.round(upper, 2).alias("yhat_upper"),
    )


def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seasonal_forecast(spark, sf_dir, log=False)


def seasonal_forecast_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seasonal_forecast(spark, sf_dir, log=True)


def hybrid_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend without trimming, from the cut-offs of the operational horizons."""
    obs = panels.price_obs_supplier(spark, sf_dir)
    rows = calendar.with_steps(forecasting.operational_fits(obs, SETTINGS, trim=False))
    return rows.select(
        "series_id",
        "horizon",
        "step",
        F.round(forecasting.blended_at(F.col("step"))[0], 2).alias("yhat"),
    )


def _rounded_forecast(df: DataFrame) -> DataFrame:
    return _round(df, 2, "yhat", "yhat_lower", "yhat_upper")


def forecast_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_forecast(
        forecasting.forecast_operational(panels.price_obs_edge(spark, sf_dir), SETTINGS)
    )


def backtest_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_forecast(
        forecasting.forecast_backtest(panels.price_obs_market(spark, sf_dir), SETTINGS)
    )
