"""Forecast accuracy over pairs of actual and predicted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch.functions.numeric import half_even, safe_double


def _whole(value: Column, predicted: Column, actual: Column) -> Column:
    """Null when a pair lacks its prediction; a metric over part of the pairs would mislead."""
    missing = F.count(F.when(actual.isNotNull() & predicted.isNull(), F.lit(1)))
    return F.when(missing == 0, value)


def mape(
    actual: Column, predicted: Column, mask_zero: bool = True, digits: int | None = None
) -> Column:
    """Mean absolute percentage error, x 100.

    Zero actuals are left out (``mask_zero``) or make the error infinite. No
    pairs give null. ``digits`` rounds half to even.
    """
    error = F.abs((actual - predicted) / F.when(actual != 0, actual))
    if not mask_zero:
        error = F.when(actual == 0, F.lit(float("inf"))).otherwise(error)
    value = _whole(F.avg(error) * 100, predicted, actual)
    return value if digits is None else half_even(value, digits)


def rmse(actual: Column, predicted: Column) -> Column:
    miss = actual - predicted
    return _whole(F.sqrt(F.avg(miss * miss)), predicted, actual)


def align_by_date(forecast: DataFrame, obs: DataFrame) -> DataFrame:
    """Forecast rows on days that have an actual price."""
    actual = obs.filter(F.col("price").isNotNull()).select(
        "series_id", F.col("date").alias("forecast_date"), "price"
    )
    return forecast.join(actual, ["series_id", "forecast_date"])


def evaluate(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rmse``, ``mape`` and the number of pairs of (``price``, ``yhat``) per group."""
    actual, predicted = F.col("price"), F.col("yhat")
    return pairs.groupBy(*keys).agg(
        rmse(actual, predicted).alias("rmse"),
        mape(actual, predicted).alias("mape"),
        F.count("price").alias("n"),
    )


def mape_or_zero(value: Column, digits: int = 2) -> Column:
    """Dashboard form: no overlap, missing or infinite error -> 0.0, rounded half to even."""
    return half_even(safe_double(value), digits)
