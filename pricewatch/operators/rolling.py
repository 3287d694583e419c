"""Rolling statistics over the last ``k`` rows of a series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.operators.regularise import KEYS


def _last_rows(k: int, keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(-(k - 1), Window.currentRow)


def rolling_mean(
    df: DataFrame, k: int, out: str = "rolling_mean", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean of the last ``k`` rows; null unless all ``k`` prices are known."""
    w = _last_rows(k, keys)
    full = F.count("price").over(w) == k
    return df.withColumn(out, F.when(full, F.avg("price").over(w)))


def rolling_std(
    df: DataFrame, k: int, out: str = "rolling_std", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Sample deviation of the last ``k`` rows; null unless all ``k`` prices are known."""
    w = _last_rows(k, keys)
    full = F.count("price").over(w) == k
    return df.withColumn(out, F.when(full, F.stddev_samp("price").over(w)))


def volatility_series(
    obs: DataFrame, start: date, end: date, k: int = 30, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Chart volatility: rolling deviation over observation rows, missing -> 0.

    It runs over the observed rows, not over calendar days, and the date range
    is cut after the window so that the first days keep their history.
    """
    return (
        rolling_std(obs, k, "volatility", keys)
        .filter(F.col("date").between(F.lit(start), F.lit(end)))
        .select(*keys, "date", F.coalesce("volatility", F.lit(0.0)).alias("volatility"))
    )
