"""Configuration as literals inside the plan.

Horizon and window settings are a handful of rows. As an exploded array literal
they need neither a join nor a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewatch.config import EvalWindow, Horizon, Settings


def horizon_rows(horizons: Iterable[Horizon], settings: Settings) -> Column:
    """array<struct<horizon,train_end,start,steps,w_arima,w_seasonal>>."""
    return F.array(
        *[
            F.struct(
                F.lit(h.name).alias("horizon"),
                F.lit(h.train_end).alias("train_end"),
                F.date_add(F.lit(h.train_end), 1).alias("start"),
                F.lit(h.days).alias("steps"),
                F.lit(settings.weights(h.name).arima).alias("w_arima"),
                F.lit(settings.weights(h.name).seasonal).alias("w_seasonal"),
            )
            for h in horizons
        ]
    )


def window_rows(windows: Iterable[EvalWindow], settings: Settings) -> Column:
    """Same shape as :func:`horizon_rows` plus the end of the test window."""
    return F.array(
        *[
            F.struct(
                F.lit(w.name).alias("horizon"),
                F.lit(w.train_end).alias("train_end"),
                F.lit(w.start).alias("start"),
                F.lit(w.days).alias("steps"),
                F.lit(settings.weights(w.name).arima).alias("w_arima"),
                F.lit(settings.weights(w.name).seasonal).alias("w_seasonal"),
            )
            for w in windows
        ]
    )


def dates(values: Iterable[date]) -> Column:
    return F.array(*[F.lit(v) for v in sorted(set(values))])
