"""Reuse and invalidation of stored fits."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.config import EvalWindow, Horizon, Settings
from pricewatch.operators import calendar

FIT_KEY = ("series_id", "scope", "model", "horizon", "anchor_date", "input_digest")


def required_fits(
    obs: DataFrame,
    horizons: Iterable[Horizon | EvalWindow],
    settings: Settings,
    scope: str,
    models: Iterable[str],
) -> DataFrame:
    """One row per fit: its key, with the last training date and a digest of the input.

    The digest covers every training row, so a corrected price makes a new key
    even when the last date stays the same. It does not depend on row order. All
    cut-offs come from one aggregation of the panel; rows are not multiplied.
    """
    items = tuple(horizons)
    day, row = F.col("date"), F.xxhash64("date", "price")
    cuts = sorted({h.train_end for h in items})
    inputs = [
        F.struct(
            F.lit(cut).alias("train_end"),
            F.max(F.when(day <= F.lit(cut), day)).alias("anchor_date"),
            F.bit_xor(F.when(day <= F.lit(cut), row)).alias("input_digest"),
        )
        for cut in cuts
    ]
    per_cut = obs.groupBy("series_id").agg(F.array(*inputs).alias("_cuts"))
    per_cut = per_cut.select("series_id", F.explode("_cuts").alias("_c")).select("series_id", "_c.*")
    found = calendar.horizons_of_cut(per_cut.filter(F.col("anchor_date").isNotNull()), items, settings)
    return found.select(
        "series_id",
        F.lit(scope).alias("scope"),
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
        "horizon",
        "anchor_date",
        "input_digest",
    )


def refit_needed(
    required: DataFrame, stored: DataFrame, now: datetime, ttl_hours: int
) -> DataFrame:
    """Required fits without a stored fit younger than ``ttl_hours``."""
    oldest = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(ttl_hours))
    fresh = stored.filter(F.col("fitted_at") > oldest).select(*FIT_KEY)
    return required.join(fresh, list(FIT_KEY), "left_anti")


def invalidate(
    stored: DataFrame,
    series_id: str | None = None,
    horizon: str | None = None,
    scope: str | None = None,
    model: str | None = None,
    anchor_date=None,
) -> DataFrame:
    """Stored fits that remain after dropping those that match all given values.

    Without any value, none remain.
    """
    wanted = {
        "series_id": series_id,
        "horizon": horizon,
        "scope": scope,
        "model": model,
        "anchor_date": anchor_date,
    }
    hit = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            hit = hit & F.col(name).eqNullSafe(F.lit(value))
    return stored.filter(~hit)
