"""Forecasts from stored fits: a fit is made once and used until its input or its age asks for another.

A row of the table holds the blend's parameters of one series and horizon, with a digest of the
training rows behind it. A refresh digests the panel (one aggregation), keeps the rows whose digest
still holds and that are young enough, and fits only the series left over; a forecast is expressions
over the stored rows and reads no price.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch import schemas
from pricewatch.config import DEFAULT, Settings
from pricewatch.functions import literals
from pricewatch.operators import calendar, closed_form, fit_store, versions
from pricewatch.plans import forecasting
from pricewatch.session import new_table_path

MODEL = "hybrid"
OPERATIONAL, BACKTEST = "operational", "backtest"
#: Order of the numbers in ``params``: these, then the month effects, then the weekday effects.
NUMBERS = ("phi", "mu", "y_last", "d_last", "slope", "level", "sigma", "n_train")
_MONTHS, _WEEKDAYS = closed_form.MONTHS, closed_form.WEEKDAYS


def _encoded() -> Column:
    """Parameters, and the last training day as days since 1970, in one array."""
    numbers = F.array(*[F.col(c).cast("double") for c in NUMBERS])
    return F.concat(numbers, "month_effect", "weekday_effect", F.array(F.unix_date("last_date").cast("double")))


def decoded(fits: DataFrame) -> DataFrame:
    """Stored rows with the columns that the closed-form expressions use."""
    at = len(NUMBERS)
    return fits.select(
        "series_id",
        "horizon",
        *[F.get("params", F.lit(i)).alias(c) for i, c in enumerate(NUMBERS)],
        F.slice("params", at + 1, _MONTHS).alias("month_effect"),
        F.slice("params", at + _MONTHS + 1, _WEEKDAYS).alias("weekday_effect"),
        F.date_from_unix_date(F.get("params", F.lit(at + _MONTHS + _WEEKDAYS)).cast("int")).alias("last_date"),
    )


def _items(scope: str, settings: Settings):
    if scope == OPERATIONAL:
        return settings.horizons
    if scope == BACKTEST:
        return settings.eval_windows
    raise ValueError(f"scope must be {OPERATIONAL!r} or {BACKTEST!r}, not {scope!r}")


def _fitted(obs: DataFrame, scope: str, settings: Settings) -> DataFrame:
    if scope == OPERATIONAL:
        return forecasting.operational_fits(obs, settings)
    return forecasting.backtest_fits(obs, settings)


def stale_fits(
    obs: DataFrame, path: str, now: datetime, settings: Settings = DEFAULT, scope: str = OPERATIONAL
) -> DataFrame:
    """Keys of the fits that the panel needs and the table does not hold in usable form."""
    required = fit_store.required_fits(obs, _items(scope, settings), settings, scope, (MODEL,))
    held = versions.read(obs.sparkSession, path, schemas.MODEL_PARAMS)
    return fit_store.refit_needed(required, held, now, settings.fit_ttl_hours)


def refresh(
    obs: DataFrame,
    path: str,
    now: datetime,
    settings: Settings = DEFAULT,
    scope: str = OPERATIONAL,
    fitted_at: Column | None = None,
) -> int:
    """Fits what is stale, writes it beside the rest and returns how many rows were fitted.

    With nothing stale the table keeps its version. A series that left the panel keeps its rows
    until they are invalidated.
    """
    spark = obs.sparkSession
    based_on = versions.current(spark, path)
    placed = forecasting.place(obs)
    work = new_table_path(spark, "stale-fits")
    stale_fits(placed, path, now, settings, scope).write.parquet(work)
    stale = spark.read.parquet(work)
    n = stale.count()
    if not n:
        return 0
    series = stale.select("series_id").distinct()
    fits = _fitted(placed.join(series, "series_id", "left_semi"), scope, settings)
    made = fits.select("series_id", "horizon", _encoded().alias("params")).join(stale, ["series_id", "horizon"])
    made = made.withColumn("fitted_at", F.lit(now).cast("timestamp") if fitted_at is None else fitted_at)
    held = versions.read(spark, path, schemas.MODEL_PARAMS)
    kept = held.join(made.select("series_id", "scope", "model", "horizon"), ["series_id", "scope", "model", "horizon"], "left_anti")
    columns = schemas.MODEL_PARAMS.names
    versions.commit(kept.select(*columns).unionByName(made.select(*columns)), path, based_on)
    return n


def invalidate(
    spark: SparkSession,
    path: str,
    series_id: str | None = None,
    horizon: str | None = None,
    scope: str | None = None,
    model: str | None = None,
    anchor_date: date | None = None,
) -> None:
    """Deletes the stored fits that match all given values; without any, all of them.

    The table is rewritten as a new version: a failure leaves the old one in use.
    """
    based_on = versions.current(spark, path)
    held = versions.read(spark, path, schemas.MODEL_PARAMS)
    left = fit_store.invalidate(held, series_id, horizon, scope, model, anchor_date)
    versions.commit(left, path, based_on)


def forecast_from_stored_fits(
    spark: SparkSession, path: str, settings: Settings = DEFAULT
) -> DataFrame:
    """:func:`forecasting.forecast_operational` from the table alone."""
    held = versions.read(spark, path, schemas.MODEL_PARAMS).filter(
        (F.col("scope") == OPERATIONAL) & (F.col("model") == MODEL)
    )
    mine = F.filter(literals.horizon_rows(settings.horizons, settings), lambda h: h["horizon"] == F.col("horizon"))
    fits = decoded(held).withColumn("_h", F.explode(mine)).drop("horizon")
    fits = fits.select(*[c for c in fits.columns if c != "_h"], "_h.*")
    return forecasting.operational_rows(calendar.with_steps(fits))
