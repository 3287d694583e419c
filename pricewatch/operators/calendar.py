"""Forecast calendars: which steps a horizon has and which dates label them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch.config import EvalWindow, Horizon, Settings
from pricewatch.functions import literals


def with_horizons(
    df: DataFrame, horizons: Iterable[Horizon | EvalWindow], settings: Settings
) -> DataFrame:
    """Every row once per horizon, with the horizon's cut-off, start, steps and weights."""
    items = tuple(horizons)
    rows = literals.horizon_rows if isinstance(items[0], Horizon) else literals.window_rows
    return df.withColumn("_h", F.explode(rows(items, settings))).select(
        *df.columns, "_h.*"
    )


def training_rows(
    df: DataFrame, horizons: Iterable[Horizon | EvalWindow], settings: Settings
) -> DataFrame:
    """Rows up to the cut-off of each horizon."""
    return (
        with_horizons(df, horizons, settings)
        .filter(F.col("date") <= F.col("train_end"))
        .select(*df.columns, "horizon", "train_end")
    )


def cut_rows(df: DataFrame, horizons: Iterable[Horizon | EvalWindow]) -> DataFrame:
    """Training rows once per distinct cut-off; horizons that share one share the fit."""
    cuts = literals.dates(h.train_end for h in horizons)
    return df.withColumn("train_end", F.explode(cuts)).filter(
        F.col("date") <= F.col("train_end")
    )


def horizons_of_cut(
    fits: DataFrame, horizons: Iterable[Horizon | EvalWindow], settings: Settings
) -> DataFrame:
    """Attaches each horizon to the fit of its cut-off."""
    items = tuple(horizons)
    rows = literals.horizon_rows if isinstance(items[0], Horizon) else literals.window_rows
    mine = F.filter(rows(items, settings), lambda h: h["train_end"] == F.col("train_end"))
    other = [F.col(c) for c in fits.columns if c != "train_end"]
    return fits.withColumn("_h", F.explode(mine)).select(*other, "_h.*")


def with_steps(df: DataFrame) -> DataFrame:
    """One row per forecast step 1 .. ``steps``."""
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))


def label(step: Column) -> Column:
    """Date of a step counted from the start of the horizon."""
    return F.date_add("start", step - 1)
