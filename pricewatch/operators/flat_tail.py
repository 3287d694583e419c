"""Flat end of a training series: detection and trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.operators.regularise import KEYS

# Longest tail looked at, spread that ends a flat tail, largest share trimmed.
MAX_TAIL = 60
FLAT_STD = 1.0
MAX_SHARE = 0.10
# Rows of a series that can decide the answer.
TAIL_ROWS = MAX_TAIL - 1


def first_moving(tail: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``flat_days`` per series from its last rows.

    ``tail`` holds at least the last 59 rows of each series with ``rn`` (1 =
    last row) and ``n_priced``, the number of prices of the whole series.
    ``flat_days`` is ``w - 1`` for the smallest ``w`` in ``2 .. min(60, n) - 1``
    whose last ``w`` prices have a sample deviation above 1.0, else 0. So two
    differing last prices already give 1, and a tail of 59 or more equal rows
    gives 0. The running deviation goes backwards in time over a growing frame.
    """
    running = (
        Window.partitionBy(*keys)
        .orderBy("rn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends_tail = (
        (F.col("_sd") > FLAT_STD)
        & (F.col("rn") >= 2)
        & (F.col("rn") <= F.least(F.lit(MAX_TAIL), F.col("n_priced")) - 1)
    )
    return (
        tail.filter(F.col("rn") <= TAIL_ROWS)
        .withColumn("_sd", F.stddev_samp("price").over(running))
        .groupBy(*keys)
        .agg(
            F.coalesce(F.min(F.when(ends_tail, F.col("rn") - 1)), F.lit(0))
            .cast("int")
            .alias("flat_days")
        )
    )


def trimmed_days(flat_days: Column, n_rows: Column) -> Column:
    """Rows to drop: ``flat_days`` if they are fewer than 10 % of the series, else 0."""
    few = (flat_days > 0) & (flat_days < n_rows * MAX_SHARE)
    return F.when(few, flat_days).otherwise(F.lit(0))


def trim_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops the flat tail of series that were reduced to cells.

    ``cells`` have the size ``n`` and mean ``z_mean`` of each cell and
    ``tail_rn``: the row number from the end for the last 59 rows, each a cell
    of its own, and 0 for the cells of all older rows.
    """
    series = Window.partitionBy(*keys).orderBy("tail_rn")
    running = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rn, n_rows = F.col("tail_rn"), F.col("_n_rows")
    ends_tail = (
        (F.col("_sd") > FLAT_STD) & (rn >= 2) & (rn <= F.least(F.lit(MAX_TAIL), n_rows) - 1)
    )
    return (
        cells.select(
            "*",
            F.stddev_samp(F.when(rn > 0, F.col("z_mean"))).over(running).alias("_sd"),
            F.sum("n").over(whole).alias("_n_rows"),
        )
        .withColumn("_flat", F.coalesce(F.min(F.when(ends_tail, rn - 1)).over(whole), F.lit(0)))
        .filter((rn == 0) | (rn > trimmed_days(F.col("_flat"), n_rows)))
        .select(*cells.columns)
    )


def _numbered(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    backwards = Window.partitionBy(*keys).orderBy(F.desc("date"))
    whole = backwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return train.select(
        "*",
        F.row_number().over(backwards).alias("rn"),
        F.count(F.lit(1)).over(whole).alias("n_rows"),
        F.count("price").over(whole).alias("n_priced"),
    )


def flat_tail(train: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per series: ``n_rows`` and ``flat_days`` of any training rows."""
    rows = _numbered(train, keys)
    counts = rows.filter(F.col("rn") == 1).select(*keys, "n_rows")
    return counts.join(first_moving(rows, keys), list(keys))


def trim_flat_tail(train: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drops the flat tail of each series when it is short enough."""
    rows = _numbered(train, keys)
    days = first_moving(rows, keys)
    return (
        rows.join(days, list(keys))
        .filter(F.col("rn") > trimmed_days(F.col("flat_days"), F.col("n_rows")))
        .select(*train.columns)
    )
