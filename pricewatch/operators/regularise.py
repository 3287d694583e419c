"""Gap-free daily calendars and gap filling.

A series is first turned into *segments*: one row per known price with its
neighbours and the days it covers, up to the day before the next known price.
That takes one hash exchange on the series and one sort by date. Days come from
exploding segments in place, so there is no calendar table, no join and no
second scan. A consumer that needs only part of the calendar clips the segments
before the explode; every price, and the prices one and two days earlier, are
arithmetic on the segment, so no window runs over exploded days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

KEYS = ("series_id",)


@dataclass(frozen=True)
class Filling:
    """How days without a price are filled.

    ``limit``: days of a gap that lie on the line between its ends; later days
    repeat the last of them (``fill_edges``) or stay null. ``None``: all days.
    ``zero_as_missing``: a zero price counts as missing.
    ``fill_edges``: days before the first price take the first price.
    Days after the last price always take the last price.
    """

    limit: int | None = 30
    zero_as_missing: bool = True
    fill_edges: bool = True


# The forecast path and the risk path fill differently.
FORECAST = Filling()
RISK = Filling(limit=None, zero_as_missing=False, fill_edges=False)
MODEL = Filling(limit=None, zero_as_missing=True, fill_edges=False)


def _duplicate(kind: str) -> Column:
    return F.raise_error(F.concat(F.lit("duplicate date "), F.col("date"))).cast(kind)


def daily_calendar(obs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every day from the first to the last date of a series; new days have a null price.

    A date that occurs twice in a series is an error.
    """
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    return (
        obs.select(*keys, "date", "price", following.alias("next_date"))
        .withColumn(
            "day",
            F.explode(
                F.sequence(
                    "date",
                    F.when(F.col("next_date") == F.col("date"), _duplicate("date")).otherwise(
                        F.coalesce(F.date_sub("next_date", 1), F.col("date"))
                    ),
                )
            ),
        )
        .select(
            *keys,
            F.col("day").alias("date"),
            F.when(F.col("day") == F.col("date"), F.col("price")).alias("price"),
        )
    )


def segments(obs: DataFrame, keys: Sequence[str] = KEYS, fill: Filling = FORECAST) -> DataFrame:
    """One row per known price: ``date``, ``price``, the next known date and price, the
    covered days ``seg_start .. seg_end``, the first and last date of the series and
    its first known price, ``base_price``.

    A series without any known price keeps one row with a null price.
    """
    ordered = Window.partitionBy(*keys).orderBy("date")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    usable = F.col("price").isNotNull() & ~F.isnan("price")
    if fill.zero_as_missing:
        usable = usable & (F.col("price") != 0)
    stays = F.col("price").isNotNull() | (
        (F.col("n_known") == 0) & (F.col("date") == F.col("first_date"))
    )
    return (
        obs.select(*keys, "date", F.when(usable, F.col("price")).alias("price"))
        .select(
            "*",
            F.first("date").over(whole).alias("first_date"),
            F.last("date").over(whole).alias("last_date"),
            F.count("price").over(whole).alias("n_known"),
            F.first("price", ignorenulls=True).over(whole).alias("base_price"),
            F.lead("date").over(ordered).alias("twin_date"),
        )
        .filter(
            F.when(F.col("twin_date") == F.col("date"), _duplicate("boolean")).otherwise(stays)
        )
        .select(
            *keys,
            "date",
            "price",
            "first_date",
            "last_date",
            "base_price",
            F.lag("date").over(ordered).alias("prev_date"),
            F.lead("date").over(ordered).alias("next_date"),
            F.lead("price").over(ordered).alias("next_price"),
        )
        .select(
            "*",
            F.when(F.col("prev_date").isNull(), F.col("first_date"))
            .otherwise(F.col("date"))
            .alias("seg_start"),
            F.coalesce(F.date_sub("next_date", 1), F.col("last_date")).alias("seg_end"),
        )
        .drop("prev_date")
    )


def price_on(day: Column, fill: Filling) -> Column:
    """Price of a segment on one of its days."""
    offset = F.datediff(day, "date")
    step = offset if fill.limit is None else F.least(offset, F.lit(fill.limit))
    gap = F.datediff("next_date", "date")
    line = F.col("price") + (F.col("next_price") - F.col("price")) * step / gap
    before = F.col("price") if fill.fill_edges else F.lit(None).cast("double")
    price = (
        F.when(offset == 0, F.col("price"))
        .when(offset < 0, before)
        .when(F.col("next_price").isNull(), F.col("price"))
        .otherwise(line)
    )
    if fill.limit is not None and not fill.fill_edges:
        price = F.when(offset <= fill.limit, price)
    return price


def with_tails(segs: DataFrame, keys: Sequence[str] = KEYS, fill: Filling = FORECAST) -> DataFrame:
    """Adds the prices of the last day and the day before it of the previous segment.

    They are what :func:`price_before` needs at the first days of a segment.
    """
    ordered = Window.partitionBy(*keys).orderBy("date")
    one_day = F.col("seg_end") == F.col("seg_start")
    return (
        segs.withColumn("_tail", price_on(F.col("seg_end"), fill))
        .withColumn("prev_tail", F.lag("_tail").over(ordered))
        .withColumn(
            "_tail2",
            F.when(one_day, F.col("prev_tail")).otherwise(
                price_on(F.date_sub("seg_end", 1), fill)
            ),
        )
        .withColumn("prev_tail2", F.lag("_tail2").over(ordered))
        .drop("_tail", "_tail2")
    )


def price_before(day: Column, back: int, fill: Filling) -> Column:
    """Price one or two days before ``day``; null before the first day of the series."""
    inside = F.datediff(day, "seg_start")
    own = price_on(F.date_sub(day, back), fill)
    if back == 1:
        return F.when(inside >= 1, own).otherwise(F.col("prev_tail"))
    if back == 2:
        return (
            F.when(inside >= 2, own)
            .when(inside == 1, F.col("prev_tail"))
            .otherwise(F.col("prev_tail2"))
        )
    raise ValueError("back must be 1 or 2")


def explode_days(
    segs: DataFrame, first: Column | None = None, last: Column | None = None
) -> DataFrame:
    """One row per day of each segment, as ``day``; only days in ``[first, last]`` if given."""
    start, end = F.col("seg_start"), F.col("seg_end")
    if first is not None:
        segs, start = segs.filter(end >= first), F.greatest(start, first)
    if last is not None:
        segs, end = segs.filter(F.col("seg_start") <= last), F.least(end, last)
    return segs.withColumn("day", F.explode(F.sequence(start, end)))


def regularise(
    obs: DataFrame, keys: Sequence[str] = KEYS, fill: Filling = FORECAST
) -> DataFrame:
    """Daily calendar with filled gaps.

    Returns the keys, ``date``, ``price``, ``is_observed`` and ``rn`` (1 for the
    last day of the series), which spares consumers a ranking window.
    """
    return explode_days(segments(obs, keys, fill)).select(
        *keys,
        F.col("day").alias("date"),
        price_on(F.col("day"), fill).alias("price"),
        ((F.col("day") == F.col("date")) & F.col("price").isNotNull()).alias("is_observed"),
        (F.datediff("last_date", "day") + 1).alias("rn"),
    )


def forward_backward_fill(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last known price, else the next known one.

    Both directions use a growing frame, so the cost is linear in the rows; a
    frame that looks ahead would be quadratic.
    """
    ahead = Window.partitionBy(*keys).orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    back = Window.partitionBy(*keys).orderBy(F.desc("date")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        df.withColumn("_prev", F.last("price", ignorenulls=True).over(ahead))
        .withColumn("_next", F.last("price", ignorenulls=True).over(back))
        .withColumn("price", F.coalesce("price", "_prev", "_next"))
        .drop("_prev", "_next")
    )
