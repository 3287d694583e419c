"""Moments per month of a series that add up to its fit.

A block is one month of one series, in one row: the moment cells of the days from its first to its
last known price, and up to four edge prices (the first two and the last two). Days between blocks,
and the lags of a block's first two days, follow from the edges alone: they are arithmetic on the
line between two known prices. So blocks are computed from their own rows, kept, replaced one by one
when a price is corrected, and combined in any order; a fit reads no day of the months it has.

Cut-offs must be month ends. Days and gaps are filled as on the forecast path.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.functions import literals
from pricewatch.operators import closed_form
from pricewatch.operators.regularise import (
    FORECAST,
    Filling,
    explode_days,
    price_before,
    price_on,
    segments,
    with_tails,
)
from pricewatch.sources import tables

KEYS = ("series_id", "block")
_ADDED = ("k", "sx", "sy", "sxx", "sxy")
_CELL = (
    "month int, weekday int, n bigint, t_mean double, z_mean double, t_dev double, z_dev double, tz_dev double,"
    " k bigint, sx double, sy double, sxx double, sxy double, y_last double, d_last double, last_date date"
)
SCHEMA = (
    "series_id string, block date, first_row date, last_row date,"
    f" edges array<struct<date:date,price:double>>, cells array<struct<{_CELL.replace(' ', ':').replace(',:', ',')}>>"
)


def block_of(day: Column) -> Column:
    return F.trunc(day, "month").cast("date")


def _usable(fill: Filling) -> Column:
    known = F.col("price").isNotNull() & ~F.isnan("price")
    return known & (F.col("price") != 0) if fill.zero_as_missing else known


def _cells(days: DataFrame, keys: tuple[str, ...], in_trend: Column, last: Column) -> DataFrame:
    """Cells of lagged days; a day outside the trend adds only its lag products.

    ``last`` is the date under which a day's level and difference may be the series' last.
    """
    sums = closed_form._ari_sums()
    sums |= {
        "y_last": F.max_by("y", last),
        "d_last": F.max_by("dy", last),
        "last_date": F.max(last),
    }
    trend = closed_form._trend_moments(F.when(in_trend, F.col("price")))
    del trend["last_date"]
    return closed_form._cells(closed_form._with_differences(days), keys, {**trend, **sums})


def build(obs: DataFrame, fill: Filling = FORECAST) -> DataFrame:
    """Blocks (``SCHEMA``) of the months that occur in ``obs``; each month must be there whole."""
    rows = obs.filter(F.col("series_id").isNotNull()).select(
        "series_id", block_of(F.col("date")).alias("block"), "date", F.when(_usable(fill), F.col("price")).alias("price")
    )
    rows = rows.repartition(*KEYS)
    known = F.when(F.col("price").isNotNull(), F.struct("date", "price"))
    ordered = F.array_sort(F.collect_list(known))  # at most the days of a month
    bounds = rows.groupBy(*KEYS).agg(
        F.min("date").alias("first_row"), F.max("date").alias("last_row"), ordered.alias("_known")
    )
    n = F.size("_known")
    two = F.concat(F.slice("_known", 1, 2), F.slice("_known", F.greatest(n - 1, F.lit(1)), 2))
    bounds = bounds.withColumn("edges", F.array_sort(F.array_distinct(two))).drop("_known")

    inner = with_tails(segments(rows.filter("price is not null"), KEYS, fill), KEYS, fill)
    days = closed_form.lagged_days(inner, KEYS, fill)
    # the block's first day has no difference yet; a bridge will supply that day
    cells = _cells(days, KEYS, F.lit(True), F.when(F.col("dy").isNotNull(), F.col("date")))
    names = [c for c in cells.columns if c not in KEYS]
    per_block = cells.groupBy(*KEYS).agg(F.collect_list(F.struct(*names)).alias("cells"))
    whole = bounds.join(per_block, list(KEYS), "left")
    target = rows.sparkSession.createDataFrame([], SCHEMA).schema
    empty = F.array().cast(target["cells"].dataType)
    return whole.select(
        "series_id", "block", "first_row", "last_row", "edges",
        F.coalesce(F.col("cells").cast(target["cells"].dataType), empty).alias("cells"),
    )


def merge(held: DataFrame, new: DataFrame) -> DataFrame:
    """``held`` with the blocks of ``new``; a block that is in both is taken from ``new``."""
    return held.join(new.select(*KEYS), list(KEYS), "left_anti").select(*new.columns).unionByName(new)


def read(spark: SparkSession, path: str) -> DataFrame:
    return tables.stored(spark, path, spark.createDataFrame([], SCHEMA).schema)


def store(new: DataFrame, path: str, files_per_year: int = 8) -> None:
    """Puts blocks into the table, which is partitioned by year; other years keep their files."""
    spark = new.sparkSession
    new = new.persist()
    year = F.year("block").alias("year")
    years = [r["year"] for r in new.select(year).distinct().collect()]
    rows = new
    if years and tables.path_exists(spark, path):
        held = spark.read.parquet(path).where(F.col("year").isin(years))
        rows = merge(held.select(*new.columns), new)
    part = F.pmod(F.xxhash64("series_id"), F.lit(files_per_year))
    (
        rows.select("*", year).repartition("year", part)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    )
    new.unpersist()


def _bridge_days(blocks: DataFrame, fill: Filling) -> DataFrame:
    """Lagged days between blocks, and the first two days of blocks; ``in_trend`` marks the former.

    The edges of all blocks, in order of date, make a sparse series whose segments are true ones at
    the borders of blocks.
    """
    ends = blocks.groupBy("series_id").agg(F.min("first_row").alias("a"), F.max("last_row").alias("b"))
    bare = F.struct(F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("price"))
    ends = ends.select("series_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("date"))
    points = blocks.select("series_id", F.explode("edges").alias("_e")).select("series_id", "_e.date", "_e.price")
    rows = ends.withColumn("price", bare["price"]).unionByName(points)
    rows = rows.groupBy("series_id", "date").agg(F.max("price").alias("price"))
    order = Window.partitionBy("series_id").orderBy("date")
    segs = with_tails(segments(rows, ("series_id",), fill), ("series_id",), fill)
    before = F.lag("date").over(order)
    segs = segs.filter("price is not null").withColumn("_before", before)
    second = F.lag("_opens").over(order)
    segs = segs.withColumn(
        "_opens", F.col("_before").isNull() | (block_of(F.col("_before")) != block_of(F.col("date")))
    ).withColumn("_second", second & ~F.col("_opens") & (F.date_add("_before", 1) == F.col("date")))
    last = F.col("next_date").isNull()
    crosses = last | (block_of(F.col("next_date")) != block_of(F.col("date")))

    def days(condition: Column, first: Column, to: Column, in_trend: bool) -> Column:
        some = F.when(condition & (first <= to), F.sequence(first, to)).otherwise(F.array().cast("array<date>"))
        return F.transform(some, lambda d: F.struct(d.alias("day"), F.lit(in_trend).alias("in_trend")))

    own, following = F.col("date"), F.date_add("date", 1)
    chosen = F.concat(
        days(F.col("_before").isNull(), F.col("seg_start"), F.date_sub("date", 1), True),
        days(F.col("_opens") | F.coalesce(F.col("_second"), F.lit(False)), own, own, False),
        days(F.col("_opens") & ~crosses & (following < F.col("next_date")), following, following, False),
        days(crosses, following, F.col("seg_end"), True),
    )
    day = F.col("day")
    return segs.withColumn("_d", F.explode(chosen)).select("*", "_d.day", "_d.in_trend").select(
        "series_id",
        day.alias("date"),
        price_on(day, fill).alias("price"),
        price_before(day, 1, fill).alias("price_1"),
        price_before(day, 2, fill).alias("price_2"),
        "in_trend",
    )


def _combined(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One cell per month and weekday: means and centred sums combine around the common mean."""
    group = (*keys, "month", "weekday")
    cell = Window.partitionBy(*group)
    n, t, z = F.col("n"), F.col("t_mean"), F.col("z_mean")
    size = F.sum("n").over(cell)
    around = cells.withColumns({"_t": F.sum(n * t).over(cell) / size, "_z": F.sum(n * z).over(cell) / size})
    t_off, z_off = t - F.col("_t"), z - F.col("_z")
    return around.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.first("_t").alias("t_mean"),
        F.first("_z").alias("z_mean"),
        F.sum(F.col("t_dev") + n * t_off * t_off).alias("t_dev"),
        F.sum(F.col("z_dev") + n * z_off * z_off).alias("z_dev"),
        F.sum(F.col("tz_dev") + n * t_off * z_off).alias("tz_dev"),
        *[F.sum(c).alias(c) for c in _ADDED],
        F.max_by("y_last", "last_date").alias("y_last"),
        F.max_by("d_last", "last_date").alias("d_last"),
        F.max("last_date").alias("last_date"),
    )


def fits(blocks: DataFrame, cut_offs: Iterable[date], fill: Filling = FORECAST) -> DataFrame:
    """Blend parameters per series and cut-off (``train_end``), as from one pass over the days."""
    cuts = sorted(set(cut_offs))
    for cut in cuts:
        if (cut + timedelta(days=1)).day != 1:
            raise ValueError(f"cut-off {cut} is not the last day of a month")
    keys = ("series_id", "train_end")
    upto = F.explode(literals.dates(cuts))
    inner = blocks.withColumn("train_end", upto).filter(F.col("block") <= F.col("train_end"))
    inner = inner.select(*keys, F.explode("cells").alias("_c")).select(*keys, "_c.*")
    days = _bridge_days(blocks, fill).withColumn("train_end", upto).filter(F.col("date") <= F.col("train_end"))
    bridges = _cells(days, keys, F.col("in_trend"), F.col("date"))
    # where a bridge and a block tell the same day, the bridge knows its difference
    both = inner.unionByName(bridges.select(*inner.columns))
    return closed_form.fold_seasons(_combined(both, keys), keys, ari=True)
