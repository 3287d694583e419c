"""Risk features of the latest day of each series.

Every feature is an aggregate over the days of the calendar, conditional on
``rn`` (1 = last day): one hash aggregation yields all of them, with no sliding
frame, no window over days and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.config import RiskSettings
from pricewatch.operators.regularise import KEYS, RISK, explode_days, price_on, segments

# Thresholds of the reference rules.
TINY = 1e-10
VOL_FALLBACK_DAYS = 14
VOL_FLAT_RATIO = 0.5
VOL_MAX_RATIO = 20.0
TREND_WINDOWS = (14, 30, 60)
TREND_MIN_ROWS = 3
TREND_FLAT_STD = 1.0
TREND_STABLE_PCT = 0.5
SEASON_MIN_ROWS = 10


def _last(k: int) -> Column:
    return F.when(F.col("rn") <= k, F.col("price"))


def latest_rows(df: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last ``k`` rows of each series, numbered from the end.

    Spark limits each group before the exchange (window group limit).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def series_stats(obs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return obs.groupBy(*keys).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("price").alias("mean_price"),
        F.stddev_samp("price").alias("std_price"),
        F.max_by("price", "date").alias("last_price"),
    )


def average_aggregates(days: int) -> dict[str, Column]:
    return {
        "avg_n": F.count(_last(days)),
        "avg_last": F.avg(_last(days)),
        "std_last": F.stddev_samp(_last(days)),
    }


def history_aggregates() -> dict[str, Column]:
    return {
        "avg_all": F.avg("price"),
        "std_all": F.stddev_samp("price"),
        "vol_n": F.count("price"),
    }


def moving_average(days: int) -> Column:
    """Mean of the last ``days`` rows; the series mean while the window is not full."""
    return F.when(F.col("avg_n") == days, F.col("avg_last")).otherwise(F.col("avg_all"))


def deviation(days: int) -> Column:
    """Deviation of the last ``days`` rows; the series deviation if missing or flat."""
    return F.when((F.col("avg_n") == days) & (F.col("std_last") > TINY), F.col("std_last")).otherwise(
        F.col("std_all")
    )


def volatility_aggregates(recent: int, baseline: int) -> dict[str, Column]:
    return {
        "vol_recent": F.stddev_samp(_last(recent)),
        "vol_baseline": F.stddev_samp(_last(baseline)),
        "vol_fallback": F.stddev_samp(_last(VOL_FALLBACK_DAYS)),
    }


def volatility_ratio(baseline: int) -> Column:
    """Recent over baseline deviation in [0, 20].

    1.0 without enough rows or with a flat baseline. With a flat recent window
    the last 14 rows are tried; if those are flat too, 0.5. The fallback can
    help only when the recent window is shorter than 14 days.
    """
    recent = F.when(F.col("vol_recent") >= TINY, F.col("vol_recent")).when(
        F.col("vol_fallback") >= TINY, F.col("vol_fallback")
    )
    ratio = recent / F.col("vol_baseline")
    return (
        F.when(F.col("vol_n") < baseline, F.lit(1.0))
        .when(F.coalesce(F.col("vol_baseline"), F.lit(0.0)) < TINY, F.lit(1.0))
        .when(recent.isNull(), F.lit(VOL_FLAT_RATIO))
        .otherwise(F.greatest(F.lit(0.0), F.least(ratio, F.lit(VOL_MAX_RATIO))))
    )


def _trend_windows(window: int) -> tuple[int, ...]:
    return (window, *TREND_WINDOWS)


def trend_aggregates(window: int) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for k in dict.fromkeys(_trend_windows(window)):
        out[f"trend_n_{k}"] = F.count(_last(k))
        out[f"trend_std_{k}"] = F.stddev_samp(_last(k))
        out[f"trend_mean_{k}"] = F.avg(_last(k))
        out[f"trend_slope_{k}"] = F.regr_slope(_last(k), -F.col("rn").cast("double"))
    return out


def trend(window: int) -> Column:
    """struct<slope, direction> of the first window that moves.

    Windows of ``window``, 14, 30 and 60 rows are tried; one with fewer than 3
    rows or a deviation below 1.0 is skipped. The direction compares the slope
    with 0.5 % of the mean price; "stable" keeps its slope. All flat: (0, stable).
    """

    def stable(slope: Column) -> Column:
        return F.struct(slope.alias("slope"), F.lit("stable").alias("direction"))

    chain = None
    for k in _trend_windows(window):
        slope, mean = F.col(f"trend_slope_{k}"), F.col(f"trend_mean_{k}")
        pct = slope / mean * 100
        direction = (
            F.when(pct > TREND_STABLE_PCT, "up")
            .when(pct < -TREND_STABLE_PCT, "down")
            .otherwise("stable")
        )
        found = F.when(mean == 0, stable(F.lit(0.0))).otherwise(
            F.struct(slope.alias("slope"), direction.alias("direction"))
        )
        moves = (F.col(f"trend_n_{k}") >= TREND_MIN_ROWS) & (
            F.col(f"trend_std_{k}") >= TREND_FLAT_STD
        )
        chain = F.when(moves, found) if chain is None else chain.when(moves, found)
    return chain.otherwise(stable(F.lit(0.0)))


def season_aggregates(last_date: Column) -> dict[str, Column]:
    """All history in the month of the last historical date, this year included."""
    in_month = F.month("date") == F.month(last_date)
    return {
        "season_n": F.count(F.when(in_month, F.lit(1))),
        "season_avg": F.avg(F.when(in_month, F.col("price"))),
    }


def seasonal_baseline() -> Column:
    """Mean of the month; null with fewer than 10 calendar rows."""
    return F.when(F.col("season_n") >= SEASON_MIN_ROWS, F.col("season_avg"))


def _days(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    day = F.col("day")
    return explode_days(segs).select(
        *keys,
        day.alias("date"),
        price_on(day, RISK).alias("price"),
        "last_date",
        (F.datediff("last_date", day) + 1).alias("rn"),
    )


def _aggregate(rows: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[value.alias(name) for name, value in aggregates.items()])


def volatility_ratios(
    obs: DataFrame, recent: int, baseline: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Volatility ratio of each series for any pair of windows."""
    aggregates = {**volatility_aggregates(recent, baseline), "vol_n": F.count("price")}
    rows = _aggregate(_days(segments(obs, keys, RISK), keys), keys, aggregates)
    return rows.select(*keys, volatility_ratio(baseline).alias("vol_ratio"))


def risk_features(
    obs: DataFrame, settings: RiskSettings = RiskSettings(), keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per series with every historical input of the risk score.

    Zero prices count as prices here and gaps of any length are interpolated,
    unlike in the forecast path.
    """
    rows = _aggregate(
        _days(segments(obs, keys, RISK), keys),
        keys,
        {
            **average_aggregates(settings.average_days),
            **history_aggregates(),
            **volatility_aggregates(settings.vol_recent_days, settings.vol_baseline_days),
            **trend_aggregates(settings.trend_days),
            **season_aggregates(F.col("last_date")),
            "last_day": F.max("last_date"),
        },
    )
    found = trend(settings.trend_days)
    return rows.select(
        *keys,
        F.col("last_day").alias("last_date"),
        moving_average(settings.average_days).alias("moving_avg"),
        deviation(settings.average_days).alias("rolling_std"),
        volatility_ratio(settings.vol_baseline_days).alias("vol_ratio"),
        found["slope"].alias("trend_slope"),
        found["direction"].alias("direction"),
        seasonal_baseline().alias("seasonal_baseline"),
    )
