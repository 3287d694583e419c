"""Composite risk score: components, level and message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewatch.functions.numeric import half_even

# Caps and points of the four components.
FLAT_STD = 1e-10
FDI_CAP, FDI_POINTS = 5.0, 40
VOL_SPAN, VOL_POINTS = 2.0, 30
TREND_POINTS, TREND_MIXED = 20.0, 0.5
SEASON_SPAN, SEASON_POINTS = 30.0, 10
MAX_SCORE = 100

# Level limits and names.
LEVELS = ((30, "Normal"), (60, "Waspada"))
TOP_LEVEL = "Bahaya"

# Message texts.
HORIZON_LABELS = {
    "short": "30 hari ke depan",
    "mid": "6 bulan ke depan",
    "long": "12 bulan ke depan",
}
NORMAL_TEXT = "berada dalam rentang normal"
ABOVE_TEXT = "% di atas rata-rata 30 hari"
BELOW_TEXT = "% di bawah rata-rata 30 hari"
UP_TEXT = "tren harga cenderung naik dalam 7 hari terakhir"
DOWN_TEXT = "tren harga cenderung turun dalam 7 hari terakhir"
FALLBACK_TEXT = "Data tidak cukup untuk kalkulasi risiko."


def forecast_deviation(forecast: Column, average: Column, std: Column) -> Column:
    """z-score of the forecast against the moving average; a flat series gives 0."""
    return F.when(F.abs(std) < FLAT_STD, F.lit(0.0)).otherwise((forecast - average) / std)


def seasonal_deviation(forecast: Column, baseline: Column) -> Column:
    """Percent above or below the seasonal baseline; null without a positive baseline."""
    return F.when(baseline > 0, (forecast - baseline) / baseline * 100)


def fdi_score(fdi: Column) -> Column:
    return F.when(fdi.isNotNull(), F.least(F.abs(fdi), F.lit(FDI_CAP)) / FDI_CAP * FDI_POINTS)


def vol_score(ratio: Column) -> Column:
    excess = F.greatest(ratio - 1.0, F.lit(0.0))
    return F.when(
        ratio.isNotNull(), F.least(excess / VOL_SPAN * VOL_POINTS, F.lit(float(VOL_POINTS)))
    )


def trend_score(direction: Column, fdi: Column) -> Column:
    """Points for a moving price, halved when it moves against the forecast."""
    moving = direction.isin("up", "down")
    against = ((direction == "down") & (fdi > 0)) | ((direction == "up") & (fdi < 0))
    return (
        F.when(moving & against, F.lit(TREND_POINTS * TREND_MIXED))
        .when(moving, F.lit(TREND_POINTS))
        .otherwise(F.lit(0.0))
    )


def seasonal_score(deviation: Column) -> Column:
    points = F.least(
        F.abs(deviation) / SEASON_SPAN * SEASON_POINTS, F.lit(float(SEASON_POINTS))
    )
    return F.when(deviation.isNotNull(), points).otherwise(F.lit(0.0))


def breakdown(fdi: Column, ratio: Column, direction: Column, deviation: Column) -> Column:
    """struct of the component scores (1 digit) and the total (0..100, half to even)."""
    parts = {
        "fdi_score": fdi_score(fdi),
        "vol_score": vol_score(ratio),
        "trend_score": trend_score(direction, fdi),
        "seasonal_score": seasonal_score(deviation),
    }
    total = parts["fdi_score"] + parts["vol_score"] + parts["trend_score"] + parts["seasonal_score"]
    return F.struct(
        *[half_even(value, 1).alias(name) for name, value in parts.items()],
        F.when(total.isNotNull(), F.least(half_even(total), F.lit(float(MAX_SCORE))))
        .cast("int")
        .alias("total"),
    )


def level(score: Column) -> Column:
    chain = F.when(score < LEVELS[0][0], LEVELS[0][1])
    for limit, name in LEVELS[1:]:
        chain = chain.when(score < limit, name)
    return chain.when(score.isNotNull(), TOP_LEVEL)


def horizon_label(horizon: Column) -> Column:
    """Words for the horizon; an unknown horizon stands for itself."""
    chain = None
    for name, text in HORIZON_LABELS.items():
        hit = horizon == name
        chain = F.when(hit, text) if chain is None else chain.when(hit, text)
    return chain.otherwise(horizon)


def message(fdi: Column, ratio: Column, direction: Column, horizon: Column) -> Column:
    """One sentence: the forecast, then volatility and trend where they matter.

    The trend text says 7 days whichever window the slope came from.
    """
    percent = half_even(F.abs(fdi) * 15).try_cast("decimal(38,0)").cast("string")
    opening = F.concat(F.lit("Forecast "), horizon_label(horizon))
    outlook = (
        F.when(F.abs(fdi) < 0.5, F.concat(opening, F.lit(f" {NORMAL_TEXT}")))
        .when(fdi > 0, F.concat(opening, F.lit(" berpotensi "), percent, F.lit(ABOVE_TEXT)))
        .otherwise(F.concat(opening, F.lit(" berpotensi "), percent, F.lit(BELOW_TEXT)))
    )
    times = half_even(ratio, 1).cast("string")
    volatility = F.when(
        ratio >= 2.0,
        F.concat(F.lit("volatilitas saat ini "), times, F.lit("x lebih tinggi dari normal")),
    ).when(
        ratio >= 1.3,
        F.concat(F.lit("volatilitas mulai meningkat ("), times, F.lit("x dari normal)")),
    )
    trend = F.when(direction == "up", UP_TEXT).when(direction == "down", DOWN_TEXT)
    details = F.concat_ws(", ", volatility, trend)
    return F.concat(
        outlook, F.when(details != "", F.concat(F.lit(" — "), details)).otherwise(F.lit("")), F.lit(".")
    )
