"""Risk score: golden values and properties."""

import math

import pytest
from pyspark.sql import functions as F

from pricewatch.functions import cleaning, numeric, scoring
from pricewatch.plans import forecasting, risk

FIELDS = (
    "series_id string, last_date date, horizon string, forecast double, moving_avg double,"
    " rolling_std double, vol_ratio double, trend_slope double, direction string,"
    " seasonal_baseline double"
)


def score(spark, *rows):
    import datetime

    full = [
        ("s", datetime.date(2026, 1, 31), h, f, a, sd, v, 0.0, d, b) for h, f, a, sd, v, d, b in rows
    ]
    return [r.asDict(recursive=True) for r in risk.score(spark.createDataFrame(full, FIELDS)).collect()]


BASE = 66953.55933325243


@pytest.mark.parametrize(
    "horizon, forecast, deviation, total, points",
    [
        ("short", 92270.24273195377, 37.81230400715654, 10, 10.0),
        ("mid", 32193.141177279016, -51.91720724354333, 10, 10.0),
        ("long", 61944.94426863636, -7.480730097837447, 2, 2.5),
    ],
)
def test_golden_scores(spark, horizon, forecast, deviation, total, points):
    (row,) = score(spark, (horizon, forecast, 0.0, 0.0, 0.5, "stable", BASE))
    assert row["seasonal_deviation"] == pytest.approx(deviation, rel=1e-12)
    assert row["risk_score"] == total and row["risk_level"] == "Normal"
    assert row["breakdown"]["seasonal_score"] == points
    assert row["fdi_value"] == 0.0


def test_undefined_deviation_gives_the_fallback(spark):
    rows = score(
        spark,
        ("short", 1.0, 1.0, None, 1.0, "up", None),
        ("mid", None, 1.0, 2.0, 1.0, "up", None),
    )
    for row in rows:
        assert (row["risk_score"], row["risk_level"], row["direction"]) == (0, "Normal", "stable")
        assert (row["fdi_value"], row["vol_ratio"], row["trend_slope"]) == (0.0, 1.0, 0.0)
        assert row["risk_message"] == scoring.FALLBACK_TEXT


def test_components_and_bounds(spark):
    rows = score(
        spark,
        ("short", 160.0, 100.0, 10.0, 4.0, "up", 50.0),
        ("short", 160.0, 100.0, 10.0, 4.0, "down", 50.0),
        ("short", 100.0, 100.0, 10.0, 1.0, "stable", None),
    )
    assert [r["risk_score"] for r in rows] == [100, 90, 0]
    assert [r["risk_level"] for r in rows] == ["Bahaya", "Bahaya", "Normal"]


def test_score_grows_with_the_deviation(spark):
    rows = score(spark, *[("mid", 100.0 + k, 100.0, 10.0, 1.5, "stable", None) for k in range(0, 80, 5)])
    totals = [r["risk_score"] for r in rows]
    assert totals == sorted(totals) and 0 <= totals[0] and totals[-1] <= 100


def test_messages(spark):
    rows = score(
        spark,
        ("short", 120.0, 100.0, 10.0, 2.25, "up", None),
        ("mid", 80.0, 100.0, 10.0, 1.3, "down", None),
        ("other", 101.0, 100.0, 10.0, 1.0, "stable", None),
    )
    assert rows[0]["risk_message"] == (
        "Forecast 30 hari ke depan berpotensi 30% di atas rata-rata 30 hari — volatilitas saat ini"
        " 2.2x lebih tinggi dari normal, tren harga cenderung naik dalam 7 hari terakhir."
    )
    assert rows[1]["risk_message"] == (
        "Forecast 6 bulan ke depan berpotensi 30% di bawah rata-rata 30 hari — volatilitas mulai"
        " meningkat (1.3x dari normal), tren harga cenderung turun dalam 7 hari terakhir."
    )
    assert rows[2]["risk_message"] == "Forecast other berada dalam rentang normal."


def test_half_even_and_safe_double(spark):
    df = spark.sql("select explode(array(0.5d, 1.5d, 2.5d)) as x")
    assert [r[0] for r in df.select(numeric.half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0]
    bad = spark.sql("select explode(array('1.5', 'nan', 'inf', 'x', null)) as x")
    got = [r[0] for r in bad.select(numeric.safe_double(F.col("x"), -1.0)).collect()]
    assert got == [1.5, -1.0, -1.0, -1.0, -1.0]


def test_an_explosive_series_does_not_end_the_job(spark, price_frame):
    calm = price_frame([1000.0 + i % 9 for i in range(400)], series="calm")
    wild = price_frame([float(10 ** (6 * i)) for i in range(1, 8)], start="2021-01-25", series="wild")
    rows = risk.assess(calm.unionByName(wild).unionByName(price_frame([5.0], series="one"))).collect()
    assert {r["series_id"] for r in rows} == {"calm", "wild", "one"}
    for r in rows:
        assert all(abs(r[c]) < float("inf") for c in ("risk_score", "fdi_value", "vol_ratio", "trend_slope"))
        assert r["risk_message"] and r["risk_level"]


def test_java_number_forms_are_no_numbers(spark):
    df = spark.createDataFrame([("5d",), ("5f",), ("0x1p3",), ("NaN",), ("1.5e2",), (" 7 ",), (None,)], "t string")
    got = df.select(numeric.safe_double(F.col("t"), -1.0).alias("s"), cleaning.parse_price(F.col("t")).alias("p")).collect()
    assert [r["s"] for r in got] == [-1.0, -1.0, -1.0, -1.0, 150.0, 7.0, -1.0]
    assert [r["p"] for r in got] == [None, None, None, None, 1500.0, 7.0, None]


def test_slope_at_the_bound_keeps_no_momentum(spark, price_frame):
    steps = [0.01 * 1.1**i for i in range(40)]  # each log step is 1.1 times the last
    prices = price_frame([math.exp(sum(steps[: i + 1])) for i in range(40)])
    rows = forecasting.forecast_operational(prices).where("horizon = 'short'").collect()
    assert len(rows) == 30 and all(r["yhat"] < 1e20 for r in rows)
