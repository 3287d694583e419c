"""Forecast models: parity with numpy, recovery of known processes, labels."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewatch import config
from pricewatch.operators import closed_form, sarima, seasonal_map
from pricewatch.operators.regularise import segments
from pricewatch.plans import forecasting


def one(df):
    return df.collect()[0].asDict()


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(5)
    t = np.arange(900)
    return 1000 + 0.5 * t + 80 * np.sin(2 * np.pi * t / 365.25) + rng.normal(0, 15, 900)


def test_ari_equals_numpy(price_frame, noisy):
    got = one(closed_form.fit_ari(segments(price_frame(noisy))).withColumn(
        "f", closed_form.ari_at(F.lit(10.0))))
    y = np.log(noisy)
    d = np.diff(y)
    phi, c = np.polyfit(d[:-1], d[1:], 1)
    assert got["phi"] == pytest.approx(phi, rel=1e-9)
    last, step, level = d[-1], 0.0, y[-1]
    for _ in range(10):
        last = c + phi * last
        level += last
    assert got["f"] == pytest.approx(np.exp(level), rel=1e-9)
    assert step == 0.0


def test_constant_series_is_forecast_flat(price_frame):
    df = price_frame([250000.0] * 60)
    fit = one(closed_form.fit_ari(segments(df)).withColumn("f", closed_form.ari_at(F.lit(30.0))))
    assert fit["f"] == pytest.approx(250000.0)
    seasonal = closed_form.fit_seasonal(df)
    row = one(seasonal.withColumn("f", closed_form.seasonal_at(F.lit(30.0))[0]))
    assert row["f"] == pytest.approx(250000.0) and row["sigma"] == pytest.approx(0.0, abs=1e-6)


def test_one_row_series(price_frame):
    assert one(closed_form.fit_seasonal(price_frame([4.0])))["sigma"] == 0.0
    assert one(closed_form.fit_ari(segments(price_frame([4.0]))))["phi"] == 0.0


@pytest.mark.parametrize("log", [False, True])
def test_seasonal_equals_pandas(price_frame, noisy, log):
    got = one(closed_form.fit_seasonal(price_frame(noisy), log=log))
    idx = pd.date_range("2020-01-01", periods=len(noisy))
    y = pd.Series(np.log1p(noisy) if log else noisy, index=idx)
    t = np.arange(len(y)) - (len(y) - 1.0)
    slope, level = np.polyfit(t, y, 1)
    r = y - level - slope * t
    month = r.groupby(r.index.month).transform("mean")
    week = (r - month).groupby(r.index.dayofweek).transform("mean")
    sigma = np.sqrt(((r - month - week) ** 2).sum() / (len(y) - 1))
    assert got["slope"] == pytest.approx(slope, rel=1e-6)
    assert got["level"] == pytest.approx(level, rel=1e-9)
    assert got["sigma"] == pytest.approx(sigma, rel=1e-6)


def test_blend_golden():
    golden = [
        ("short", 102700.00000000009, 50551.2136597685, 92270.24273195377),
        ("mid", 26999.999999999996, 37386.28235455803, 32193.141177279016),
        ("long", 102700.00000000009, 44478.491812337634, 61944.94426863636),
        ("short", 30000.000000000007, 36655.99353862585, 31331.198707725176),
        ("mid", 39999.99999999997, 41804.101402635504, 40902.05070131774),
        ("long", 25000.0, 29964.099163244406, 28474.86941427108),
    ]
    for horizon, arima, seasonal, want in golden:
        w = config.DEFAULT.weights(horizon)
        assert arima * w.arima + seasonal * w.seasonal == pytest.approx(want, rel=1e-12)
    assert config.DEFAULT.weights("other") == config.Weights(0.5, 0.5)


def test_eval_steps():
    assert [w.days for w in config.EVAL_WINDOWS] == [31, 184, 365]


SETTINGS = config.Settings(
    horizons=(config.Horizon("short", 5, date(2020, 6, 30)), config.Horizon("long", 9, date(2020, 6, 30))),
    eval_windows=(config.EvalWindow("short", date(2020, 5, 31), date(2020, 6, 1), date(2020, 6, 4)),),
)


def test_operational_labels_ignore_the_trimmed_tail(price_frame, noisy):
    values = list(noisy[:170]) + [float(noisy[169])] * 4
    out = forecasting.forecast_operational(price_frame(values), SETTINGS)
    rows = out.filter("horizon = 'short'").orderBy("step").collect()
    assert [str(r["forecast_date"]) for r in rows] == [f"2020-07-0{i}" for i in range(1, 6)]
    # Training ends 2020-06-22; four equal rows and the one before them are trimmed or kept as counted.
    assert rows[0]["origin_gap_days"] > 8
    assert out.count() == 14


def test_backtest_is_aligned_by_date(price_frame, noisy):
    # The series ends three days before the cut-off: the last labels have no forecast.
    values = list(noisy[:149])
    rows = forecasting.forecast_backtest(price_frame(values), SETTINGS).orderBy("step").collect()
    assert [r["yhat"] is None for r in rows] == [False, True, True, True]


def test_blend_lies_between_its_inputs(price_frame, noisy):
    fits = forecasting.operational_fits(price_frame(noisy[:170]), SETTINGS)
    step = F.lit(3.0)
    row = one(
        fits.select(
            closed_form.ari_at(step).alias("a"),
            closed_form.seasonal_at(step)[0].alias("s"),
            forecasting.blended_at(step)[0].alias("b"),
        )
    )
    assert min(row["a"], row["s"]) <= row["b"] <= max(row["a"], row["s"])


def test_sarima_recovers_an_autoregression(price_frame):
    rng = np.random.default_rng(9)
    v = np.zeros(1500)
    for i in range(1, 1500):
        v[i] = 0.7 * v[i - 1] + rng.normal(0, 0.05)
    df = price_frame(np.exp(7 + v))
    fit = one(sarima.fit_sarima(sarima.daily_logs(segments(df)), F.lit(60)))
    assert (fit["d"], fit["seasonal_d"]) == (0, 0)
    assert (fit["p"], fit["q"]) == (1, 0) and fit["ar"][0] == pytest.approx(0.7, abs=0.06)
    assert fit["path"][0] == pytest.approx(np.exp(7 + 0.7 * v[-1]), rel=0.05)
    assert fit["path"][-1] == pytest.approx(np.exp(7), rel=0.05)


def test_sarima_differences_a_random_walk_and_beats_nothing_flat(price_frame):
    rng = np.random.default_rng(2)
    walk = np.exp(8 + rng.normal(0, 0.02, 1200).cumsum())
    fit = one(sarima.fit_sarima(sarima.daily_logs(segments(price_frame(walk))), F.lit(20)))
    assert fit["d"] == 1
    assert fit["path"][0] == pytest.approx(walk[-1], rel=0.05)
    flat = one(sarima.fit_sarima(sarima.daily_logs(segments(price_frame([5.0] * 400))), F.lit(3)))
    assert flat["path"] == pytest.approx([5.0] * 3)


def test_sarima_follows_weekly_seasons(price_frame):
    rng = np.random.default_rng(4)
    week = np.tile([0.0, 0.3, -0.2, 0.1, 0.4, -0.3, 0.2], 200)
    values = np.exp(6 + week + rng.normal(0, 0.02, 1400))
    fit = one(sarima.fit_sarima(sarima.daily_logs(segments(price_frame(values))), F.lit(14)))
    want = np.exp(6 + week[:14])
    assert np.mean(np.abs(np.array(fit["path"]) / want - 1)) < 0.06


def test_sarima_fits_short_series_and_says_what_it_cannot_fit(price_frame):
    rng = np.random.default_rng(6)
    week = np.tile([0.0, 0.3, -0.2, 0.1, 0.4, -0.3, 0.2], 10)
    values = np.exp(6 + week + rng.normal(0, 0.01, 70))
    for days in (45, 69):
        fit = one(sarima.fit_sarima(sarima.daily_logs(segments(price_frame(values[:days]))), F.lit(7)))
        assert fit["status"] == "fitted"
        assert np.mean(np.abs(np.array(fit["path"]) / np.exp(6 + np.tile(week[:7], 2)[days % 7 : days % 7 + 7]) - 1)) < 0.15
    for values, status in (([5.0] * 400, "constant"), ([5.0, 6.0, 5.5], "too short")):
        assert one(sarima.fit_sarima(sarima.daily_logs(segments(price_frame(values))), F.lit(3)))["status"] == status


def test_variance_lags_grow_with_the_series():
    rng = np.random.default_rng(3)
    e = np.convolve(rng.normal(0, 1, 4030), np.ones(31), mode="valid")  # correlated over 30 days, but level
    assert int(3 * np.sqrt(len(e)) / 13) == 14
    centred = e - e.mean()
    variance = centred @ centred + 2 * sum((1 - k / 15) * (centred[k:] @ centred[:-k]) for k in range(1, 15))
    want = (np.cumsum(centred) ** 2).sum() / len(e) / variance > sarima.STATIONARY_CRITICAL
    assert sarima._moves(e) == want


@pytest.mark.parametrize("log", [False, True])
def test_changepoint_model_beats_seasonal_naive(price_frame, log):
    rng = np.random.default_rng(8)
    t = np.arange(1500)
    year, week = np.sin(2 * np.pi * t / 365.25), 1.0 * (t % 7 == 2)
    if log:
        # The log variant models ln(y + 1) as trend x (1 + seasonality).
        centre = (6.2 + 0.0004 * t) * (1 + 0.02 * year + 0.004 * week)
        truth, values = np.expm1(centre), np.expm1(centre + rng.normal(0, 0.015, 1500))
    else:
        truth = 500 + 0.3 * t + 60 * year + 10 * week
        values = truth + rng.normal(0, 8, 1500)
    df = price_frame(values[:1400]).withColumn("steps", F.lit(100))
    row = one(seasonal_map.fit_seasonal_map(df, log=log))
    error = np.abs(np.array(row["yhat"]) - truth[1400:]).mean()
    naive = np.abs(values[1400 - 365 : 1500 - 365] - truth[1400:]).mean()
    assert error < naive / 2
    inside = (np.array(row["yhat_lower"]) < values[1400:]) & (values[1400:] < np.array(row["yhat_upper"]))
    assert inside.mean() > 0.8
    assert str(row["last_date"]) == str(pd.Timestamp("2020-01-01") + pd.Timedelta(days=1399))[:10]
