"""Flat tails, rolling statistics and risk features against plain pandas."""

from datetime import date

import numpy as np
import pandas as pd
import pytest

from pricewatch.operators import features, flat_tail, rolling


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize(
    "values, days",
    [
        (list(range(0, 1000, 10)), 1),
        ([5, 10] * 50 + [10] * 7, 8),
        ([7] * 200, 0),
        ([1] * 100 + [3] * 58, 0),
        ([1] * 100 + [3] * 30, 52),
        ([4], 0),
        ([4, 9], 0),
    ],
)
def test_flat_days(price_frame, values, days):
    assert one(flat_tail.flat_tail(price_frame(values)))["flat_days"] == days


def test_trim_guard(price_frame):
    moving = price_frame([5, 10] * 50 + [10] * 7)
    assert flat_tail.trim_flat_tail(moving).count() == 107 - 8
    long_tail = price_frame([5, 10] * 20 + [10] * 30)
    assert flat_tail.trim_flat_tail(long_tail).count() == 70


def test_rolling_equals_pandas(price_frame):
    rng = np.random.default_rng(3)
    values = rng.normal(500, 50, 120).round(2)
    df = rolling.rolling_std(rolling.rolling_mean(price_frame(values), 30), 30)
    got = df.orderBy("date").toPandas()
    s = pd.Series(values)
    np.testing.assert_allclose(got["rolling_mean"], s.rolling(30).mean(), equal_nan=True)
    np.testing.assert_allclose(got["rolling_std"], s.rolling(30).std(), equal_nan=True)


def test_volatility_window_comes_before_the_date_filter(price_frame):
    df = price_frame(np.arange(60) ** 2.0)
    rows = rolling.volatility_series(df, date(2020, 2, 1), date(2020, 2, 5)).orderBy("date").collect()
    want = pd.Series(np.arange(60) ** 2.0).rolling(30).std().iloc[31]
    assert len(rows) == 5 and rows[0]["volatility"] == pytest.approx(want)
    early = rolling.volatility_series(df, date(2020, 1, 1), date(2020, 1, 2)).collect()
    assert [r["volatility"] for r in early] == [0.0, 0.0]


def plain_ratio(s, recent=90, baseline=365):
    s = s.dropna()
    if len(s) < baseline or not s.tail(baseline).std() >= 1e-10:
        return 1.0
    for k in (recent, 14):
        if s.tail(k).std() >= 1e-10:
            return min(s.tail(k).std() / s.tail(baseline).std(), 20.0)
    return 0.5


def plain_trend(s):
    for w in (7, 14, 30, 60):
        y = s.dropna().tail(w).to_numpy()
        if len(y) < 3 or y.std(ddof=1) < 1.0:
            continue
        slope = np.polyfit(np.arange(len(y)), y, 1)[0]
        pct = slope / y.mean() * 100
        return slope, "up" if pct > 0.5 else "down" if pct < -0.5 else "stable"
    return 0.0, "stable"


def shapes():
    rng = np.random.default_rng(11)
    walk = 1000 + rng.normal(0, 20, 500).cumsum()
    yield "walk", walk
    yield "short", walk[:200]
    yield "tail10", np.r_[walk, [walk[-1]] * 10]
    yield "tail20", np.r_[walk, [walk[-1]] * 20]
    yield "tail70", np.r_[walk, [walk[-1]] * 70]
    yield "tail100", np.r_[walk, [walk[-1]] * 100]
    yield "constant", np.full(400, 123456.78)
    yield "rising", np.linspace(100, 900, 400)
    yield "two", np.array([5.0, 9.0])


@pytest.mark.parametrize("name, values", list(shapes()), ids=[n for n, _ in shapes()])
def test_risk_features_equal_pandas(price_frame, name, values):
    s = pd.Series(values, index=pd.date_range("2020-01-01", periods=len(values)))
    got = one(features.risk_features(price_frame(values)))
    mean30 = s.rolling(30).mean().fillna(s.mean()).iloc[-1]
    std30 = s.rolling(30).std().iloc[-1]
    std = std30 if std30 > 1e-10 else s.std()
    slope, direction = plain_trend(s)
    month = s[s.index.month == s.index.max().month]
    assert got["moving_avg"] == pytest.approx(mean30)
    assert got["rolling_std"] == pytest.approx(std, abs=1e-9)
    assert got["vol_ratio"] == pytest.approx(plain_ratio(s))
    assert got["trend_slope"] == pytest.approx(slope, abs=1e-9)
    assert got["direction"] == direction
    if len(month) < 10:
        assert got["seasonal_baseline"] is None
    else:
        assert got["seasonal_baseline"] == pytest.approx(month.mean())


def test_ratio_with_a_short_window_uses_the_fallback(price_frame):
    values = [100.0, 120.0] * 20 + [120.0] * 10
    got = one(features.volatility_ratios(price_frame(values), 7, 30))
    assert got["vol_ratio"] == pytest.approx(plain_ratio(pd.Series(values), 7, 30))
    assert 0 <= got["vol_ratio"] <= 20


def test_one_row_series_has_no_deviation(price_frame):
    got = one(features.risk_features(price_frame([9.0])))
    assert got["rolling_std"] is None and got["vol_ratio"] == 1.0


def test_latest_rows_and_stats(price_frame):
    df = price_frame([1.0, 2.0, 4.0])
    assert sorted(r["price"] for r in features.latest_rows(df, 2).collect()) == [2.0, 4.0]
    stats = one(features.series_stats(df))
    assert stats["last_price"] == 4.0 and stats["n_rows"] == 3
