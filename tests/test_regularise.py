"""Calendars and gap filling against pandas."""

import numpy as np
import pandas as pd
import pytest

from pricewatch.operators import closed_form
from pricewatch.operators.regularise import (
    FORECAST,
    MODEL,
    RISK,
    daily_calendar,
    forward_backward_fill,
    regularise,
    segments,
)


def prices(df):
    return [r["price"] for r in df.orderBy("date").collect()]


def sparse(seed, n=400, keep=0.2, zeros=True):
    rng = np.random.default_rng(seed)
    values = [float(rng.integers(100, 999)) if rng.random() < keep else None for _ in range(n)]
    values[0] = None if seed % 2 else 150.0
    values[-1] = 0.0 if seed % 2 else 175.0
    gap = slice(100, 160)
    values[gap] = [None] * 60
    if zeros:
        values[50] = 0.0
    return values


def test_interpolation_limit_30(price_frame):
    values = [None, 1.0] + [None] * 35 + [38.0, None, None]
    got = prices(regularise(price_frame(values)))
    assert got[0] == 1.0
    assert got[31] == pytest.approx(31.8333, abs=1e-4) or got[31] == pytest.approx(1 + 37 * 30 / 36)
    assert got[32:37] == pytest.approx([got[31]] * 5)
    assert got[37:] == [38.0, 38.0, 38.0]


@pytest.mark.parametrize("seed", range(4))
def test_forecast_filling_equals_pandas(price_frame, seed):
    values = sparse(seed)
    s = pd.Series([np.nan if v is None else v for v in values]).replace(0, np.nan)
    want = s.interpolate(method="linear", limit=30).ffill().bfill()
    assert prices(regularise(price_frame(values), fill=FORECAST)) == pytest.approx(want.tolist())


@pytest.mark.parametrize("seed", range(4))
def test_risk_filling_equals_pandas(price_frame, seed):
    values = sparse(seed)
    want = pd.Series([np.nan if v is None else v for v in values]).interpolate(method="linear")
    got = [np.nan if v is None else v for v in prices(regularise(price_frame(values), fill=RISK))]
    np.testing.assert_allclose(got, want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("fill", [FORECAST, RISK, MODEL])
@pytest.mark.parametrize("seed", range(2))
def test_lagged_days_are_shifts(price_frame, fill, seed):
    from pricewatch.operators.regularise import with_tails

    segs = with_tails(segments(price_frame(sparse(seed), skip_missing=True), fill=fill), fill=fill)
    rows = closed_form.lagged_days(segs, fill=fill).orderBy("date").toPandas()
    for back in (1, 2):
        np.testing.assert_allclose(
            rows[f"price_{back}"].to_numpy(dtype=float),
            rows["price"].shift(back).to_numpy(dtype=float),
            equal_nan=True,
        )


def test_calendar_is_gap_free_and_keeps_prices(price_frame):
    values = [5.0, None, None, 7.0, None, 9.0]
    got = prices(daily_calendar(price_frame(values, skip_missing=True)))
    assert got == values


def test_duplicate_dates_are_an_error(spark, price_frame):
    twice = price_frame([1.0, 2.0]).unionByName(price_frame([3.0]))
    with pytest.raises(Exception, match="duplicate date"):
        regularise(twice).collect()
    with pytest.raises(Exception, match="duplicate date"):
        daily_calendar(twice).collect()


def test_edge_series(price_frame):
    assert prices(regularise(price_frame([4.0]))) == [4.0]
    assert prices(regularise(price_frame([None, None, None]))) == [None] * 3
    assert prices(regularise(price_frame([0.0, 0.0]))) == [None, None]
    assert prices(regularise(price_frame([0.0, 0.0]), fill=RISK)) == [0.0, 0.0]
    leap = regularise(price_frame([1.0, None, 3.0], start="2020-02-28", skip_missing=True))
    assert [str(r["date"]) for r in leap.orderBy("date").collect()][1] == "2020-02-29"


def test_nan_is_missing(price_frame):
    assert prices(regularise(price_frame([1.0, float("nan"), 3.0]))) == [1.0, 2.0, 3.0]


def test_forward_backward_fill(price_frame):
    assert prices(forward_backward_fill(price_frame([None, 1.0, None, 2.0, None]))) == [1, 1, 1, 2, 2]


def test_rank_counts_from_the_end(price_frame):
    rows = regularise(price_frame([1.0, None, 3.0])).orderBy("date").collect()
    assert [r["rn"] for r in rows] == [3, 2, 1]
    assert [r["is_observed"] for r in rows] == [True, False, True]
