"""Metrics and model choice."""

import datetime as dt

import numpy as np
import pytest

from pricewatch import config
from pricewatch.plans import evaluation, report
from pricewatch.operators import metrics
from pyspark.sql import functions as F


def metric(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "price double, yhat double")
    row = df.agg(
        metrics.mape(F.col("price"), F.col("yhat"), **options).alias("mape"),
        metrics.rmse(F.col("price"), F.col("yhat")).alias("rmse"),
    ).collect()[0]
    return row["mape"], row["rmse"]


def test_metrics(spark):
    assert metric(spark, [(100.0, 110.0), (0.0, 5.0), (200.0, 180.0)])[0] == pytest.approx(10.0)
    assert metric(spark, [(3.0, 4.0)], digits=2)[0] == 33.33
    assert metric(spark, [(0.0, 4.0)]) == (None, 4.0)
    assert metric(spark, [(0.0, 4.0)], mask_zero=False)[0] == float("inf")
    assert metric(spark, [(1.0, 4.0), (1.0, None)]) == (None, None)
    assert metric(spark, []) == (None, None)


RESULT = "series_id string, horizon string, model string, rmse double, mape double"


def test_winner_rules(spark):
    rows = [
        ("s", "short", "arima", 1.0, 5.0), ("s", "short", "seasonal", 9.0, 6.0),
        ("s", "mid", "arima", 1.0, 5.0), ("s", "mid", "seasonal", 2.0, 5.0),
        ("s", "long", "arima", 1.0, 5.0), ("s", "long", "seasonal", None, None),
    ]
    df = evaluation.recommendation(spark.createDataFrame(rows, RESULT), "arima", "seasonal")
    got = {r["horizon"]: (r["model"], r["rmse"]) for r in df.collect()}
    assert got == {"short": ("arima", 1.0), "mid": ("seasonal", 2.0), "long": (None, None)}


SETTINGS = config.Settings(
    eval_windows=(config.EvalWindow("short", dt.date(2020, 5, 31), dt.date(2020, 6, 1), dt.date(2020, 6, 10)),)
)


def test_positional_pairs_shift_over_missing_days(price_frame):
    rng = np.random.default_rng(1)
    values = list(100 + rng.normal(0, 5, 162))
    values[155] = None
    obs = price_frame(values, skip_missing=True)
    by_position = evaluation.predictions(obs, SETTINGS).orderBy("date").collect()
    by_date = evaluation.predictions(obs, SETTINGS, align="date").orderBy("date").collect()
    assert [r["step"] for r in by_position] == list(range(1, 10))
    assert by_position[0]["yhat_arima"] == by_date[0]["yhat_arima"]
    assert by_position[3]["yhat_seasonal"] != by_date[3]["yhat_seasonal"]
    with pytest.raises(ValueError):
        evaluation.predictions(obs, SETTINGS, align="other")


def test_summary_without_overlap_is_zero(spark):
    forecast = spark.createDataFrame(
        [("s", "short", dt.date(2020, 1, 1), 5.0), ("s", "short", dt.date(2020, 1, 2), None)],
        "series_id string, horizon string, forecast_date date, yhat double",
    )
    empty = spark.createDataFrame([], "series_id string, date date, price double")
    row = report.forecast_summary(forecast, empty).collect()[0]
    assert (row["avg_forecast"], row["mape"]) == (5.0, 0.0)
    assert row["forecast_start"] == dt.date(2020, 1, 1)


def test_window_of_zeros_takes_the_second_model(spark, price_frame):
    """Every percentage error is undefined there; a failed model still leaves no winner."""
    rows = [
        ("s", "short", "arima", 1.0, None), ("s", "short", "seasonal", 9.0, None),
        ("s", "mid", "arima", 1.0, 5.0), ("s", "mid", "seasonal", None, None),
    ]
    won = {r["horizon"]: r["winner"] for r in evaluation.winner(spark.createDataFrame(rows, RESULT), "arima", "seasonal").collect()}
    assert won == {"short": "seasonal", "mid": None}
    values = [100.0 + i % 7 for i in range(701)] + [0.0] * 31
    obs = price_frame(values, start="2023-12-31")  # the last days are the short window
    results = evaluation.compare_models(obs)
    short = [r for r in results.collect() if r["horizon"] == "short"]
    assert all(r["mape"] is None and r["rmse"] is not None and r["n"] == 31 for r in short) and len(short) == 2
    won = {r["horizon"]: r["winner"] for r in evaluation.winner(results, "arima", "seasonal").collect()}
    assert won["short"] == "seasonal"
