"""The changepoint fit from product sums against the fit over the days."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewatch.operators import seasonal_map

START = dt.date(2018, 3, 1)


@pytest.fixture
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, n, noise in (("long", 1500, 3.0), ("year", 380, 1.0), ("short", 12, 1.0), ("tiny", 2, 0.0), ("flat", 300, 0.0)):
        t = np.arange(n)
        y = 100 + 0.05 * t + np.where(t > n / 2, 0.1 * (t - n / 2), 0) + 8 * np.sin(2 * np.pi * t / 365.25) + noise * rng.standard_normal(n)
        if name == "flat":
            y = np.full(n, 7.0)
        rows += [(name, START + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, y)]
    return spark.createDataFrame(rows, "series_id string, date date, price double").repartition(7)


def fits(rows, steps=60):
    return {r["series_id"]: r for r in seasonal_map.fit_seasonal_map(rows.withColumn("steps", F.lit(steps))).collect()}


def test_same_paths_as_over_the_days(spark, panel):
    got = fits(panel)
    data = {}
    for r in panel.collect():
        data.setdefault(r["series_id"], []).append((r["date"], r["price"]))
    for name, rows in data.items():
        rows.sort()
        days = np.array([(d - dt.date(1970, 1, 1)).days for d, _ in rows], dtype=float)
        want = seasonal_map.fit_and_forecast(days, np.array([p for _, p in rows]), 60, log=False)
        assert got[name]["last_date"] == rows[-1][0]
        for part, w in zip(("yhat", "yhat_lower", "yhat_upper"), want):
            if len(rows) > 60:
                assert got[name][part] == pytest.approx(w, rel=1e-5, abs=1e-5), (name, part)
            else:  # fewer days than columns: both follow the days exactly and are free beyond them
                assert np.isfinite(got[name][part]).all() and len(got[name][part]) == 60


def test_gradient_vanishes_at_the_solution(spark, panel):
    """Normal equations recomputed from the days: the penalised gradient is zero to six digits."""
    slim = panel.select("series_id", F.unix_date("date").alias("day_no"), "price", F.lit(5).alias("steps"))
    rows = {r["series_id"]: r for r in seasonal_map.model_matrices(slim).collect()}
    r = rows["long"]
    knots = len(seasonal_map.knot_places(r["n"]))
    gram = np.array(r["gram"]).reshape(1, knots + 29, knots + 29)
    beta, noise = seasonal_map._mode(gram, np.array([float(r["n"])]), knots)
    own = [(d["day_no"], d["price"]) for d in slim.where("series_id = 'long'").collect()]
    days, y = (np.array(c, dtype=float) for c in zip(*sorted(own)))
    x = seasonal_map._columns(days, days[0], days[-1] - days[0], days[0] + seasonal_map.knot_places(len(days)))
    scales = np.array([5.0] * 2 + [0.05] * knots + [10.0] * 26)
    penalty = beta[0] / scales**2
    at = slice(2, 2 + knots)
    penalty[at] = np.sign(beta[0][at]) / seasonal_map.CHANGE_SCALE
    gradient = x.T @ (y / r["scale"] - x @ beta[0]) - noise[0] * penalty
    assert np.abs(np.r_[gradient[:2], gradient[2 + knots :]]).max() < 1e-6


def test_paths_do_not_depend_on_partitions_or_batches(spark, panel):
    whole = fits(panel.coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        small = fits(panel.repartition(11))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, r in whole.items():
        assert small[name]["yhat"] == pytest.approx(r["yhat"], rel=1e-6)
