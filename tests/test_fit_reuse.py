"""Stored fits: reuse, refit, deletion, and failures between the steps of a write."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricewatch import schemas
from pricewatch.catalog.fixture import SETTINGS
from pricewatch.operators import versions
from pricewatch.plans import fit_reuse, forecasting

NOW = datetime(2002, 1, 1)


@pytest.fixture
def panel(price_frame):
    values = [100.0 + (i * 37 % 23) + i / 50 for i in range(900)]
    a = price_frame(values, start="1999-06-01", series="a")
    return a.unionByName(price_frame([v * 2 for v in values[:700]], start="1999-06-01", series="b"))


def rows(df):
    return sorted(tuple(r) for r in df.select("series_id", "horizon", "step", "forecast_date", "yhat", "yhat_lower").collect())


def test_forecast_from_the_table_equals_the_direct_one(spark, panel, tmp_path):
    path = str(tmp_path / "fits")
    assert fit_reuse.refresh(panel, path, NOW, SETTINGS) == 6
    got = rows(fit_reuse.forecast_from_stored_fits(spark, path, SETTINGS))
    want = rows(forecasting.forecast_operational(panel, SETTINGS))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-12)


def test_only_stale_series_are_fitted(spark, panel, tmp_path, monkeypatch):
    path = str(tmp_path / "fits")
    fit_reuse.refresh(panel, path, NOW, SETTINGS)
    seen = []
    real = forecasting.operational_fits
    monkeypatch.setattr(
        forecasting, "operational_fits",
        lambda obs, s: seen.append({r["series_id"] for r in obs.select("series_id").distinct().collect()}) or real(obs, s),
    )
    assert fit_reuse.refresh(panel, path, NOW, SETTINGS) == 0 and versions.current(spark, path) == 1
    first = F.col("date") == F.lit("1999-06-01").cast("date")
    corrected = panel.withColumn("price", F.when((F.col("series_id") == "b") & first, 5.0).otherwise(F.col("price")))
    assert fit_reuse.refresh(corrected, path, NOW, SETTINGS) == 3
    assert seen == [{"b"}]
    later = NOW + timedelta(hours=SETTINGS.fit_ttl_hours + 1)
    assert fit_reuse.refresh(corrected, path, later, SETTINGS) == 6


def test_stored_rows_are_what_a_forecast_uses(spark, panel, tmp_path):
    path = str(tmp_path / "fits")
    fit_reuse.refresh(panel, path, NOW, SETTINGS)
    held = versions.read(spark, path, schemas.MODEL_PARAMS)
    level = fit_reuse.NUMBERS.index("level")
    raised = held.withColumn("params", F.transform("params", lambda p, i: F.when(i == level, p + 1000.0).otherwise(p)))
    before = rows(fit_reuse.forecast_from_stored_fits(spark, path, SETTINGS))
    versions.commit(raised, path, 1)
    assert fit_reuse.refresh(panel, path, NOW, SETTINGS) == 0
    after = rows(fit_reuse.forecast_from_stored_fits(spark, path, SETTINGS))
    assert all(a[4] > b[4] + 100 for a, b in zip(after, before))


def test_deletions(spark, panel, tmp_path):
    path = str(tmp_path / "fits")

    def keys():
        return {(r["series_id"], r["scope"], r["horizon"]) for r in versions.read(spark, path, schemas.MODEL_PARAMS).collect()}

    fit_reuse.refresh(panel, path, NOW, SETTINGS)
    fit_reuse.refresh(panel, path, NOW, SETTINGS, fit_reuse.BACKTEST)
    assert len(keys()) == 12
    fit_reuse.invalidate(spark, path, series_id="a", scope=fit_reuse.BACKTEST)
    assert len(keys()) == 9
    fit_reuse.invalidate(spark, path, horizon="short")
    assert {h for _, _, h in keys()} == {"mid", "long"}
    fit_reuse.invalidate(spark, path)
    assert keys() == set() and fit_reuse.refresh(panel, path, NOW, SETTINGS) == 6
    with pytest.raises(ValueError):
        fit_reuse.refresh(panel, path, NOW, SETTINGS, "other")


def test_a_failed_write_leaves_the_old_version(spark, panel, tmp_path, monkeypatch):
    path = str(tmp_path / "fits")
    fit_reuse.refresh(panel, path, NOW, SETTINGS)

    def fails(*_):
        raise OSError("lost between data and switch")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_publish", fails)
        with pytest.raises(OSError):
            fit_reuse.invalidate(spark, path)
    assert versions.read(spark, path, schemas.MODEL_PARAMS).count() == 6 and versions.current(spark, path) == 1
    fit_reuse.invalidate(spark, path, horizon="mid")
    assert versions.read(spark, path, schemas.MODEL_PARAMS).count() == 4


def test_writers_from_one_version_collide(spark, tmp_path):
    path = str(tmp_path / "numbers")
    versions.commit(spark.range(3), path, 0)
    versions.commit(spark.range(4), path, 1)
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark.range(5), path, 1)
    schema = spark.range(1).schema
    assert versions.read(spark, path, schema).count() == 4
    assert versions.read(spark, path, schema, version=1).count() == 3
    versions.commit(spark.range(6), path, 2, keep=1)
    with pytest.raises(ValueError):
        versions.read(spark, path, schema, version=2)
    assert versions.read(spark, str(tmp_path / "none"), schema).count() == 0
