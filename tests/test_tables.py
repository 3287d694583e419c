"""Sinks, stored tables, fit reuse and the streaming upload."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pricewatch import config, schemas
from pricewatch.operators import fit_store, sinks
from pricewatch.plans import report
from pricewatch.sources import tables
from pricewatch.streaming import ingest

DAY = dt.date(2022, 1, 1)
FORECAST = "series_id string, horizon string, forecast_date date, yhat double"


def test_tables_are_created_once_and_cleared(spark, tmp_path):
    root = str(tmp_path)
    sinks.ensure_tables(spark, root)
    path = f"{root}/price_obs"
    kind = "series_id string, date date, price double, batch_no int, row_no bigint"
    assert tables.prices(spark, path).count() == 0
    assert sinks.upsert_price_table(spark.createDataFrame([("s", DAY, 1.0, 1, 1)], kind), path) == 1
    sinks.ensure_tables(spark, root)
    assert tables.prices(spark, path).count() == 1
    sinks.clear_table(spark, path)
    assert tables.prices(spark, path).count() == 0
    assert tables.prices(spark, f"{root}/none").count() == 0
    sinks.upsert_price_table(spark.createDataFrame([("s", DAY, 2.0, 1, 1)], kind), path)
    assert [r["price"] for r in tables.prices(spark, path).collect()] == [2.0]
    spark.createDataFrame([("s", DAY, 2.0)], "series_id string, date date, cost double").write.parquet(f"{root}/odd")
    with pytest.raises(AnalysisException):
        tables.prices(spark, f"{root}/odd")


def test_replacing_one_horizon_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "f")
    first = spark.createDataFrame([("s", "short", DAY, 1.0), ("s", "mid", DAY, 2.0)], FORECAST)
    sinks.replace_forecast(first, path)
    sinks.replace_forecast(spark.createDataFrame([("s", "mid", DAY, 3.0)], FORECAST), path)
    got = {r["horizon"]: r["yhat"] for r in tables.forecasts(spark, path).collect()}
    assert got == {"short": 1.0, "mid": 3.0}


def test_risk_rows_are_sanitised_and_appended(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame(
        [("s", "x", "short", None, "Normal", "up", float("nan"), None, 1.23456789, "m")],
        "series_id string, date string, horizon string, risk_score double, risk_level string,"
        " direction string, fdi_value double, vol_ratio double, trend_slope double, risk_message string",
    )
    for i in range(2):
        sinks.append_risk(rows, path, dt.datetime(2022, 1, 1 + i), DAY)
    stored = tables.risk_history(spark, path)
    assert stored.count() == 2 and stored.select("row_no").distinct().count() == 2
    newest = sinks.risk_history(stored, "short", 1).collect()[0]
    assert newest["created_at"] == dt.datetime(2022, 1, 2) and newest["date"] == DAY
    assert (newest["risk_score"], newest["fdi_value"], newest["vol_ratio"]) == (0, 0.0, 1.0)
    assert newest["trend_slope"] == 1.2346
    assert report.latest_risk(stored).collect()[0]["created_at"] == dt.datetime(2022, 1, 2)


def test_upsert_rewrites_only_the_years_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "p")
    kind = "series_id string, date date, price double, batch_no int, row_no bigint"
    sinks.upsert_price_table(
        spark.createDataFrame([("s", dt.date(2021, 1, 1), 1.0, 1, 1), ("s", DAY, 1.0, 1, 2)], kind), path
    )
    kept = sorted(p.name for p in (tmp_path / "p" / "year=2021").glob("*.parquet"))
    sinks.upsert_price_table(spark.createDataFrame([("s", DAY, 5.0, 2, 1)], kind), path)
    assert kept == sorted(p.name for p in (tmp_path / "p" / "year=2021").glob("*.parquet"))
    got = {r["date"].year: r["price"] for r in spark.read.parquet(path).collect()}
    assert got == {2021: 1.0, 2022: 5.0}


def test_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(
        [("s", "long", DAY + dt.timedelta(days=i), float(i)) for i in (2, 0, 1)] + [("s", "mid", DAY, 9.0)],
        FORECAST,
    )
    sinks.export_long_forecast(df, path, series_id="s")
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_text().split() == [
        "date,long_term_forecast", "2022-01-01,0.0", "2022-01-02,1.0", "2022-01-03,2.0"]
    sinks.export_long_forecast(df, path)
    (file,) = [p for p in (tmp_path / "csv").glob("*.csv") if len(p.read_text().split()) > 1]
    assert file.read_text().split() == [
        "series_id,date,long_term_forecast", "s,2022-01-01,0.0", "s,2022-01-02,1.0", "s,2022-01-03,2.0"]


SETTINGS = config.Settings(horizons=(config.Horizon("short", 5, dt.date(2022, 1, 31)),))
NOW = dt.datetime(2022, 2, 1)


def test_fits_are_reused_until_they_age_or_the_input_changes(spark, price_frame):
    obs = price_frame([1.0, 2.0, 3.0], "2022-01-01")
    needed = fit_store.required_fits(obs, SETTINGS.horizons, SETTINGS, "op", ["arima"])

    def stored(frame, hours):
        return fit_store.required_fits(
            frame, SETTINGS.horizons, SETTINGS, "op", ["arima"]
        ).withColumn("fitted_at", F.lit(NOW - dt.timedelta(hours=hours)))

    def refits(frame, hours):
        return fit_store.refit_needed(needed, stored(frame, hours), NOW, 24).count()

    assert refits(obs, 23) == 0
    assert refits(obs, 24) == 1
    corrected = price_frame([1.0, 2.5, 3.0], "2022-01-01")
    assert refits(corrected, 1) == 1


def test_invalidation(spark, price_frame):
    fits = fit_store.required_fits(
        price_frame([1.0, 2.0], "2022-01-01"), SETTINGS.horizons, SETTINGS, "op", ["arima", "seasonal"]
    )
    assert fit_store.invalidate(fits, model="arima").count() == 1
    assert fit_store.invalidate(fits, horizon="mid").count() == 2
    assert fit_store.invalidate(fits).count() == 0


def test_streamed_uploads_merge_and_replay(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "t")
    folder.mkdir()
    head = "series_id,batch_no,row_no,tanggal,harga\n"
    (folder / "1.csv").write_text(head + "s,1,1,01/01/2022,1.000\ns,1,2,02/01/2022,x\n")
    ingest.stream_upserts(spark, str(folder), table, str(tmp_path / "c")).awaitTermination()
    (folder / "2.csv").write_text(head + "s,2,1,2022-01-01,2.000\n")
    ingest.stream_upserts(spark, str(folder), table, str(tmp_path / "c")).awaitTermination()
    # A fresh checkpoint replays everything.
    ingest.stream_upserts(spark, str(folder), table, str(tmp_path / "c2")).awaitTermination()
    (folder / "3.csv").write_text(head + "s,3,1,02/01/2022,3.000\ns,3,2,99/99/2022,4.000\n")
    aside = str(tmp_path / "aside")
    ingest.stream_upserts(spark, str(folder), table, str(tmp_path / "c"), rejected_path=aside).awaitTermination()
    got = [(r["date"], r["price"]) for r in spark.read.parquet(table).collect()]
    assert got == [(DAY, 2000.0)]
    assert sorted(r["harga"] for r in spark.read.parquet(aside).collect()) == ["3.000", "4.000"]


def test_shared_folder_is_required_on_a_cluster(spark):
    from pricewatch import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
