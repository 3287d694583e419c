"""Registered queries, second part: ingest, evaluation, risk, reports, tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch import schemas
from pricewatch.catalog.fixture import SETTINGS
from pricewatch.functions import numeric, scoring
from pricewatch.functions.cleaning import parse_day_first
from pricewatch.operators import (
    calendar,
    clean,
    fit_store,
    merge,
    moment_blocks,
    sarima,
    seasonal_map,
    sinks,
    versions,
)
from pricewatch.operators.regularise import segments
from pricewatch.plans import evaluation, fit_reuse, forecasting, report, risk
from pricewatch.session import new_table_path
from pricewatch.sources import panels, sheets
from pricewatch.streaming import ingest

NOW = datetime(2002, 1, 1)


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- ingest -----------------------------------------------------------------


def clean_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = panels.raw_upload(spark, sf_dir).withColumnsRenamed(
        {"tanggal": " Tanggal", "harga": "HARGA "}
    )
    return clean.clean_upload(raw)


def _sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly sheets as raw cells with a header row each.

    1998 names its columns differently and swaps them, 1999 has no price column,
    1997 keeps its 'n/a' prices; the others have those cells empty.
    """
    raw = panels.raw_upload(spark, sf_dir)
    swapped = F.col("file_no") == 1998
    price = F.when(
        (F.col("harga") == "n/a") & (F.col("file_no") != 1997), F.lit(None).cast("string")
    ).otherwise(F.col("harga"))
    body = raw.select(
        "file_no",
        "row_no",
        F.when(swapped, price).otherwise(F.col("tanggal")).alias("c0"),
        F.when(swapped, F.col("tanggal")).otherwise(price).alias("c1"),
    )
    header = (
        raw.select("file_no")
        .distinct()
        .select(
            "file_no",
            F.lit(-1).cast("bigint").alias("row_no"),
            F.when(swapped, "Price (Rp)").otherwise("Tanggal").alias("c0"),
            F.when(swapped, "Date")
            .when(F.col("file_no") == 1999, "Catatan")
            .otherwise("Harga")
            .alias("c1"),
        )
    )
    return header.unionByName(body)


def import_files_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.import_sheets(_sheet_cells(spark, sf_dir), 2, "file_no", "row_no")


def upload_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet file with its columns in another order and some more, read by its own header."""
    raw = panels.raw_upload(spark, sf_dir)
    path = new_table_path(spark, "upload") + ".csv"
    raw.select(
        F.col("harga").alias(" HARGA"), F.lit('said "so", twice').alias("catatan"), "row_no",
        F.col("tanggal").alias("Tanggal "), "file_no",
    ).write.option("header", True).csv(path)
    rows = clean.clean_upload(sheets.read_upload(spark, path))
    return rows.select(F.col("file_no").cast("int").alias("file_no"), F.col("row_no").cast("bigint").alias("row_no"), "date", "price")


def import_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly sheets as files, each with its own header line, read back as a folder."""
    folder = new_table_path(spark, "folder")
    cells = _sheet_cells(spark, sf_dir)
    cells.repartition("file_no").sortWithinPartitions("file_no", "row_no").select("file_no", "c0", "c1").write.partitionBy(
        "file_no"
    ).csv(folder)
    found = sheets.read_cells(spark, folder).drop("file_no")
    rows = clean.import_sheets(found, sheets.width_of(found))
    year = F.regexp_extract("file_path", r"file_no=(\d+)", 1).cast("int").alias("file_no")
    return rows.select(year, "date", "price")


def yearly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files of two spellings, one of which is missing, read and reduced to one price a day."""
    paths = []
    for frame in _yearly_frames(spark, sf_dir):
        paths.append(new_table_path(spark, "yearly") + ".csv")
        frame.write.option("header", True).csv(paths[-1])
    frames = [
        frame.withColumns(
            {"date": F.col("date").cast("date"), "file_no": F.col("file_no").cast("int"), "row_no": F.col("row_no").cast("bigint")}
        )
        for frame in sheets.read_yearly(spark, [*paths, new_table_path(spark, "missing") + ".csv"])
    ]
    return clean.load_yearly(frames, ("file_no", "row_no"))


def _yearly_frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    raw = panels.raw_upload(spark, sf_dir).select(
        F.lit("all").alias("series_id"),
        "file_no",
        "row_no",
        parse_day_first(F.col("tanggal")).alias("date"),
        "harga",
    )
    old = raw.filter(F.col("file_no") != 1998).withColumnRenamed("harga", "Price (Rp)")
    new = raw.filter(F.col("file_no") == 1998).withColumnRenamed("harga", "Price(Rp)")
    return [old, new]


def concat_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.unify_yearly_price(clean.concat_sheets(_yearly_frames(spark, sf_dir)))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.load_yearly(_yearly_frames(spark, sf_dir), ("file_no", "row_no"))


def _stored_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored prices, and a batch that corrects every first of a month and adds 30 days."""
    obs = panels.price_obs(spark, sf_dir)
    row_no = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint")
    stored = obs.select("series_id", "date", "price", F.lit(0).alias("batch_no"), row_no.alias("row_no"))
    fixes = obs.filter(F.dayofmonth("date") == 1).select(
        "series_id", "date", (F.col("price") * 2).alias("price")
    )
    last = obs.groupBy("series_id").agg(
        F.max("date").alias("last_date"), F.max_by("price", "date").alias("price")
    )
    new_days = last.select(
        "series_id",
        F.explode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", 30))).alias("date"),
        "price",
    )
    twice = fixes.unionByName(new_days).select(
        "series_id",
        "date",
        F.explode(
            F.array(
                F.struct(F.col("price").alias("price"), F.lit(1).alias("batch_no")),
                F.struct((F.col("price") + 1).alias("price"), F.lit(2).alias("batch_no")),
            )
        ).alias("_w"),
    )
    return stored, twice.select("series_id", "date", "_w.*", row_no.alias("row_no"))


def upsert_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _stored_and_batch(spark, sf_dir)
    return merge.upsert(stored, batch).select("series_id", "date", "price", "batch_no")


def upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge through the stored table, batch after batch, read back."""
    stored, batch = _stored_and_batch(spark, sf_dir)
    path = new_table_path(spark, "prices")
    sinks.upsert_price_table(stored, path)
    sinks.upsert_price_table(batch, path)
    return spark.read.parquet(path).select("series_id", "date", "price", "batch_no")


def append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year files, then December files that repeat days of the year files.

    1995 meets stored days and 1997 repeats a day, so their December files are
    the ones that get in.
    """
    obs = panels.price_obs(spark, sf_dir).withColumn("file_no", F.year("date"))
    again = obs.filter(F.col("date") == F.lit("1997-03-03").cast("date"))
    december = obs.filter(F.month("date") == 12).withColumn(
        "file_no", F.col("file_no") + 10000
    )
    stored = obs.filter(F.date_format("date", "yyyy-MM") == "1995-06")
    return merge.append_unique(
        obs.unionByName(again).unionByName(december), stored
    ).select("file_no", "series_id", "date", "price")


def safe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = panels.price_obs_null(spark, sf_dir)
    price = F.col("price")
    share = F.when(price == 0, F.lit(float("nan"))).otherwise(price / 700)
    return obs.select(
        "series_id",
        F.date_format("date", "yyyy-MM-dd").alias("day_text"),
        F.date_format("date", "yyyyMMdd").alias("day_key"),
        numeric.half_even(numeric.safe_double(share, -1.0), 2).alias("share"),
        numeric.half_even(numeric.safe_double(price) / 2000 + 0.0).alias("half"),
        F.round(numeric.clip_negative(price - 200000), 2).alias("clipped"),
        F.round(F.ln(numeric.zero_to_null(price)), 8).alias("ln_price"),
        F.round(F.log1p(price), 8).alias("ln1_price"),
    )


def train_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.training_rows(
        panels.price_obs(spark, sf_dir), SETTINGS.eval_windows, SETTINGS
    )
    return rows.groupBy("series_id", "horizon", "train_end").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("anchor_date"),
    )


def chart_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chart_prices(panels.price_obs(spark, sf_dir), SETTINGS.chart_range)


def future_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every operational step, with the distance from the last price of the series."""
    last = panels.price_obs_supplier(spark, sf_dir).groupBy("series_id").agg(
        F.max("date").alias("last_date")
    )
    rows = calendar.with_steps(calendar.with_horizons(last, SETTINGS.horizons, SETTINGS))
    day = calendar.label(F.col("step"))
    return rows.select(
        "series_id",
        "horizon",
        "step",
        day.alias("forecast_date"),
        F.datediff(day, "last_date").alias("days_after_last"),
    )


# --- evaluation -------------------------------------------------------------


def _rounded_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({"rmse": F.round("rmse", 3), "mape": F.round("mape", 6)})


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(evaluation.backtest_metrics(panels.price_obs_supplier(spark, sf_dir), SETTINGS))


def backtest_metrics_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(
        evaluation.compare_models(panels.price_obs_market(spark, sf_dir), SETTINGS)
    )


def model_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = evaluation.compare_models(panels.price_obs_null(spark, sf_dir), SETTINGS)
    return evaluation.winner(results, "arima", "seasonal").select(
        "series_id",
        "horizon",
        F.round("mape_arima", 6).alias("mape_arima"),
        F.round("mape_seasonal", 6).alias("mape_seasonal"),
        "winner",
    )


def model_winner_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = evaluation.compare_models(
        panels.price_obs_brand(spark, sf_dir), SETTINGS, align="date"
    )
    return evaluation.winner(results, "arima", "seasonal").select("series_id", "horizon", "winner")


def log_variant_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = evaluation.compare_log_variants(panels.price_obs_brand(spark, sf_dir), SETTINGS)
    return evaluation.winner(results, "no_log", "log").select(
        "series_id",
        "horizon",
        F.round("mape_no_log", 6).alias("mape_no_log"),
        F.round("mape_log", 6).alias("mape_log"),
        "winner",
    )


def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = evaluation.compare_models(panels.price_obs(spark, sf_dir), SETTINGS)
    return _rounded_metrics(evaluation.recommendation(results, "arima", "seasonal"))


# --- risk -------------------------------------------------------------------


def _assess(obs: DataFrame) -> DataFrame:
    return risk.assess(obs, SETTINGS)


def _rounded_risk(rows: DataFrame) -> DataFrame:
    return _round(rows, 6, "fdi_value", "vol_ratio", "trend_slope")


def fdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assess(panels.price_obs_edge(spark, sf_dir))
    return _round(rows, 6, "fdi_value").select("series_id", "horizon", "fdi_value")


def seasonal_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assess(panels.price_obs(spark, sf_dir))
    return _round(rows, 6, "seasonal_deviation").select(
        "series_id", "horizon", "seasonal_deviation"
    )


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assess(panels.price_obs_edge(spark, sf_dir)).select(
        "series_id", "horizon", "risk_score", "breakdown.fdi_score", "breakdown.vol_score",
        "breakdown.trend_score", "breakdown.seasonal_score",
    )


def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assess(panels.price_obs_edge(spark, sf_dir)).select(
        "series_id", "horizon", "risk_score", "risk_level"
    )


def risk_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assess(panels.price_obs_edge(spark, sf_dir)).select(
        "series_id", "horizon", "direction", "risk_message"
    )


def risk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series cut to their last row: no spread, so no score."""
    obs = panels.price_obs_brand(spark, sf_dir)
    last = obs.groupBy("series_id").agg(
        F.max("date").alias("date"), F.max_by("price", "date").alias("price")
    )
    return _assess(last).drop("breakdown", "seasonal_deviation")


def risk_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assess(panels.price_obs_supplier(spark, sf_dir))
    return _rounded_risk(rows).drop("breakdown", "seasonal_deviation")


def risk_history_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as stored risk rows."""
    events = panels.table(spark, sf_dir, "events")
    score = F.least(F.floor(F.col("value")), F.lit(100)).cast("int")
    horizon = F.get(
        F.array(F.lit("short"), F.lit("mid"), F.lit("long")), (F.col("user_id") % 3).cast("int")
    )
    return events.select(
        F.col("event_type").alias("series_id"),
        F.to_date("ts").alias("date"),
        horizon.alias("horizon"),
        score.alias("risk_score"),
        scoring.level(score).alias("risk_level"),
        F.lit("stable").alias("direction"),
        (F.col("value") / 7).alias("fdi_value"),
        F.when(F.col("value") > 1, F.col("value") / 3).alias("vol_ratio"),
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .otherwise(F.col("value") - 5)
        .alias("trend_slope"),
        F.lit("-").alias("risk_message"),
        F.date_trunc("hour", "ts").cast("timestamp").alias("created_at"),
        F.col("event_id").alias("row_no"),
    )


def risk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk rows sanitised, appended in two steps and read back."""
    rows = risk_history_seed(spark, sf_dir)
    path = new_table_path(spark, "risk-status")
    sinks.append_risk(rows.filter(F.col("horizon") == "short"), path, NOW)
    sinks.append_risk(rows.filter(F.col("horizon") != "short"), path, NOW)
    stored = spark.read.parquet(path)
    return stored.groupBy("series_id", "date", "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("risk_score").alias("score_sum"),
        F.max("fdi_value").alias("fdi_max"),
        F.min("vol_ratio").alias("vol_min"),
        F.max("trend_slope").alias("slope_max"),
    )


def risk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.risk_history(risk_history_seed(spark, sf_dir), "short", 30)
    return rows.select("series_id", "date", "risk_score", "risk_level", "row_no")


def risk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.latest_risk(risk_history_seed(spark, sf_dir))
    return rows.select("series_id", "horizon", "date", "risk_score", "risk_level", "row_no")


# --- tables and reports -----------------------------------------------------


def forecast_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all horizons, replaces the mid horizon, reads back."""
    forecast = forecasting.forecast_operational(panels.price_obs(spark, sf_dir), SETTINGS)
    path = new_table_path(spark, "forecasts")
    sinks.replace_forecast(forecast, path)
    raised = forecast.filter(F.col("horizon") == "mid").withColumn("yhat", F.col("yhat") * 2)
    sinks.replace_forecast(raised, path)
    return spark.read.parquet(path).select(
        "series_id", "horizon", "forecast_date", F.round("yhat", 2).alias("yhat")
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = forecasting.place(panels.price_obs(spark, sf_dir))
    lines = report.timeline(
        report.placed_chart_prices(obs, SETTINGS.chart_range),
        forecasting.forecast_backtest(obs, SETTINGS),
        forecasting.forecast_operational(obs, SETTINGS),
    )
    return _round(lines, 2, *report.LINES)


def forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = forecasting.place(panels.price_obs(spark, sf_dir))
    return report.backtest_summary(obs, SETTINGS)


def dashboard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures read from the nested payload of every series."""
    rows = report.payload(panels.price_obs(spark, sf_dir), SETTINGS)

    def total(part: str, field: str, digits: int) -> Column:
        values = F.transform(part, lambda r: F.coalesce(F.round(r[field], digits), F.lit(0.0)))
        return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 1)

    def of(part: str, horizon: str, field: str) -> Column:
        return F.get(F.filter(part, lambda r: r["horizon"] == horizon), F.lit(0))[field]

    return rows.select(
        "series_id",
        F.size("timeline").alias("n_days"),
        *[total("timeline", line, 2).alias(line) for line in ("actual", "mid_eval", "long_prod", "long_lower")],
        F.size("volatility").alias("n_volatility"),
        total("volatility", "volatility", 4).alias("volatility"),
        F.size("forecast").alias("n_forecast"),
        of("summary", "mid", "mape").alias("mape_mid"),
        of("summary", "long", "avg_forecast").alias("avg_long"),
        of("cards", "short", "risk_score").alias("risk_short"),
        of("cards", "long", "risk_message").alias("message_long"),
    )


def risk_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.risk_cards(_assess(panels.price_obs(spark, sf_dir)))


def _required(obs: DataFrame) -> DataFrame:
    return fit_store.required_fits(
        obs, SETTINGS.horizons, SETTINGS, "op", ("arima", "seasonal")
    )


def _before_correction(obs: DataFrame) -> DataFrame:
    """The panel as it was before the prices of 1999-12-31 were corrected."""
    corrected = F.col("date") == F.lit("1999-12-31").cast("date")
    return obs.withColumn("price", F.when(corrected, F.col("price") + 1).otherwise(F.col("price")))


def _stored_fits(obs: DataFrame) -> DataFrame:
    """Fits of the panel before its correction.

    The age of a fit in hours is the day of the month of its anchor date.
    """
    before = _before_correction(obs)
    age = F.make_dt_interval(hours=F.dayofmonth("anchor_date"))
    return _required(before).withColumn("fitted_at", F.lit(NOW).cast("timestamp") - age)


def refit_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = panels.price_obs_supplier(spark, sf_dir)
    return fit_store.refit_needed(
        _required(obs), _stored_fits(obs), NOW, SETTINGS.fit_ttl_hours
    ).drop("input_digest")


def fit_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_fits(panels.price_obs_supplier(spark, sf_dir))
    return fit_store.invalidate(stored, horizon="short", model="arima").drop(
        "input_digest", "fitted_at"
    )


def forecast_from_stored_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast from a fit table that had corrected, aged, deleted and usable rows.

    The fits of the mid horizon were deleted; the others are as old, in hours, as the day of the month of
    their last training row, so some are beyond the age limit.
    """
    obs = panels.price_obs_edge(spark, sf_dir)
    path = new_table_path(spark, "fits")
    age = F.make_dt_interval(hours=F.dayofmonth("anchor_date"))
    fit_reuse.refresh(
        _before_correction(obs), path, NOW, SETTINGS, fitted_at=F.lit(NOW).cast("timestamp") - age
    )
    fit_reuse.invalidate(spark, path, horizon="mid")
    fit_reuse.refresh(obs, path, NOW, SETTINGS)
    forecast = fit_reuse.forecast_from_stored_fits(spark, path, SETTINGS)
    return _round(forecast, 2, "yhat", "yhat_lower", "yhat_upper")


def forecast_from_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest from moment blocks that were stored in three loads; the first had wrong prices in March."""
    obs = panels.price_obs_market(spark, sf_dir)
    path = new_table_path(spark, "blocks")
    march = F.month("date") == 3
    wrong = obs.withColumn("price", F.when(march, F.col("price") + 1).otherwise(F.col("price")))
    new_years = F.year("date") >= 2000
    moment_blocks.store(moment_blocks.build(wrong.filter(~new_years), forecasting.filling(SETTINGS)), path)
    moment_blocks.store(moment_blocks.build(obs.filter(new_years), forecasting.filling(SETTINGS)), path)
    moment_blocks.store(moment_blocks.build(obs.filter(~new_years & march), forecasting.filling(SETTINGS)), path)
    forecast = forecasting.forecast_backtest_from_blocks(moment_blocks.read(spark, path), SETTINGS)
    return _round(forecast, 2, "yhat", "yhat_lower", "yhat_upper")


def fit_table_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fit table holds after deletions by horizon and by key, read back."""
    obs = panels.price_obs_supplier(spark, sf_dir)
    path = new_table_path(spark, "fits")
    fit_reuse.refresh(obs, path, NOW, SETTINGS, fit_reuse.BACKTEST)
    fit_reuse.refresh(obs, path, NOW, SETTINGS)
    fit_reuse.invalidate(spark, path, horizon="short", scope=fit_reuse.BACKTEST)
    fit_reuse.invalidate(spark, path, horizon="long", anchor_date=datetime(2001, 7, 31).date())
    held = versions.read(spark, path, schemas.MODEL_PARAMS)
    return held.select(
        "series_id", "scope", "model", "horizon", "anchor_date", F.size("params").alias("n_params")
    )


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long forecast as CSV, read back."""
    forecast = forecasting.forecast_operational(panels.price_obs(spark, sf_dir), SETTINGS)
    path = new_table_path(spark, "export")
    sinks.export_long_forecast(forecast, path)
    return (
        spark.read.schema("series_id string, date string, long_term_forecast double")
        .option("header", True)
        .csv(path)
        .select("series_id", "date", F.round("long_term_forecast", 2).alias("long_term_forecast"))
    )


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets written to one folder, streamed into the price table, read back."""
    raw = panels.raw_upload(spark, sf_dir).select(
        F.lit("all").alias("series_id"),
        F.col("file_no").cast("int").alias("batch_no"),
        "row_no",
        "tanggal",
        "harga",
    )
    folder = new_table_path(spark, "sheets")
    raw.write.option("header", True).csv(folder)
    table = new_table_path(spark, "stream-prices")
    query = ingest.stream_upserts(spark, folder, table, new_table_path(spark, "stream-state"))
    query.awaitTermination()
    return spark.read.parquet(table).select("series_id", "date", "price", "batch_no", "row_no")




# --- larger models ----------------------------------------------------------


def sarima_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order search and 90-day path of every brand."""
    segs = segments(panels.price_obs_brand(spark, sf_dir))
    fits = sarima.fit_sarima(sarima.daily_logs(segs), F.lit(90))
    path = F.posexplode("path").alias("pos", "yhat")
    return fits.select(
        "series_id", "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "last_date", path
    ).select(
        "series_id", "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q",
        F.date_add("last_date", F.col("pos") + 1).alias("forecast_date"),
        F.round("yhat", 2).alias("yhat"),
    )


def seasonal_map_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90-day path and interval of every brand from the changepoint model."""
    rows = forecasting.prepare(panels.price_obs_brand(spark, sf_dir), SETTINGS)
    paths = seasonal_map.fit_seasonal_map(rows.withColumn("steps", F.lit(90)))
    zipped = F.arrays_zip("yhat", "yhat_lower", "yhat_upper")
    return paths.select("series_id", "last_date", F.posexplode(zipped).alias("pos", "v")).select(
        "series_id",
        F.date_add("last_date", F.col("pos") + 1).alias("forecast_date"),
        *[F.round(F.col("v")[name], 2).alias(name) for name in ("yhat", "yhat_lower", "yhat_upper")],
    )


def forecast_operational_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasting.forecast_operational_searched(panels.price_obs(spark, sf_dir), SETTINGS)


def backtest_searched_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(evaluation.backtest_searched_metrics(panels.price_obs(spark, sf_dir), SETTINGS))
