"""Tables of the engine: create, replace, append, upsert, clear, export."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch import schemas
from pricewatch.functions.numeric import half_even, safe_double
from pricewatch.operators.merge import last_per_key
from pricewatch.sources import tables


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the table was created or written; a broken table is not "absent"."""
    return tables.path_exists(spark, path)


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Creates the tables that do not exist yet, empty, in the layout that the writers use."""
    for name, schema in schemas.TABLES.items():
        path = f"{root}/{name}"
        if not table_exists(spark, path):
            _write_empty(spark, path, schema, schemas.PARTITIONS.get(name, ()))


def _write_empty(spark: SparkSession, path: str, schema, partitions: tuple[str, ...]) -> None:
    writer = spark.createDataFrame([], schema).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(path)


def clear_table(spark: SparkSession, path: str) -> None:
    """Removes all rows and keeps the schema, as a table that was just created."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    schema = schemas.TABLES[name] if name in schemas.TABLES else spark.read.parquet(path).schema
    _write_empty(spark, path, schema, schemas.PARTITIONS.get(name, ()))


def _stored_years(spark: SparkSession, path: str, years: list[int]) -> DataFrame:
    """Rows of these years, read from their partitions alone; an empty table has no partitions yet."""
    return tables.stored(spark, path, schemas.PRICE_TABLE).where(F.col("year").isin(years))


def replace_forecast(forecast: DataFrame, path: str) -> None:
    """Replaces the horizons present in ``forecast``; other horizons stay.

    Accepts any frame with ``yhat``; interval columns are stored when present.
    """
    (
        forecast.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("horizon")
        .parquet(path)
    )


def sanitise_risk(rows: DataFrame, today: date | None = None) -> DataFrame:
    """Risk rows with every missing number replaced and four digits kept."""
    fallback_day = F.lit(today) if today is not None else F.current_date()

    def number(name: str, fallback: float):
        return half_even(safe_double(F.col(name), fallback), 4).alias(name)

    return rows.select(
        "series_id",
        F.coalesce(F.try_to_date(F.col("date").cast("string")), fallback_day).alias("date"),
        "horizon",
        safe_double(F.col("risk_score")).cast("int").alias("risk_score"),
        "risk_level",
        "direction",
        number("fdi_value", 0.0),
        number("vol_ratio", 1.0),
        number("trend_slope", 0.0),
        "risk_message",
    )


def append_risk(
    rows: DataFrame, path: str, created_at: datetime | None = None, today: date | None = None
) -> None:
    """Appends risk rows; history is never changed.

    ``row_no`` orders rows of equal times: it goes on from the largest stored number, so two
    appends never share one.
    """
    spark = rows.sparkSession
    stamp = F.lit(created_at) if created_at is not None else F.current_timestamp()
    last = None
    if table_exists(spark, path):
        last = tables.stored(spark, path, schemas.RISK_STATUS).agg(F.max("row_no")).first()[0]
    (
        sanitise_risk(rows, today)
        .withColumn("created_at", stamp.cast("timestamp"))
        .withColumn("row_no", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
        .write.mode("append")
        .parquet(path)
    )


def risk_history(history: DataFrame, horizon: str, limit: int = 30) -> DataFrame:
    """Newest ``limit`` rows of a horizon; equal times are ordered by row number."""
    return (
        history.filter(F.col("horizon") == horizon)
        .orderBy(F.desc("created_at"), F.desc("row_no"))
        .limit(limit)
    )


def upsert_price_table(batch: DataFrame, path: str, files_per_year: int = 8) -> int:
    """Merges ``batch`` into the price table, which is partitioned by year; returns the rows merged.

    The years of the batch (a few values) become literals, so only their partitions are read and
    rewritten. Rows keep their write order (``batch_no``, ``row_no``), so a replayed batch changes
    nothing. A year is written as at most ``files_per_year`` files.
    """
    spark = batch.sparkSession
    batch = batch.select(
        "series_id", "date", "price",
        F.col("batch_no").cast("int").alias("batch_no"), F.col("row_no").cast("long").alias("row_no"),
        F.year("date").alias("year"),
    ).persist()
    counts = {r["year"]: r["n"] for r in batch.groupBy("year").agg(F.count("*").alias("n")).collect()}
    rows = batch
    if counts and table_exists(spark, path):
        rows = _stored_years(spark, path, sorted(counts)).select(*batch.columns).unionByName(batch)
    part = F.pmod(F.xxhash64("series_id"), F.lit(files_per_year))
    merged = last_per_key(rows, ("batch_no", "row_no")).repartition("year", part)
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )
    batch.unpersist()
    return sum(counts.values())


def export_long_forecast(forecast: DataFrame, path: str, series_id: str | None = None) -> None:
    """CSV of the long forecast in date order.

    For one series: a single file ``date,long_term_forecast`` with one row per
    step of the horizon. For all: files that keep each series together, with a
    leading ``series_id``; their number follows the partitions, not the series.
    """
    rows = forecast.filter(F.col("horizon") == "long").select(
        "series_id",
        F.date_format("forecast_date", "yyyy-MM-dd").alias("date"),
        F.col("yhat").alias("long_term_forecast"),
    )
    if series_id is None:
        rows = rows.repartition("series_id").sortWithinPartitions("series_id", "date")
    else:
        one = rows.filter(F.col("series_id") == series_id).drop("series_id")
        rows = one.repartition(1).sortWithinPartitions("date")
    rows.write.mode("overwrite").option("header", True).csv(path)
