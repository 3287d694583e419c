"""Incremental upload: sheets that arrive in a folder are merged into the price table.

Every sheet is read by its own header, whatever the order and number of its columns. A sheet that lacks
a column, or has an unparsable date on a row that is kept, is refused as a whole and goes to the table of
refused sheets with its reason; nothing vanishes. A batch can go on to refresh the results of the series
it touched.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricewatch import schemas
from pricewatch.config import DEFAULT, Settings
from pricewatch.functions.cleaning import (
    DATE_HEADERS,
    PRICE_HEADERS,
    normal_header,
    parse_day_first,
    parse_price,
)
from pricewatch.operators import sinks
from pricewatch.operators.sinks import upsert_price_table
from pricewatch.plans import fit_reuse, forecasting, risk
from pricewatch.sources import tables

#: Columns of a sheet and the headers that name them.
COLUMNS = {
    "series_id": ("series_id",),
    "batch_no": ("batch_no",),
    "row_no": ("row_no",),
    "tanggal": DATE_HEADERS,
    "harga": PRICE_HEADERS,
}
#: Cells of a line that are read; a header beyond them is not found and its sheet refused.
WIDTH = 20
ROW = ("series_id", "date", "price", "batch_no", "row_no")
Refresh = Callable[[DataFrame, int], None]


def _cell(row: Column, column: str) -> Column:
    return F.get(row, F.col(f"_at.{column}")).alias(column)


def typed_rows(cells: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of raw cells ``c0 ..`` by the header of their own file, with ``date``, ``price`` and ``reason``.

    ``reason`` tells why a row refuses its sheet: a column that the header lacks (such a sheet is its
    header row alone), or a date that does not parse. Rows without a date cell or a positive price are left out.
    """
    row = F.array(*[F.col(f"c{i}") for i in range(width)])
    placed = cells.select("file_path", "line_no", row.alias("_row"))
    first = placed.groupBy("file_path").agg(
        F.min("line_no").alias("_first"), F.min_by("_row", "line_no").alias("_header")
    )

    def last_match(names: tuple[str, ...]) -> Column:
        return F.array_max(F.transform("_header", lambda c, i: F.when(normal_header(c).isin(*names), i)))

    opened = first.select(
        "file_path", "_first", F.struct(*[last_match(names).alias(c) for c, names in COLUMNS.items()]).alias("_at")
    )
    lacks = F.concat_ws(", ", *[F.when(F.col(f"_at.{c}").isNull(), F.lit(c)) for c in COLUMNS])
    rows = placed.join(opened.withColumn("_lacks", lacks), "file_path").select(
        "file_path", (F.col("line_no") == F.col("_first")).alias("_opens"), "_lacks", *[_cell(F.col("_row"), c) for c in COLUMNS]
    )
    rows = rows.withColumns({"date": parse_day_first(F.col("tanggal")), "price": parse_price(F.col("harga"))})
    usable = (F.col("_lacks") == "") & ~F.col("_opens") & F.col("tanggal").isNotNull() & (F.col("price") > 0)
    headless = (F.col("_lacks") != "") & F.col("_opens")
    reason = F.when(headless, F.concat(F.lit("no column "), "_lacks")).when(
        F.col("date").isNull(), "a date does not parse"
    )
    return rows.filter(usable | headless).withColumn("reason", reason).withColumns(
        {"batch_no": F.expr("try_cast(batch_no as int)"), "row_no": F.expr("try_cast(row_no as bigint)")}
    ).drop("_opens", "_lacks")


def merge_into(path: str, rejected: str, refresh: Refresh | None = None) -> Callable[[DataFrame, int], None]:
    """Merges the sheets of a batch; refused sheets go to ``rejected``, the others go on.

    ``refresh`` is called with the series that the batch brought prices for and the batch's number.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        line = F.struct(F.col("block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        rows = typed_rows(batch.withColumn("line_no", line)).persist()
        bad = rows.where("reason is not null").groupBy("file_path").agg(F.min("reason").alias("reason"))
        good = rows.join(bad, "file_path", "left_anti")
        upsert_price_table(good.select(*ROW), path)
        aside = rows.drop("date", "price", "reason").join(bad, "file_path").withColumn("batch_id", F.lit(batch_id))
        aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(rejected)
        if refresh is not None:
            refresh(good.select("series_id").distinct(), batch_id)
        rows.unpersist()

    return merge


def refresh_results(
    table: str, root: str, now: Callable[[], datetime], settings: Settings = DEFAULT
) -> Refresh:
    """Refits, forecasts and scores the series of a batch: tables ``fits``, ``forecast`` and ``risk_status`` under ``root``.

    Only these series' prices are read, and only fits whose input changed are made again. Risk rows of a
    batch are one partition that a replay overwrites, so each batch counts once.
    """

    def refresh(series: DataFrame, batch_id: int) -> None:
        spark = series.sparkSession
        obs = tables.prices(spark, table).join(series, "series_id", "left_semi")
        stamp = now()
        fit_reuse.refresh(obs, f"{root}/fits", stamp, settings)
        sinks.replace_forecast(fit_reuse.forecast_from_stored_fits(spark, f"{root}/fits", settings), f"{root}/forecast")
        rows = sinks.sanitise_risk(risk.assess(obs, settings), stamp.date())
        rows.withColumns({"created_at": F.lit(stamp).cast("timestamp"), "batch_id": F.lit(batch_id)}).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/risk_status")

    return refresh


def stream_upserts(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    rejected_path: str | None = None,
    refresh: Refresh | None = None,
) -> StreamingQuery:
    """Merges all sheets present in ``folder`` and stops; refused sheets go to ``rejected_path``
    (by default beside the table).

    Rows carry their own write order, so a batch that is replayed after a lost
    driver or executor leaves the table as it was.
    """
    cells = (
        spark.readStream.schema(schemas.raw_sheet(WIDTH))
        .option("header", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
        .withColumns(
            {"file_path": F.col("_metadata.file_path"), "block_start": F.col("_metadata.file_block_start")}
        )
    )
    rejected = rejected_path or f"{table_path.rstrip('/')}-rejected"
    return (
        cells.writeStream.foreachBatch(merge_into(table_path, rejected, refresh))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
