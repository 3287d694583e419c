"""Readers of raw price sheets (delimited text; every cell is text)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch import schemas
from pricewatch.sources.tables import path_exists

ALLOWED_EXTENSIONS = (".csv", ".txt", ".tsv")


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """One uploaded sheet with the columns of its own header, as text.

    Raises for a file type that is not accepted. Malformed rows fail the read.
    """
    if os.path.splitext(path)[1].lower() not in ALLOWED_EXTENSIONS:
        raise ValueError(f"invalid file format, expected one of {', '.join(ALLOWED_EXTENSIONS)}")
    reader = spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST")
    return reader.csv(path)


def widest_line(spark: SparkSession, folder: str) -> int:
    """Most cells of any line of the folder's sheets; a comma inside quotes counts too."""
    commas = F.length("value") - F.length(F.replace("value", F.lit(",")))
    return 1 + (spark.read.text(folder).agg(F.max(commas)).first()[0] or 0)


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All sheets of a folder as raw cells ``c0, c1, ...``, wide enough for every line.

    Headers differ between files, so they are read as rows and resolved later by
    ``operators.clean.import_sheets``. ``line_no`` grows along each file: the parts of a file are
    ordered by their start, and a part is read in order by one task.
    """
    start = F.col("_metadata.file_block_start")
    return (
        spark.read.schema(schemas.raw_sheet(widest_line(spark, folder)))
        .option("header", False)
        .csv(folder)
        .withColumns(
            {
                "file_path": F.col("_metadata.file_path"),
                "line_no": F.struct(start.alias("start"), F.monotonically_increasing_id().alias("at")),
            }
        )
    )


def width_of(cells: DataFrame) -> int:
    return sum(name[0] == "c" and name[1:].isdigit() for name in cells.columns)


def read_yearly(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """The sheets that exist, each with the columns of its own header; missing ones are skipped."""
    return [
        spark.read.option("header", True).option("inferSchema", False).csv(path)
        for path in paths if path_exists(spark, path)
    ]
