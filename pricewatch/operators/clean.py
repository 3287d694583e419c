"""From raw price sheets to typed price rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewatch.functions.cleaning import (
    DATE_HEADERS,
    PRICE_HEADERS,
    normal_header,
    parse_day_first,
    parse_price,
)
from pricewatch.functions.numeric import nan_to_null, to_double
from pricewatch.operators.merge import first_per_key

YEARLY_PRICE_HEADERS = ("Price (Rp)", "Price(Rp)")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed column names."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def resolve_headers(df: DataFrame) -> DataFrame:
    """Renames the date and price synonyms; the last matching column wins.

    Raises when either is missing.
    """
    df = normalise_headers(df)
    found = {
        "date": [c for c in df.columns if c in DATE_HEADERS],
        "price": [c for c in df.columns if c in PRICE_HEADERS],
    }
    missing = [name for name, columns in found.items() if not columns]
    if missing:
        raise ValueError(f"required columns not found: {', '.join(missing)}")
    keep = [c for c in df.columns if c not in DATE_HEADERS + PRICE_HEADERS]
    return df.select(*keep, *[F.col(f"`{c[-1]}`").alias(name) for name, c in found.items()])


def _price(df: DataFrame) -> Column:
    """Separators are stripped from text only; numeric columns are cast as they are."""
    if isinstance(df.schema["price"].dataType, T.StringType):
        return parse_price(F.col("price"))
    return nan_to_null(F.col("price").cast("double"))


def _day(df: DataFrame) -> Column:
    if isinstance(df.schema["date"].dataType, T.StringType):
        return parse_day_first(F.col("date"))
    return F.to_date("date")


def clean_upload(df: DataFrame) -> DataFrame:
    """Uploaded sheet -> typed rows with positive prices.

    Unparsable prices are dropped. An unparsable date on a row that is kept
    fails the whole upload.
    """
    rows = resolve_headers(df)
    typed = rows.withColumns({"_day": _day(rows), "_price": _price(rows)}).filter(
        F.col("date").isNotNull() & (F.col("_price") > 0)
    )
    bad = F.raise_error(F.concat(F.lit("unparsable date "), F.col("date").cast("string")))
    keep = [c for c in rows.columns if c not in ("date", "price")]
    return typed.select(
        *keep,
        F.when(F.col("_day").isNull(), bad.cast("date")).otherwise(F.col("_day")).alias("date"),
        F.col("_price").alias("price"),
    )


def _opened_sheets(cells: DataFrame, width: int, file_column: str, order: str) -> DataFrame:
    """One row per file: its first line, and where that names the date and the price (the last of several)."""
    first = cells.groupBy(file_column).agg(
        F.min(order).alias("_first"), F.min_by(F.array(*[F.col(f"c{i}") for i in range(width)]), order).alias("_header")
    )

    def last_match(names: Sequence[str]) -> Column:
        return F.array_max(F.transform("_header", lambda c, i: F.when(normal_header(c).isin(*names), i)))

    return first.select(
        file_column, "_first", last_match(DATE_HEADERS).alias("date_at"), last_match(PRICE_HEADERS).alias("price_at")
    )


def _parsed_sheets(cells: DataFrame, opened: DataFrame, width: int, file_column: str, order: str) -> DataFrame:
    """Rows below the headers of the files that name both columns, with ``_broken`` where a cell does not parse."""
    row = F.array(*[F.col(f"c{i}") for i in range(width)])
    rows = cells.join(opened.where("date_at is not null and price_at is not null"), file_column)
    rows = rows.where(F.col(order) > F.col("_first")).withColumns(
        {"date_text": F.get(row, F.col("date_at")), "price_text": F.get(row, F.col("price_at"))}
    )
    rows = rows.withColumns(
        {"date": parse_day_first(F.col("date_text")), "price": parse_price(F.col("price_text"))}
    )
    bad_price = F.col("price").isNull() & F.col("price_text").isNotNull()
    bad_date = F.col("date").isNull() & F.col("date_text").isNotNull()
    reason = F.when(bad_price, "a price does not parse").when(bad_date, "a date does not parse")
    return rows.withColumn("_broken", reason)


def import_sheets(
    cells: DataFrame, width: int, file_column: str = "file_path", order: str = "line_no"
) -> DataFrame:
    """Rows of every valid sheet among raw cells ``c0 .. c{width-1}``.

    The first line of each file, by ``order``, is its header; header words further down are data. A
    file without a date or a price header, or with a price or date that does not parse, is left out
    as a whole (see ``rejected_sheets``); the others go on. What is known about a file is one
    aggregated row, joined back to its cells: no file is gathered in one task however large it is.
    """
    opened = _opened_sheets(cells, width, file_column, order)
    rows = _parsed_sheets(cells, opened, width, file_column, order)
    failed = rows.where("_broken is not null").select(file_column).distinct()
    return (
        rows.join(failed, file_column, "left_anti")
        .filter(F.col("date").isNotNull() & (F.col("price") > 0))
        .drop("date_at", "price_at", "date_text", "price_text", "_first", "_broken", *[f"c{i}" for i in range(width)])
    )


def rejected_sheets(
    cells: DataFrame, width: int, file_column: str = "file_path", order: str = "line_no"
) -> DataFrame:
    """(file, reason) of every file that ``import_sheets`` leaves out."""
    opened = _opened_sheets(cells, width, file_column, order)
    headless = opened.where("date_at is null or price_at is null").select(
        file_column, F.when(F.col("date_at").isNull(), "no date column").otherwise("no price column").alias("reason")
    )
    rows = _parsed_sheets(cells, opened, width, file_column, order)
    broken = rows.where("_broken is not null").groupBy(file_column).agg(F.min("_broken").alias("reason"))
    return headless.unionByName(broken)


def concat_sheets(frames: Sequence[DataFrame]) -> DataFrame:
    """Outer concatenation; columns missing in a sheet are null. No sheet is an error."""
    if not frames:
        raise FileNotFoundError("no price sheets found")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unify_yearly_price(df: DataFrame) -> DataFrame:
    """One ``price`` column from the two spellings of the yearly sheets."""
    present = [c for c in YEARLY_PRICE_HEADERS if c in df.columns]
    if not present:
        raise ValueError("no price column in the yearly sheets")
    value = F.coalesce(*[F.col(f"`{c}`") for c in present])
    return df.withColumn("price", value).drop(*present)


def load_yearly(
    frames: Sequence[DataFrame],
    order: Sequence[str],
    keys: Sequence[str] = ("series_id", "date"),
) -> DataFrame:
    """Yearly sheets -> one price per day.

    The first row of a day wins even when its price is unusable; unusable and
    non-positive prices are dropped afterwards. Prices are plain numbers here,
    separators are not stripped.
    """
    rows = unify_yearly_price(concat_sheets(frames))
    typed = rows.withColumn("price", nan_to_null(to_double(F.col("price"))))
    return first_per_key(typed, order, keys).filter(F.col("price") > 0)
