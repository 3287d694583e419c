"""Parsing of hand-kept price sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewatch.functions.numeric import nan_to_null, to_double

# Accepted headers, compared after lower-casing and trimming.
DATE_HEADERS = ("date", "tanggal")
PRICE_HEADERS = ("price", "harga", "price (rp)", "pricerp")


#: Time that a spreadsheet writes behind a date.
TIME_OF_DAY = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"


def normal_header(name: Column) -> Column:
    return F.lower(F.trim(name))


def parse_price(text: Column) -> Column:
    """Price text with '.' and ',' as thousands separators; unparsable -> null.

    Only text is stripped. A numeric column must be cast as it is: stripping the
    point of "45000.0" would multiply the price by ten.
    """
    return nan_to_null(to_double(F.translate(F.trim(text), ".,", "")))


def parse_day_first(text: Column) -> Column:
    """dd/MM/yyyy or dd-MM-yyyy, else ISO yyyy-MM-dd, each with or without a time; unparsable -> null.

    The shape of the text tells them apart, so no row pays for a failed attempt.
    """
    cell = F.regexp_replace(F.trim(text), TIME_OF_DAY, "")
    return (
        F.when(cell.contains("/"), F.try_to_date(cell, "d/M/yyyy"))
        .when(cell.rlike(r"^\d{1,2}-"), F.try_to_date(cell, "d-M-yyyy"))
        .otherwise(F.try_to_date(cell, "yyyy-MM-dd"))
    )
