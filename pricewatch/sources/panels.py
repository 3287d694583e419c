"""Price panels derived from the star schema.

A panel holds one row per (series_id, date): the mean amount of the day in whole
cents. The sum runs over whole cents, so the result does not depend on row order,
and it is combined map-side: a series or day that holds a third of all rows
reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_panel(rows: DataFrame, series: Column, day: Column, amount: Column) -> DataFrame:
    """(series_id, date, price): mean amount per day, half up to whole cents."""
    return (
        rows.select(
            series.cast("string").alias("series_id"),
            F.to_date(day).alias("date"),
            F.floor(amount * 100 + 0.5).alias("cents"),
        )
        .groupBy("series_id", "date")
        .agg(
            F.sum("cents").alias("cents"),
            F.count("cents").alias("n"),
        )
        .select(
            "series_id",
            "date",
            (F.expr("(cents * 2 + n) div nullif(n * 2, 0)") / 100.0).alias("price"),
        )
    )


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dense series: mean order value per priority."""
    orders = table(spark, sf_dir, "orders")
    return daily_panel(
        orders, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice")
    )


def price_obs_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 series: mean line price per brand."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return daily_panel(
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey")),
        F.col("p_brand"),
        F.col("l_shipdate"),
        F.col("l_extendedprice"),
    )


def price_obs_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier; the panel widens with the data."""
    lines = table(spark, sf_dir, "lineitem")
    return daily_panel(
        lines, F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_extendedprice")
    )


def price_obs_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five short series: mean event value per type over one month."""
    events = table(spark, sf_dir, "events")
    return daily_panel(events, F.col("event_type"), F.col("ts"), F.col("value"))


def price_obs_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """125 sparse series: mean order value per customer nation and priority."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return daily_panel(
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey")),
        F.concat_ws("|", F.col("c_nationkey").cast("string"), F.col("o_orderpriority")),
        F.col("o_orderdate"),
        F.col("o_totalprice"),
    )


# Days of constant price at the end of each series.
FLAT_DAYS = {"1-URGENT": 10, "3-MEDIUM": 20, "2-HIGH": 70, "5-LOW": 100, "4-NOT SPECIFIED": 0}


def price_obs_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``price_obs`` with a flat tail whose length differs per series."""
    obs = price_obs(spark, sf_dir)
    flat = F.lit(0)
    for series, days in FLAT_DAYS.items():
        flat = F.when(F.col("series_id") == series, days).otherwise(flat)
    last = F.max("date").over(Window.partitionBy("series_id"))
    return obs.withColumn("last_date", last).select(
        "series_id",
        "date",
        F.when(F.datediff("last_date", "date") < flat, F.lit(250000.0))
        .otherwise(F.col("price"))
        .alias("price"),
    )


def price_obs_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``price_obs`` without a price on the 1st and with price 0 on the 2nd and 15th."""
    day = F.dayofmonth("date")
    return price_obs(spark, sf_dir).select(
        "series_id",
        "date",
        F.when(day == 1, F.lit(None).cast("double"))
        .when(day.isin(2, 15), F.lit(0.0))
        .otherwise(F.col("price"))
        .alias("price"),
    )


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hand-kept sheets: one sheet per year, dates and prices as text.

    Open orders carry ISO dates, the others day-first dates. The 29th has no
    price, the 30th has '0' and the 31st has 'n/a'.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"
    )
    day = F.to_date("o_orderdate")
    whole = F.floor("o_totalprice")
    text = F.concat(
        F.floor(F.col("o_totalprice") / 1000).cast("string"),
        F.lit("."),
        F.lpad((whole % 1000).cast("string"), 3, "0"),
    )
    return orders.select(
        F.year(day).alias("file_no"),
        F.col("o_orderkey").alias("row_no"),
        F.when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
        .alias("tanggal"),
        F.when(F.dayofmonth(day) == 31, F.lit("n/a"))
        .when(F.dayofmonth(day) == 30, F.lit("0"))
        .when(F.dayofmonth(day) != 29, text)
        .alias("harga"),
    )
