"""Readers of the engine's own tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pricewatch import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; every other fault of the store is raised."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns of a stored table. A path that is missing or holds no file yet reads as empty;
    a renamed column, a broken file or a fault of the store raises."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # created, nothing written
            return spark.createDataFrame([], schema)
        raise
    return table.select(*schema.names)


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Price table, pruned to its three columns."""
    return stored(spark, path, schemas.PRICE_OBS)


def risk_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RISK_STATUS).parquet(path)


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast table; a filter on ``horizon`` reads only that partition."""
    return spark.read.parquet(path)
