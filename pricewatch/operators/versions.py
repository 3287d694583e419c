"""Small tables that are rewritten as a whole: versions with one atomic switch.

A version is a folder of Parquet files under ``data``. It becomes current when a file named after its
number appears under ``versions``; that file is written aside and renamed into place, so a reader sees
the old version or the new one. A job that dies in between leaves files nobody refers to, and the next
one starts from the version that was current. Two writers that start from one version collide on its
successor's number: the later one gets an error and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class VersionConflict(RuntimeError):
    """Another writer made the next version first."""


def _store(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, data folder) of every version, oldest first."""
    folder, fs = _store(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = (name.split("-", 1) for name in names if name[:1].isdigit())
    return sorted((int(number), data) for number, data in found)


def current(spark: SparkSession, path: str) -> int:
    """Number of the current version; 0 if there is none."""
    versions = _listed(spark, path)
    return versions[-1][0] if versions else 0


def read(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The current version, or an older one that was kept; without any, an empty table."""
    versions = [(n, data) for n, data in _listed(spark, path) if version is None or n == version]
    if not versions:
        if version is not None:
            raise ValueError(f"no version {version} of {path}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data/{versions[-1][1]}")


def _publish(spark: SparkSession, path: str, number: int, data: str) -> None:
    folder, fs = _store(spark, f"{path}/versions")
    fs.mkdirs(folder)
    aside, _ = _store(spark, f"{path}/versions/.{data}")
    fs.create(aside, True).close()
    final, _ = _store(spark, f"{path}/versions/{number:012d}-{data}")
    if any(n >= number for n, _ in _listed(spark, path)) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise VersionConflict(f"version {number} of {path} was made by another writer")


def commit(df: DataFrame, path: str, based_on: int, keep: int = 2) -> int:
    """Write ``df`` as the version after ``based_on`` and make it current; returns its number.

    The newest ``keep`` versions stay readable, older files are removed after the switch.
    """
    spark = df.sparkSession
    data = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{data}")
    _publish(spark, path, based_on + 1, data)
    for number, old in _listed(spark, path)[: -max(1, keep)]:
        for name in (f"{path}/versions/{number:012d}-{old}", f"{path}/data/{old}"):
            location, fs = _store(spark, name)
            fs.delete(location, True)
    return based_on + 1
