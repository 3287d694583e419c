"""Merging new prices into a keyed price table."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewatch.session import new_table_path, remove_path

KEYS = ("series_id", "date")
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Wider than the range of a bigint, so that (high, low) pairs keep their order.
_HIGH_STEP = Decimal(2 * 10**19)


def order_key(rows: DataFrame, order: Sequence[str]) -> Column:
    """Sort key over the ``order`` columns.

    Two integral columns become one wide decimal: a fixed-width buffer lets
    Spark use a hash aggregate. Anything else becomes a struct.
    """
    kinds = [rows.schema[name].dataType for name in order]
    if len(order) == 2 and all(isinstance(kind, _INTEGRAL) for kind in kinds):
        high, low = (F.col(name).cast("decimal(20,0)") for name in order)
        return (high * F.lit(_HIGH_STEP) + low).cast("decimal(38,0)")
    return F.struct(*order)


def _pick(rows: DataFrame, order: Sequence[str], keys: Sequence[str], by) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.withColumn("_order", order_key(rows, order))
        .groupBy(*keys)
        .agg(*[by(c, "_order").alias(c) for c in rest])
    )


def last_per_key(
    rows: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Last row per key in ``order``.

    An aggregate, not a ranking window: duplicates are reduced before the
    shuffle, so a key repeated in a third of all rows does no harm.
    """
    return _pick(rows, order, keys, F.max_by)


def first_per_key(
    rows: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """First row per key in ``order``, see :func:`last_per_key`."""
    return _pick(rows, order, keys, F.min_by)


def upsert(
    existing: DataFrame,
    batch: DataFrame,
    order: Sequence[str] = ("batch_no", "row_no"),
    observation: Observation | None = None,
) -> DataFrame:
    """``existing`` with the rows of ``batch``; the last write of a key wins.

    Rows carry their write order, so repeating or reordering batches does not
    change the result. ``observation`` receives ``inserted``, the batch rows seen.
    """
    if observation is not None:
        batch = batch.observe(observation, F.count(F.lit(1)).alias("inserted"))
    return last_per_key(existing.unionByName(batch), order)


def append_unique(
    files: DataFrame, existing: DataFrame, file_column: str = "file_no"
) -> DataFrame:
    """Rows of the files that a unique key on (series_id, date) would accept.

    Files are taken in the order of ``file_column``. A file with a repeated key,
    or with a key that is stored already or was brought by an earlier accepted
    file, is rejected as a whole.

    The keys of all files are counted once. Only files that share a key stand in each other's way:
    with those keys they form a graph, and everything that follows reads this graph alone. A file
    that comes first under each of its shared keys is in, and the files it meets there are out and
    leave the graph. Each round settles at least one file of every chain of conflicts; a file
    without shared keys takes part in no round. Work tables are removed.
    """
    spark = files.sparkSession
    used: list[str] = []

    def work(df: DataFrame, name: str) -> DataFrame:
        path = new_table_path(spark, name)
        used.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    per_key = files.groupBy(file_column, *KEYS).agg(F.count(F.lit(1)).alias("n"))
    held = existing.select(*KEYS).distinct().withColumn("_stored", F.lit(True))
    bad = (F.col("n") > 1) | F.col("_stored").isNotNull()
    keys = work(per_key.join(held, list(KEYS), "left").select(file_column, *KEYS, bad.alias("bad")), "append-keys")
    out = new_table_path(spark, "append-rejected")
    kind = keys.select(file_column).schema
    keys.filter("bad").select(file_column).distinct().write.parquet(out)

    open_keys = keys.join(spark.read.schema(kind).parquet(out), file_column, "left_anti").select(file_column, *KEYS)
    shared = open_keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    graph = work(open_keys.join(shared, list(KEYS), "left_semi").select(file_column, *KEYS), "append-conflicts")
    while not graph.isEmpty():
        owner = graph.groupBy(*KEYS).agg(F.min(file_column).alias("_owner"))
        late = graph.join(owner, list(KEYS)).filter(F.col("_owner") != F.col(file_column))
        free = work(graph.select(file_column).distinct().join(late, file_column, "left_anti"), "append-free")
        taken = graph.join(free, file_column, "left_semi").select(*KEYS).distinct()
        met = graph.join(taken, list(KEYS), "left_semi").select(file_column).distinct()
        blocked = work(met.join(free, file_column, "left_anti"), "append-blocked")
        blocked.write.mode("append").parquet(out)
        settled = free.unionByName(blocked)
        graph = work(graph.join(settled, file_column, "left_anti"), "append-conflicts")
    for path in used:
        remove_path(spark, path)
    return files.join(spark.read.schema(kind).parquet(out), file_column, "left_anti")
