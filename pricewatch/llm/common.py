"""Helpers shared by the corpus operators: work tables, global ranks, byte columns."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewatch.session import new_table_path

#: ``monotonically_increasing_id`` keeps the partition above this many bits.
_ROW_BITS = 33


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file: ``PUBLIC_TOKENIZERS`` or the installed package."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(column: Column | str, buckets: int) -> Column:
    """crc32 of the column as text, modulo ``buckets``; null counts as empty text."""
    text = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(text.cast("string"), F.lit(""))) % buckets


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """Number the rows of every key from 0 in the given order, without gathering a key in one task.

    Rows are range-partitioned and sorted by (keys, order), so a frequent key spreads over
    partitions. Every row gets its place in its partition; the partitions' counts per key (at most
    one row per key and partition) give the offsets. Returns the numbered rows and the count of
    every key as ``n``. Rows that tie in all of ``keys`` and ``order`` get distinct numbers.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = stored(placed.withColumn("_seq", F.monotonically_increasing_id()), f"ranked-{rank}")
    part = F.shiftrightunsigned("_seq", _ROW_BITS).alias("_part")
    counts = placed.groupBy(part, *keys).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), f"offsets-{rank}"
    )
    spread = placed.withColumn("_part", part)
    match = spread["_part"] == counts["_part"]
    for key in keys:
        match = match & spread[key].eqNullSafe(counts[key])
    numbered = spread.join(counts, match).select(
        *[spread[c] for c in df.columns],
        (spread["_seq"] - counts["_first"] + counts["_before"]).alias(rank),
    )
    return numbered, counts.groupBy(*keys).agg(F.sum("_n").alias("n"))


def flat_bytes(column: Any) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary Arrow column one after another, and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def byte_lengths(column: Any) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: Any, column: str, size: int = 1 << 22) -> Iterator[Any]:
    """Parts of an Arrow batch whose strings in ``column`` have about ``size`` bytes together, one row at least."""
    parts = np.cumsum(byte_lengths(batch.column(column))) // size
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:]):
        if last > first:
            yield batch.slice(first, last - first)


def sliced(batches: Iterable, column: str) -> Iterator[Any]:
    """``slices`` of every batch, so that only some megabytes of text are Python strings at once."""
    for batch in batches:
        yield from slices(batch, column)


def release_memory() -> None:
    """Hand memory that a finished task no longer uses back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class WordCache:
    """Results of a function of words, kept per process in two generations of bounded size.

    A word found in the older generation moves to the younger one; when that is full it becomes the
    older. Words longer than ``chars`` are kept for one look-up only, so memory is bounded.
    """

    def __init__(self, encode: Callable[[list], Iterable[Any]], words: int = 300_000, chars: int = 48) -> None:
        self.encode, self.words, self.chars = encode, words, chars
        self.young: dict[Any, Any] = {}
        self.old: dict[Any, Any] = {}
        self.long: list = []

    def look_up(self, distinct: Iterable) -> dict:
        """A table that holds every given word, valid until the next call."""
        for word in self.long:
            del self.young[word]
        if len(self.young) > self.words:
            self.young, self.old = {}, self.young
        missing = []
        for word in distinct:
            if word not in self.young:
                entry = self.old.get(word)
                if entry is None:
                    missing.append(word)
                else:
                    self.young[word] = entry
        self.young.update(zip(missing, self.encode(missing)))
        self.long = [w for w in missing if len(w) > self.chars]
        return self.young
