"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``vnodes`` places of a ring of 63-bit positions. A row hashes to a position
and belongs to the next place clockwise. A shard takes no more rows than its bound; rows beyond it
continue clockwise to the next place whose shard has room. Rows that need fewer steps are placed
first, rows of one arc in (position, id) order, so the result does not depend on the partitioning.

The position comes from the text, so equal texts share an arc and stay together unless a bound
splits them. With ``slack`` 0 the bounds differ by at most one and every shard is filled to its
bound: row counts are at most one apart. A larger slack moves fewer rows when shards are added.

Only the arc counts (``shards * vnodes`` numbers) reach the driver. Rows are numbered by a range
sort, so a text that holds a third of all rows spreads over tasks like any others.

Null text counts as empty; null ids sort first; repeated rows each get a slot of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import ranked

_SEGMENT = "_arc int, _from long, _to long, shard int, _slot long"


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes and the shard at each."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) >> 1, s)
        for s in range(shards)
        for v in range(vnodes)
    )
    positions, owners = zip(*nodes)
    return np.array(positions, dtype=np.int64), np.array(owners)


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard; slack 0 gives bounds that sum to ``rows``."""
    if slack > 0:
        return [int(np.ceil((1 + slack) * rows / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of every run of rows placed together.

    Step by step around the ring: in step h the rows still waiting in an arc try the node h places
    clockwise, arcs in ring order. ``room`` sums to at least the rows, so all find a place.
    """
    room, used = list(room), [0] * len(room)
    done = [0] * len(counts)
    waiting = [a for a, n in enumerate(counts) if n]
    runs = []
    for hop in range(len(counts)):
        if not waiting:
            break
        for arc in waiting:
            shard = owners[(arc + hop) % len(owners)]
            take = min(room[shard], counts[arc] - done[arc])
            if take:
                runs.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                done[arc] += take
                room[shard] -= take
                used[shard] += take
        waiting = [a for a in waiting if done[a] < counts[a]]
    return runs


def assign(
    docs: DataFrame, shards: int = 16, vnodes: int = 64, slack: float = 0.0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless in its shard)."""
    spark = docs.sparkSession
    positions, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, position.to_numpy()) % len(positions)).astype("int32")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("_position"),
    ).withColumn("_arc", arc_of("_position"))
    numbered, arcs = ranked(rows, ["_arc"], ["_position", "doc_id"], "_rank")
    counts = [0] * len(positions)
    for arc, n in arcs.select("_arc", "n").collect():  # at most shards * vnodes rows
        counts[arc] = n
    runs = place(counts, owners.tolist(), bounds(sum(counts), shards, slack))
    segments = spark.createDataFrame([tuple(map(int, r)) for r in runs], _SEGMENT)
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return (
        numbered.join(segments, "_arc").where(inside).select(
            "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_from") + F.col("_slot")).alias("slot")
        )
    )
