"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("node", "near").union(edges.select(F.col("near"), F.col("node")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its smallest neighbour (or itself)."""
    around = _both_ways(edges)
    least = around.groupBy("node").agg(F.min("near").alias("_least"))
    least = stored(least.select("node", F.least("node", "_least").alias("_least")), "least")
    return (
        around.join(least, "node").where(F.col("near") > F.col("node"))
        .select(F.col("near").alias("node"), F.col("_least").alias("near")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("node", "near").alias("node"), F.least("node", "near").alias("near"))
    least = stored(down.groupBy("node").agg(F.min("near").alias("_least")), "least")
    moved = down.join(least, "node").select(F.col("near").alias("node"), F.col("_least").alias("near"))
    return moved.where(F.col("node") != F.col("near")).union(least.select("node", "_least")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "near"))).first())


def roots(edges: DataFrame) -> DataFrame:
    """(node, near) -> (node, root): every node of an edge that is not the smallest of its component.

    Each round is two aggregates and two joins on tables no larger than the edges, written to the
    shared folder; only a count and a checksum reach the driver. The least neighbours are written
    before they are joined: both sides of the join are then plain exchanges, and adaptive execution
    can split a node that has very many neighbours.
    """
    edges = stored(edges.where(F.col("node") != F.col("near")), "edges")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select("node", F.col("near").alias("root"))
