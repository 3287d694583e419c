"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so nearest by distance is nearest by cosine. Each of ``tables``
hash tables has ``hashes`` Gaussian projections cut into cells of ``width``; a bucket is the tuple
of cells. A query visits its own bucket and then perturbed buckets (cells one up or down) in
increasing sum of squared distances to the cell borders crossed, the estimated order of success.

Buckets are dealt into groups of a few thousand vectors. A query travels once to every group that
holds a bucket it visits; there its buckets are read as blocks and the best candidates of the group
kept, so pairs are never rows. Candidates of all tables are merged and ranked by the exact cosine
of the original vectors in double precision.

Equal vectors are collapsed first: one representative is indexed, and of its ids only the smallest
``k + 1`` can ever be returned (ties go to smaller ids, a query skips itself). A bucket of very many
different vectors is dealt in slices to several groups, and its queries visit them all. Queries with
fewer than ``k`` candidates are completed by an exact scan in blocks.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids; of rows that repeat an id and a vector one counts (of an id with two vectors the smaller is its
query); vectors of another length than the query's are no candidates of it. With fewer than ``k``
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewatch.llm.common import stored

#: Queries and pairs measured at once, and what a matrix product may be off by.
_QUERIES, _PAIRS, _ROUNDING = 256, 1 << 16, 1e-9
#: Seed of the projections.
SEED = 20240917


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (double) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fine = (
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & fine
    )


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """rep (smallest id), vector, ids (the k + 1 smallest ids that share it)."""
    by_hash = rows.withColumn("_h", F.xxhash64("vector"))
    ordered = Window.partitionBy("_h", "_salt", "vector").orderBy("vec_id")
    salted = by_hash.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).dropDuplicates(["_h", "_salt", "vector", "vec_id"])
    few = salted.withColumn("_place", F.row_number().over(ordered)).where(F.col("_place") <= k + 1)
    return few.groupBy("_h", "vector").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("rep"), "vector", "ids"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # squares of very large numbers must not overflow
    vectors = vectors / largest
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


class Hashing:
    """The tables' projections for one vector length."""

    def __init__(self, dimensions: int, tables: int, hashes: int, width: float) -> None:
        rng = np.random.default_rng([SEED, dimensions])
        self.tables, self.hashes, self.width = tables, hashes, width
        self.directions = rng.standard_normal((dimensions, tables * hashes))
        self.shifts = rng.uniform(0, 1, tables * hashes)

    def positions(self, vectors: np.ndarray) -> np.ndarray:
        """Position on each projection, in cells: (vectors, tables, hashes)."""
        return (_unit(vectors) @ self.directions / self.width + self.shifts).reshape(-1, self.tables, self.hashes)

    def bucket_ids(self, cells: np.ndarray) -> np.ndarray:
        """64-bit id of each cell tuple along the last axis."""
        ids = np.full(cells.shape[:-1], np.uint64(self.directions.shape[0]))
        for i in range(self.hashes):
            ids = (ids ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            ids ^= ids >> np.uint64(29)
        return ids.view(np.int64)


def perturbations(hashes: int, most: int = 3) -> np.ndarray:
    """All moves of up to ``most`` cells by -1 or +1, as rows over the hashes."""
    rows = [np.zeros(hashes, dtype=np.int64)]
    level = [(rows[0], -1)]
    for _ in range(most):
        level = [
            (moved, i)
            for base, last in level for i in range(last + 1, hashes) for step in (-1, 1)
            for moved in [base + step * np.eye(hashes, dtype=np.int64)[i]]
        ]
        rows += [r for r, _ in level]
    return np.array(rows)


_BUCKETS = "id long, vector array<double>, table int, buckets array<long>"


def _buckets(tables: int, hashes: int, width: float, probes: int):
    """A row for every vector and table: its own bucket, or its ``probes`` likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashing] = {}
        moves = perturbations(hashes)
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("vector")).to_numpy()
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                for first in range(0, part.num_rows, 128):
                    own = part.slice(first, 128)
                    hashing = made.setdefault(int(n), Hashing(int(n), tables, hashes, width))
                    at = hashing.positions(_matrix(own.column("vector")))
                    cells = np.floor(at)
                    if probes == 1:
                        ids = hashing.bucket_ids(cells)[:, :, None]
                    else:
                        down = at - cells
                        cost = np.where(moves > 0, (1 - down[:, :, None, :]) ** 2, down[:, :, None, :] ** 2)
                        cost = (cost * (moves != 0)).sum(axis=-1)
                        order = np.argsort(cost, axis=-1, kind="stable")[:, :, :probes]
                        ids = hashing.bucket_ids(cells[:, :, None, :] + moves[order])
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [own.column("id"), own.column("vector"), pa.array(np.full(own.num_rows, t, dtype=np.int32)),
                             pa.array(list(ids[:, t, :]), pa.list_(pa.int64()))],
                            names=["id", "vector", "table", "buckets"],
                        )

    return run


def _in_order(products: np.ndarray) -> np.ndarray:
    """Sums along the rows, term after term, as :func:`cosine` sums."""
    return np.add.accumulate(products, axis=1)[:, -1]


def _nearest(vectors: np.ndarray, units: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray, members: np.ndarray, kept: int):
    """(query, member, cosine): the ``kept`` nearest members of every query by the exact measure, ties to smaller ids.

    A matrix product finds what can be among them; whatever lies within its rounding of the last place
    is measured exactly. Queries and pairs are handled in blocks of fixed size.
    """
    top = min(kept, len(members))
    for first in range(0, len(queries), _QUERIES):
        own = queries[first : first + _QUERIES]
        near = units[own] @ units[members].T
        last = np.partition(near, len(members) - top, axis=1)[:, len(members) - top]
        row, column = np.nonzero(near >= last[:, None] - _ROUNDING)
        q, m = own[row], members[column]
        score = np.concatenate(
            [
                _in_order(vectors[q[a : a + _PAIRS]] * vectors[m[a : a + _PAIRS]])
                / (norms[q[a : a + _PAIRS]] * norms[m[a : a + _PAIRS]])
                for a in range(0, len(q), _PAIRS)
            ]
        )
        order = np.lexsort((ids[m], -score, row))
        row, q, m, score = row[order], q[order], m[order], score[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        best = place < top
        yield q[best], m[best], score[best]


def _meet(kept: int):
    """Best candidates of every query in one group of buckets."""

    def run(rows: pa.Table) -> pa.Table:
        lengths = pa.compute.list_value_length(rows.column("vector")).to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(lengths):
            part = rows.filter(pa.array(lengths == n))
            is_query = part.column("is_query").to_numpy()
            vectors = _matrix(part.column("vector").combine_chunks())
            units, norms = _unit(vectors), np.sqrt(_in_order(vectors * vectors))
            ids = part.column("id").to_numpy()
            lists = part.column("buckets").to_numpy()
            owner = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
            bucket = np.concatenate(lists)
            order = np.lexsort((is_query[owner], bucket))
            owner, bucket = owner[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket))
            for first, end in zip(cuts, cuts[1:]):
                members = owner[first:end]
                queries, others = members[is_query[members]], members[~is_query[members]]
                if len(queries) and len(others):
                    for q, m, score in _nearest(vectors, units, norms, ids, queries, others, kept):
                        found.append((ids[q], ids[m], score))
        query, rep, near = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((rep, -near, query))
        query, rep, near = query[order], rep[order], near[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])[: len(query)]
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        best = place < kept
        return pa.table({"query_id": query[best], "rep": rep[best], "near": near[best]})

    return run


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision: dot product over the product of the norms, summed in order."""
    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return dot / (F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x))))


def _best(scored: DataFrame, k: int, slices: int = 16) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of every query, slice by slice first."""
    order = (F.desc("score"), F.asc("vec_id"))
    salted = scored.withColumn("_slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
    local = salted.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_slice").orderBy(*order)))
    local = local.where(F.col("_r") <= k).drop("_r", "_slice")
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(
        F.col("rank") <= k
    )


def _expanded(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, score of (query_id, rep) pairs, over all ids of the representative but the query's."""
    joined = pairs.join(queries, "query_id").join(vectors, "rep")
    same = F.size("query") == F.size("vector")
    scored = joined.where(same).select("query_id", cosine(F.col("query"), F.col("vector")).alias("score"), F.explode("ids").alias("vec_id"))
    return scored.where(F.col("vec_id") != F.col("query_id"))


def _candidates(
    vectors: DataFrame, queries: DataFrame, k: int, tables: int, hashes: int, probes: int, width: float, group_rows: int
) -> DataFrame:
    """query_id, rep: the nearest representatives in the visited buckets, some more than k."""
    index = vectors.select(F.col("rep").alias("id"), "vector").mapInArrow(_buckets(tables, hashes, width, 1), _BUCKETS)
    index = index.select("id", "vector", "table", F.get("buckets", F.lit(0)).alias("bucket"))
    probe = queries.select(F.col("query_id").alias("id"), F.col("query").alias("vector")).mapInArrow(
        _buckets(tables, hashes, width, probes), _BUCKETS
    )
    hot = stored(
        index.groupBy("table", "bucket").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("slices")).where("slices > 1"),
        "hot-buckets",
    )
    groups = F.lit(1 + vectors.count() // group_rows)
    group = F.pmod(F.xxhash64("table", "bucket", "slice"), groups * tables)
    slices = F.coalesce("slices", F.lit(1))
    index = index.join(hot, ["table", "bucket"], "left").withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int"))
    index = index.select(
        group.alias("group"), F.lit(False).alias("is_query"), "id", "vector", F.array("bucket").alias("buckets")
    )
    visits = probe.select("id", "table", F.explode("buckets").alias("bucket")).join(hot, ["table", "bucket"], "left")
    visits = visits.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    visits = visits.groupBy("id", group.alias("group")).agg(F.collect_set("bucket").alias("buckets"))
    visits = visits.join(queries, visits["id"] == queries["query_id"]).select(
        "group", F.lit(True).alias("is_query"), "id", F.col("query").alias("vector"), "buckets"
    )
    kept = k + 1  # the query itself may be one of them
    met = index.unionByName(visits).groupBy("group").applyInArrow(_meet(kept), "query_id long, rep long, near double")
    merged = met.groupBy("query_id", "rep").agg(F.max("near").alias("near"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "rep"))
    return merged.withColumn("_place", place).where(F.col("_place") <= kept).select("query_id", "rep")


def search(
    rows: DataFrame, is_query: Column, k: int = 5, tables: int = 7, hashes: int = 8, probes: int = 150,
    width: float = 2.0, group_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, itself excluded."""
    fine = usable(rows, id_col, vector_col)
    vectors = stored(distinct_vectors(fine, k), "distinct-vectors")
    own = fine.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"))
    queries = stored(own, "query-vectors")
    pairs = _candidates(vectors, queries, k, tables, hashes, probes, width, group_rows)
    found = stored(_best(_expanded(pairs, vectors, queries), k), "nearest-found")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", "query")
    short = stored(short, "short-queries")
    complete = found.join(short.select("query_id"), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score")
    if short.isEmpty():
        return complete
    return complete.unionByName(exact(short, vectors, k))


def exact(queries: DataFrame, vectors: DataFrame, k: int, block: int = 256) -> DataFrame:
    """The k nearest by a scan: blocks of queries against slices of the vectors, best k of each slice."""
    slices = 64
    left = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(1 + queries.count() // block)))
    blocks = left.groupBy("_block").agg(F.collect_list(F.struct("query_id", "query")).alias("_queries"))
    blocks = blocks.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = vectors.withColumn("_slice", F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int"))

    pairs = blocks.join(right, "_slice").select(F.explode("_queries").alias("_q"), "vector", "ids")
    scored = pairs.where(F.size("_q.query") == F.size("vector")).select(
        F.col("_q.query_id").alias("query_id"), cosine(F.col("_q.query"), F.col("vector")).alias("score"), F.explode("ids").alias("vec_id")
    ).where(F.col("vec_id") != F.col("query_id"))
    return _best(scored, k).select("query_id", "rank", "vec_id", "score")
