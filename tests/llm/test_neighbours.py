import numpy as np
from pyspark.sql import functions as F

from pricewatch.llm import neighbours


def plain(rows, queries, k):
    rows = {(i, tuple(v)) for i, v in rows}
    out = []
    for q, qv in sorted(queries):
        near = []
        for i, v in rows:
            if i != q and len(v) == len(qv):
                a, b = np.array(qv), np.array(v)
                near.append((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(near, key=lambda x: (round(x[0], 12), x[1]))[:k])]
    return out


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.search(rows, F.col("vec_id") % 50 == 0).collect()
    pairs = [(r["vec_id"], r["embedding"]) for r in rows.select("vec_id", "embedding").collect()]
    want = plain(pairs, [(i, v) for i, v in pairs if i % 50 == 0], 5)
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i in want}) >= 0.9 * len(want)


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [1.0, None]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (10, [1.0, 1.0, 1.0]), (9, [1.0, 0.0]),
            (50, [1.0, 0.0])] + [(100 + i, [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, query long")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    fine = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (9, [1.0, 0.0]), (50, [1.0, 0.0])]
    fine += [(100 + i, [1.0, 0.0]) for i in range(30)]
    want = plain(fine, [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [1.0, 0.0])], 5)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == want
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_hot_buckets_are_sliced(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.array([1.0, 0.2, 0.1]) + rng.normal(0, 0.01, 3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0, group_rows=32).orderBy("query_id", "rank").collect()
    want = plain(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == want


def test_parallel_vectors_tie_by_the_exact_measure(spark):
    """Multiples of one vector have cosines that differ in the last bits or not at all."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(i, (base * float(rng.uniform(0.1, 9))).tolist()) for i in range(400)]
    rows += [(1000 + i, rng.standard_normal(16).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 50 == 0, group_rows=64).orderBy("query_id", "rank").collect()]
    fine = neighbours.usable(df, "vec_id", "embedding")
    queries = fine.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    want = neighbours.exact(queries, neighbours.distinct_vectors(fine, 5), 5).orderBy("query_id", "rank").collect()
    want = [tuple(r) for r in want]
    assert [r for r in got if r[0] < 1000] == [r for r in want if r[0] < 1000]


def test_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((60, 8))
    norms = np.sqrt(neighbours._in_order(vectors * vectors))
    ids, members = rng.permutation(60), np.arange(20, 60)

    def best():
        parts = neighbours._nearest(vectors, neighbours._unit(vectors), norms, ids, np.arange(20), members, 6)
        return [np.concatenate(x).tolist() for x in zip(*parts)]

    whole = best()
    monkeypatch.setattr(neighbours, "_QUERIES", 3)
    monkeypatch.setattr(neighbours, "_PAIRS", 5)
    assert best() == whole
