import math
from fractions import Fraction

import numpy as np
import pytest

from pricewatch.llm import queries, whitening


def plain_polynomial(b):
    """Coefficients of det(x - B), from x^0, by Faddeev's recurrence on integers."""
    d = len(b)
    m, c = np.zeros((d, d), dtype=object), [0] * d + [1]
    for k in range(1, d + 1):
        m = b @ m + c[d - k + 1] * np.eye(d, dtype=int).astype(object)
        c[d - k] = -sum((b @ m)[i, i] for i in range(d)) // k
    return c


def some_scatter(rng, d, rank, size=50):
    x = rng.integers(-size, size, (rank, d)).astype(object)
    return x.T @ x


@pytest.mark.parametrize("d,rank", [(1, 3), (2, 5), (5, 9), (6, 2), (9, 30), (4, 1)])
def test_polynomial_is_exact(spark, d, rank):
    b = some_scatter(np.random.default_rng(d), d, rank, 10**6)
    assert whitening.characteristic(spark, b, per_task=3) == plain_polynomial(b)


def test_polynomial_needs_row_exchanges(spark):
    b = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]], dtype=object)
    assert whitening.characteristic(spark, b) == plain_polynomial(b)
    p = np.array(whitening.primes(200))
    same = np.diag([5, 5, 5, 7]).astype(object)
    assert (whitening.characteristic_mod(same, p) == [[c % int(q) for c in plain_polynomial(same)] for q in p]).all()


def test_roots_are_isolated_and_refined():
    b = some_scatter(np.random.default_rng(0), 12, 40)
    roots = whitening.largest_roots(plain_polynomial(b), 5)
    want = np.linalg.eigvalsh(b.astype(float))[::-1]
    assert all(m == 1 for _, m in roots) and len(roots) == 5
    assert np.allclose([float(r) for r, _ in roots], want[:5], rtol=1e-12)
    poly = plain_polynomial(b)
    for r, _ in roots:  # the sign changes within 2^-150 of the root
        step = Fraction(1, 1 << 150) * roots[0][0]
        low, high = (sum(c * x**i for i, c in enumerate(poly)) for x in (r - step, r + step))
        assert low * high < 0


def test_equal_and_zero_roots():
    poly = plain_polynomial(np.diag([9, 9, 9, 4, 0, 0]).astype(object))
    found = whitening.largest_roots(poly, 6)
    assert [m for _, m in found] == [3, 1] and [round(float(r), 9) for r, _ in found] == [9, 4]
    vectors = np.stack([v for _, v in whitening.components(np.diag([9, 9, 9, 4, 0, 0]).astype(object), found)])
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-12) and np.allclose(vectors[:3, 3:], 0, atol=1e-12)


def frame(spark, vectors):
    return spark.createDataFrame(
        [(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in enumerate(vectors)],
        "vec_id long, embedding array<double>, component string",
    )


def plain(vectors, k):
    """Exact sums in Python integers, eigenvectors by the dense solver."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, [sum(c * c for c in r) for r in y], (np.array(y, dtype=float) / n) @ vectors / np.sqrt(values), values / np.trace(v)


def compared(rows, vectors, k):
    got = {}
    for r in rows.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    kept = sorted(got)
    n, deviation, whitened, explained = plain([vectors[i] for i in kept], k)
    signs = None
    for at, i in enumerate(kept):
        own = [got[i][c + 1] for c in range(k)]
        assert len(got[i]) == k and {(r["n"], r["deviation"]) for r in own} == {(n, deviation[at])}
        w = np.array([r["whitened"] for r in own])
        signs = np.sign(w * whitened[at]) if signs is None else signs
        assert np.allclose(w, signs * whitened[at], atol=1e-9)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9)
        assert own[0]["identity_error"] < 1e-9
    return kept


def test_whitened_rows_against_the_dense_solver(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 7)) @ rng.standard_normal((7, 7))).tolist()
    vectors += [vectors[0], vectors[0]]
    odd = [None, [], [1.0] * 6, [None] + [0.0] * 6, [float("nan")] + [0.0] * 6, [float("inf")] * 7]
    kept = compared(whitening.whiten(frame(spark, vectors + odd).repartition(5), k=4), vectors, 4)
    assert kept == list(range(len(vectors)))


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((60, 3)) * 1e5).tolist()
    compared(whitening.whiten(frame(spark, vectors), k=3), vectors, 3)
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(frame(spark, [[1e30, 0.0], [0.0, 1.0]])).count()
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(frame(spark, [[1e9, 0.0], [0.0, 1.0], [1.0, 3.0]])).count()


def test_without_spread_there_are_no_components(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [None], [[1.0, 2.0]] * 5):
        got = whitening.whiten(frame(spark, vectors))
        assert got.count() == 0 and got.columns == columns
    line = [[float(i), 2.0 * i, 7.0] for i in range(9)]
    assert {r["component"] for r in whitening.whiten(frame(spark, line)).collect()} == {1}


def test_query_against_the_dense_solver(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in rows}
    compared(queries.op12_whitening(spark, sf), vectors, 32)
