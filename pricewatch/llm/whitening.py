"""Embedding whitening through the exact characteristic polynomial of the scatter.

Entries become integers, x = floor(scale * c) + offset, so the scatter B = n sum (x-r)(x-r)^T -
(S-nr)(S-nr)^T, which is n^2 times the covariance, is an integer matrix and known without rounding
(r, the rounded mean, centres the rows before they are multiplied). Its characteristic polynomial is
computed modulo many primes, each by reduction to Hessenberg form, and put together by Chinese
remainders; the primes are dealt over Spark tasks. All roots are real, so by Descartes' rule the
number of roots above a point is exactly the number of sign changes of the polynomial shifted there:
bisection on integers isolates the largest roots and refines each by the sign of the polynomial. A
component is the null vector of B - e: inverse iteration in double precision, then correction
steps on the bordered system with residuals in extended precision. Roots that no precision in use
separates share their null space, which is iterated as a block.

Only sums over dimensions and pairs of dimensions reach the driver; they do not grow with the rows.
Every row is read again to be whitened, and once more to measure the covariance of the result.

Rows whose vector is null, empty, or holds null or non-finite entries are left out; so are vectors
of another length than the commonest (of equally common lengths the longer counts). Repeated rows
and ids count each. Components with eigenvalue zero (the order of the polynomial's root at zero)
cannot be whitened and are left out; an empty table, or one without spread, gives an empty result.
Entries whose integers or deviations leave the range of 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch.llm.common import stored

#: Bits below the point to which roots are known, relative to the largest.
PRECISION = 160
#: Roots closer than this share of the largest are one cluster.
_CLOSE = 2.0**-44
#: Integers that a double represents, and the product sums kept below.
_EXACT = 1 << 53


def integers(rows: DataFrame, scale: int, offset: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (array of long) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(vector) > 0)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(fine)
    most = F.max(F.struct(F.col("count"), F.col("length")))
    length = rows.groupBy(F.size("v").alias("length")).count().agg(most.alias("m")).first()["m"]
    kept = rows.where(F.size("v") == (length["length"] if length else 0))

    def whole(c: F.Column) -> F.Column:
        at = F.lit(float(scale)) * c
        wide = F.raise_error(F.lit("an entry leaves the range of 64 bits")).cast("long")
        return F.when(F.abs(at) < 2.0**62, F.floor(at) + F.lit(offset)).otherwise(wide)

    return kept.select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, n, sum of x_i) per task, exact."""
    n, total = 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            total = total + x.astype(object).sum(axis=0) if np.abs(x).max() > 1 << 40 else total + x.sum(axis=0).astype(object)
            n += batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])],
            names=["i", "n", "s"],
        )


def _products(centre: np.ndarray):
    """(i, j, sum of (x-r)_i (x-r)_j) per task, exact, i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"))
            for first in range(0, len(x), 2048):
                part = x[first : first + 2048] - centre
                largest = int(np.abs(part).max(initial=0))
                if largest * largest * len(part) < _EXACT:  # every sum is an integer that doubles hold
                    floats = part.astype(np.float64)
                    product = (floats.T @ floats).astype(np.int64).astype(object)
                else:
                    part = part.astype(object)
                    product = part.T @ part
                total = product if total is None else total + product
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(v) for v in total[i, j]])],
                names=["i", "j", "s"],
            )

    return run


def _exact_sum(column: str) -> F.Column:
    return F.sum(F.col(column).cast("decimal(38,0)")).alias(column)


def scatter(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, S, B): row count, sums per dimension, integer scatter n^2 V."""
    sums = rows.select("x").mapInArrow(_sums, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), _exact_sum("s"))
    found = sorted(sums.collect())
    if not found:
        return 0, [], np.zeros((0, 0), dtype=object)
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    centre = [round(Fraction(s, n)) for s in sums]
    products = rows.select("x").mapInArrow(_products(np.array(centre, dtype=np.int64)), "i int, j int, s string")
    d = len(sums)
    b = np.zeros((d, d), dtype=object)
    rest = [s - n * r for s, r in zip(sums, centre)]
    for r in products.groupBy("i", "j").agg(_exact_sum("s")).collect():  # d (d + 1) / 2 rows
        i, j = r["i"], r["j"]
        b[i, j] = b[j, i] = n * int(r["s"]) - rest[i] * rest[j]
    return n, sums, b


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide for all n below 3.3e14."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        y = pow(base, odd, n)
        if base % n == 0 or y in (1, n - 1):
            continue
        for _ in range(twos - 1):
            y = y * y % n
            if y == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes just below 2^31 whose product has more than ``bits`` bits."""
    found, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inverse modulo primes, by powers."""
    out, power, rest = np.ones_like(a), a % p, p - 2
    while rest.any():
        out = np.where(rest & 1, out * power % p, out)
        power, rest = power * power % p, rest >> 1
    return out


def characteristic_mod(b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients (from x^0) of det(x - B) modulo each prime: (primes, d + 1).

    All primes are handled together. B becomes Hessenberg by similarity steps; the polynomials of
    its leading blocks follow by recurrence.
    """
    d, every = len(b), np.arange(len(p))
    h = np.stack([(b % int(q)).astype(np.int64) for q in p])
    q = p.astype(np.int64)
    for k in range(1, d - 1):
        pivot = k + (h[:, k:, k - 1] != 0).argmax(axis=1)
        rows = h[every, k].copy()
        h[every, k] = h[every, pivot]
        h[every, pivot] = rows
        columns = h[every, :, k].copy()
        h[every, :, k] = h[every, :, pivot]
        h[every, :, pivot] = columns
        factor = h[:, k + 1 :, k - 1] * _inverse(h[:, k, k - 1], q)[:, None] % q[:, None]  # 0 where no pivot
        h[:, k + 1 :] = (h[:, k + 1 :] - factor[:, :, None] * h[:, k, None, :] % q[:, None, None]) % q[:, None, None]
        moved = np.zeros_like(h[:, :, k])
        for j in range(d - k - 1):
            moved = (moved + h[:, :, k + 1 + j] * factor[:, None, j]) % q[:, None]
        h[:, :, k] = (h[:, :, k] + moved) % q[:, None]
    poly = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        poly[k, :, 1:] = poly[k - 1, :, :-1]
        poly[k] -= h[:, k - 1, k - 1, None] * poly[k - 1] % q[:, None]
        below = np.ones(len(p), dtype=np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % q
            poly[k] -= (h[:, k - i - 1, k - 1] * below % q)[:, None] * poly[k - i - 1] % q[:, None]
        poly[k] %= q[:, None]
    return poly[d]


def characteristic(spark: SparkSession, b: np.ndarray, per_task: int = 8) -> list[int]:
    """Coefficients of det(x - B), from x^0, by Chinese remainders over tasks of ``per_task`` primes."""
    d = len(b)
    row = max(sum(abs(v) for v in r) for r in b.tolist())  # bounds every eigenvalue
    chosen = primes(d + d * max(1, row).bit_length() + 2)  # |coefficient| <= 2^d row^d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            for first in range(0, len(p), per_task):
                part = p[first : first + per_task]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(list(characteristic_mod(b, part)), pa.list_(pa.int64()))], names=["p", "residues"]
                )

    tasks = max(1, -(-len(chosen) // per_task))
    table = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks)
    found = {r["p"]: r["residues"] for r in table.mapInArrow(run, "p long, residues array<long>").collect()}
    product = 1
    for p in chosen:
        product *= p
    total = [0] * (d + 1)
    for p in chosen:
        others = product // p
        share = others * pow(others, -1, p)
        for i, residue in enumerate(found[p]):
            total[i] += residue * share
    half = product // 2
    return [(t + half) % product - half for t in total]


def _shifted(coefficients: list[int], point: int) -> list[int]:
    """Coefficients of p(x + point), from x^0."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += point * c[j + 1]
    return c


def _above(coefficients: list[int], point: int) -> int:
    """Roots above the point, for a polynomial with real roots only: sign changes after the shift."""
    signs = [c > 0 for c in _shifted(coefficients, point) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(coefficients: list[int], point: int) -> int:
    total = 0
    for c in reversed(coefficients):
        total = total * point + c
    return total


def largest_roots(coefficients: list[int], k: int, precision: int = PRECISION) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots, at least ``k`` with multiplicity if there are.

    Points are integers after scaling the polynomial's argument by 2^precision (relative to the
    largest root), so a root is known to that many bits; what bisection cannot part is one root.
    """
    zero = next(i for i, c in enumerate(coefficients) if c)
    c = coefficients[zero:]  # the root at zero goes
    d = len(c) - 1
    if d <= 0:
        return []
    top = -c[-2]  # the trace bounds the largest root
    shift = max(0, precision - top.bit_length() + 8)
    c = [v << shift * (d - i) for i, v in enumerate(c)]
    fine = max(1, (top << shift) >> precision)
    out: list[tuple[Fraction, int]] = []
    wanted = min(k, d)
    work = [(0, (top << shift) + 1, d, 0)]  # roots in (low, high], roots above
    while work and sum(m for _, m in out) < wanted:
        low, high, n, over = work.pop()
        if n == 1:
            at_high = _value(c, high)
            sign, low = at_high > 0, low if at_high else high
            while high - low > fine:
                middle = (low + high) // 2
                value = _value(c, middle)
                if value == 0:
                    low = high = middle
                elif (value > 0) == sign:
                    high = middle
                else:
                    low = middle
            out.append((Fraction(low + high, 2 << shift), 1))
        elif high - low <= fine:
            out.append((Fraction(low + high, 2 << shift), n))
        else:
            middle = (low + high) // 2
            more = _above(c, middle) - over
            if n - more:
                work.append((low, middle, n - more, over + more))
            if more:
                work.append((middle, high, more, over))  # the larger roots first
    return out


def components(b: np.ndarray, roots: list[tuple[Fraction, int]]) -> list[tuple[Fraction, np.ndarray]]:
    """(eigenvalue, unit vector) of every root, clusters with an orthonormal basis of their null space."""
    d = len(b)
    scale = max(abs(int(v)) for v in b.ravel()) or 1
    unit = np.array([[float(Fraction(int(v), scale)) for v in r] for r in b.tolist()])
    wide = np.array([[np.longdouble(int(v)) / np.longdouble(scale) for v in r] for r in b.tolist()])
    rng = np.random.default_rng(12)
    groups: list[list[Fraction]] = []
    for e, n in roots:
        near = groups and float((groups[-1][-1] - e) / groups[0][0]) < _CLOSE
        (groups[-1] if near else groups.append([]) or groups[-1]).extend([e] * n)
    out = []
    for group in groups:
        e = float(sum(group) / len(group) / scale)
        v = np.linalg.qr(rng.standard_normal((d, len(group))))[0]
        shift = np.eye(d) * (e * (1 + 2.0**-50))  # beside the root, so the system has a solution
        for _ in range(4):
            v = np.linalg.qr(_solved(unit - shift, v))[0]
        if len(group) == 1:
            v = _corrected(unit, wide, group[0] / scale, v[:, 0])[:, None]
        out += [(root, v[:, i]) for i, root in enumerate(group)]
    return out


def _solved(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, v)
    except np.linalg.LinAlgError:  # exactly singular: any tiny move of the shift will do
        return np.linalg.solve(a + np.eye(len(a)) * 2.0**-48 * max(1e-300, np.abs(a).max()), v)


def _corrected(unit: np.ndarray, wide: np.ndarray, root: Fraction, v: np.ndarray) -> np.ndarray:
    """Newton steps on (B - e) v = 0, |v| = 1, the residual in extended precision."""
    d = len(v)
    high = np.longdouble(float(root))
    low = np.longdouble(float(root - Fraction(float(root))))
    v = v.astype(np.longdouble)
    for _ in range(3):
        v /= np.sqrt((v * v).sum())
        residual = (wide @ v - high * v) - low * v
        bordered = np.zeros((d + 1, d + 1))
        bordered[:d, :d] = unit - np.eye(d) * float(root)
        bordered[:d, d] = bordered[d, :d] = v.astype(np.float64)
        step = _solved(bordered, np.append(residual, 0).astype(np.float64))
        v = v - step[:d]
    return (v / np.sqrt((v * v).sum())).astype(np.float64)


class Whitening:
    """Fitted transform: whitened = ((n x - S) / n) projected on the components, over sqrt(e)."""

    def __init__(self, n: int, sums: list[int], b: np.ndarray, found: list[tuple[Fraction, np.ndarray]]) -> None:
        square = n * n
        trace = sum(int(b[i, i]) for i in range(len(b)))
        self.n, self.sums = n, np.array(sums, dtype=object)
        self.values = [float(e / square) for e, _ in found]
        self.explained = [float(e / trace) for e, _ in found]
        self.projection = np.stack([v / np.sqrt(e) for (_, v), e in zip(found, self.values)], axis=1)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; raises beyond 64 bits."""
        if max(int(np.abs(x).max(initial=0)) * self.n, *(abs(int(s)) for s in self.sums)) < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        y = x.astype(object) * self.n - self.sums
        return y

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(deviations, whitened)."""
        y = self.centred(x)
        size = np.abs(y).max(initial=0)
        if int(size) ** 2 * y.shape[1] >= 1 << 63:
            y = y.astype(object)
        deviation = (y * y).sum(axis=1)
        if len(deviation) and int(deviation.max()) >= 1 << 63:
            raise OverflowError("a deviation leaves the range of 64 bits")
        return deviation.astype(np.int64), (y.astype(np.float64) / self.n) @ self.projection


def fit(spark: SparkSession, rows: DataFrame, k: int) -> Whitening | None:
    """Transform of the first ``k`` components of ``rows`` (vec_id, x); None without spread."""
    n, sums, b = scatter(rows)
    if not n:
        return None
    found = components(b, largest_roots(characteristic(spark, b), k))[:k]
    return Whitening(n, sums, b, found) if found else None


_ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                deviation, whitened = model.apply(_matrix(part.column("x")))
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n)),
                        pa.array(np.repeat(deviation, k)),
                        pa.array(whitened.ravel()),
                        pa.array(np.tile(model.explained, rows)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return run


def _moments(model: Whitening, centre: np.ndarray):
    """(i, j, sum) of the whitened rows' products around ``centre``; i = -1 for their plain sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        sums, products, rows = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                _, w = model.apply(_matrix(batch.column("x").slice(first, 1024)))
                w = w - centre
                sums, products, rows = sums + w.sum(axis=0), products + w.T @ w, rows + len(w)
        if rows:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(k, -1), i]).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k), j]).astype(np.int32)),
                    pa.array(np.concatenate([sums, products[i, j]])),
                ],
                names=["i", "j", "s"],
            )

    return run


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k, n = len(model.values), model.n

    def summed(centre: np.ndarray) -> dict[tuple[int, int], float]:
        part = rows.select("x").mapInArrow(_moments(model, centre), "i int, j int, s double")
        return {(r["i"], r["j"]): r["s"] for r in part.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}

    found = summed(np.zeros(k))
    mean = np.array([found[-1, i] / n for i in range(k)])
    found = summed(mean)
    left = np.array([found[-1, i] / n for i in range(k)])  # rounding of the mean
    return max(abs(found[i, j] / n - left[i] * left[j] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(
    rows: DataFrame, k: int = 32, scale: int = 64, offset: int = 1_000_000,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining row."""
    spark = rows.sparkSession
    x = stored(integers(rows, scale, offset, id_col, vector_col), "integer-vectors")
    model = fit(spark, x, k)
    if model is None:
        return spark.createDataFrame([], _ROW + ", identity_error double")
    error = identity_error(x, model)
    return x.mapInArrow(_whitened(model), _ROW).withColumn("identity_error", F.lit(error))
