"""Embedding whitening by an exact characteristic polynomial.

Entries become integers, so the scatter matrix of the distinct vectors is an exact integer matrix, summed over
tasks. Its characteristic polynomial is computed modulo primes (Hessenberg form, a prime is a row of a Spark
table) and put together by the Chinese remainder theorem. The polynomial has real roots only, so the sign changes
of its shifted coefficients count the roots above a point exactly; the largest are isolated and refined to 256
bits. A root's component is found by inverse iteration in the null space of the shifted matrix, in integers of
twice that length, a root in each row of a Spark table.

The driver holds numbers by dimension only: the matrix, the polynomial and the components, never vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_arrow, map_columns, materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries from here on don't fit the integers.
TOO_LARGE = 2.0**55
#: Bits of the largest root that are known, and of the numbers in inverse iteration.
ROOT_BITS, WORK_BITS = 256, 512
#: Whitened values are rounded to this many binary places where their covariance is measured, so that sums are exact.
PLACES = 30
LIMB, ROWS_EACH = 20, 4096
DIGITS = 10**15


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Add x, array<long>: floor(64 c) + 1000000 of each entry c. Rows whose vector is null or empty, holds null or non-finite
    entries or some of 2^55 or more, or isn't of the commonest length (of equally common ones: the longest) are left out."""
    fits = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < TOO_LARGE, F.lit(False)))  # NaN is greater than all
    whole = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    rows = rows.filter(F.col(column).isNotNull() & (F.size(column) > 0) & fits).withColumn("x", whole)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("x") == (top.d if top else 0))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column))
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """The transpose of an integer matrix times itself, as Python integers: products of short limbs are exact in doubles."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(y), ROWS_EACH):
        rest, limbs = y[at : at + ROWS_EACH], []
        while rest.any():
            low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def exact_sums(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], d: int, products: bool) -> tuple[list[int], list[list[int]] | None]:
    """Sums of the integer vectors that ``make`` gives for a batch, and of their products by pairs of dimensions.

    Each task adds up its own rows; what is collected is a number for each pair of dimensions.
    """
    digits = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("v", T.DecimalType(38, 0))])

    def run(batches):
        plain, square = np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                y = make(batch)
                plain += y.astype(object).sum(0)
                if products:
                    square += exact_gram(y)
        entries = [(i, -1, int(v)) for i, v in enumerate(plain)] + [(i, j, int(square[i, j])) for i in range(d) for j in range(i, d) if products]
        out = []
        for i, j, v in entries:
            k, rest, sign = 0, abs(v), -1 if v < 0 else 1
            while rest:
                rest, digit = divmod(rest, DIGITS)
                out.append((i, j, k, Decimal(sign * digit)))
                k += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)), strict=True)], names=list("ijkv"))

    plain, square = [0] * d, [[0] * d for _ in range(d)]
    for r in map_arrow(rows, run, digits).groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        v = int(r.v) * DIGITS**r.k
        if r.j < 0:
            plain[r.i] += v
        else:
            square[r.i][r.j] += v
            if r.i != r.j:
                square[r.j][r.i] += v
    return plain, square if products else None


def primes_below(limit: int, bits: int) -> list[int]:
    """So many primes under ``limit`` (at most 2^31) that their product has more than ``bits`` bits."""
    found, product, p = [], 1, limit - 1
    while product.bit_length() <= bits + 1:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if p % 2 and all((x := pow(a, odd, p)) in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1)) for a in (2, 3, 5, 7)):
            found.append(p)
            product *= p
        p -= 1
    return found


def characteristic_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - A) modulo p, constant term first, by Hessenberg form."""
    a = matrix.copy()
    d = len(a)
    for m in range(1, d - 1):
        rows = np.flatnonzero(a[m:, m - 1]) + m
        if not len(rows):
            continue
        a[[m, rows[0]]] = a[[rows[0], m]]
        a[:, [m, rows[0]]] = a[:, [rows[0], m]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        polys[m, 1:] = polys[m - 1, :-1]
        polys[m] = (polys[m] - a[m - 1, m - 1] * polys[m - 1]) % p
        product = 1
        for i in range(m - 1, 0, -1):
            product = product * int(a[i, i - 1]) % p
            if not product:
                break
            polys[m] = (polys[m] - int(a[i - 1, m - 1]) * product % p * polys[i - 1]) % p
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - A), constant term first, of a symmetric integer matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The k-th coefficient is at most what d equal roots give.
    bits = max((math.comb(d, k) * trace**k // d**k).bit_length() for k in range(d + 1)) + 1
    primes = primes_below(1 << 31, bits)

    def run(batches):
        whole = np.array(matrix, object)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([characteristic_mod((whole % p).astype(np.int64), p) for p in ps], pa.list_(pa.int64()))], names=["p", "c"])

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 8 * spark.sparkContext.defaultParallelism))
    found = {r.p: r.c for r in map_arrow(table, run, "p long, c array<long>").collect()}  # dimensions x primes
    out, product = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(product, -1, p)
        out = [x + (c - x) * inverse % p * product for x, c in zip(out, found[p], strict=True)]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def _value(poly: list[int], x: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * x + c
    return out


def roots_above(poly: list[int], x: int) -> int:
    """How many roots are greater than x: the sign changes of the coefficients of p(x + t), exact where all roots are real."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += x * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], top: int, k: int) -> list[tuple[int, int]]:
    """(root, multiplicity), falling: the ``k`` largest of a polynomial with real roots in 0..top, rounded up to integers; what
    isn't told apart by then counts as one."""
    out, open_ = [], [(-1, top, len(poly) - 1, 0)]
    while open_:
        low, high, above_low, above_high = open_.pop()
        if above_low == above_high or above_high >= k:
            continue
        if above_low - above_high == 1:
            sign = _value(poly, high)
            while high - low > 1 and sign:
                mid = (low + high) // 2
                v = _value(poly, mid)
                if v == 0 or (v > 0) == (sign > 0):
                    high, sign = mid, v
                else:
                    low = mid
            out.append((high, 1))
        elif high - low == 1:
            out.append((high, above_low - above_high))
        else:
            mid = (low + high) // 2
            n = roots_above(poly, mid)
            open_ += [(low, mid, above_low, n), (mid, high, n, above_high)]
    return out


def null_vectors(matrix: list[list[int]], root: int, multiplicity: int) -> list[list[float]]:
    """Orthogonal unit vectors of the null space of A - root, by inverse iteration with numbers of WORK_BITS."""
    d = len(matrix)
    a = np.array(matrix, object) << (WORK_BITS - ROOT_BITS)
    a[np.arange(d), np.arange(d)] -= root << (WORK_BITS - ROOT_BITS)
    factors, swaps = np.zeros((d, d), object), []
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        swaps.append(best)
        a[[k, best]] = a[[best, k]]
        factors[[k, best]] = factors[[best, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        factors[k + 1 :, k] = (a[k + 1 :, k] << WORK_BITS) // a[k, k]
        a[k + 1 :, k:] -= (factors[k + 1 :, k, None] * a[k, k:]) >> WORK_BITS
    one, found = 1 << WORK_BITS, []

    def unit(v: np.ndarray) -> np.ndarray:
        return (v << WORK_BITS) // max(math.isqrt(int((v * v).sum())), 1)

    for number in range(multiplicity):
        v = unit(np.array([((i + 1) ** 2 * (number + 3) * 7919) % 10007 + 1 for i in range(d)], object) * one)
        for _ in range(3):
            for k, best in enumerate(swaps):
                v[[k, best]] = v[[best, k]]
                v[k + 1 :] -= (factors[k + 1 :, k] * v[k]) >> WORK_BITS
            for k in reversed(range(d)):
                v[k] = (v[k] - ((a[k, k + 1 :] * v[k + 1 :]).sum() >> WORK_BITS)) * one // a[k, k]
            v = unit(v)
            for u in found:
                v = v - ((u * int((u * v).sum() >> WORK_BITS)) >> WORK_BITS)
            v = unit(v)
        found.append(v)
    return [[int(x) / one for x in v * (1 if max(v, key=abs) > 0 else -1)] for v in found]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums by dimension; for each component its vector (by falling variance), variance, share of all
    variance (null where there is none); the largest error of the whitened covariance (null without a component of variance)."""

    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    explained: list[float | None]
    identity_error: float | None = None


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as long integers where they hold it, else as Python's."""
    middle = [s // n for s in sums]
    near = int(max(abs(int(x.max()) - min(middle)), abs(int(x.min()) - max(middle)))) if x.size else 0
    if near < 1 << 62 and n * (near + 1) < 1 << 62:
        return n * (x - np.array(middle, np.int64)) - np.array([s - n * m for s, m in zip(sums, middle, strict=True)], np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _projected(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """Whitened coordinates; null (NaN) where a component has no variance."""
    spread = np.array([math.sqrt(e) if e > 0 else np.nan for e in fit.variances])
    return (_centred(x, fit.n, fit.sums).astype(np.float64) / fit.n) @ np.array(fit.components).T / spread


def fit(distinct: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on a table of distinct integer vectors ``x`` of one length; None if it is empty."""
    spark = distinct.sparkSession
    head = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not head.n:
        return None
    n, d = head.n, head.d
    k = min(k, d)
    sums, _ = exact_sums(distinct, _matrix, d, False)
    _, scatter = exact_sums(distinct, lambda batch: _centred(_matrix(batch), n, sums), d, True)
    scatter = [[v // n for v in row] for row in scatter]  # n^2 times the covariance, whole: all products are multiples of n
    trace = sum(scatter[i][i] for i in range(d))
    shift = max(0, ROOT_BITS - trace.bit_length())
    poly = characteristic_polynomial(spark, scatter)
    roots = largest_roots([c << shift * (d - i) for i, c in enumerate(poly)], trace << shift, k)
    scaled = [[v << shift for v in row] for row in scatter]

    def run(batches):
        for batch in batches:
            for place, root, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([null_vectors(scaled, int(root), m)], pa.list_(pa.list_(pa.float64())))], names=["place", "v"])

    table = spark.createDataFrame([(i, str(r), m) for i, (r, m) in enumerate(roots)], "place long, root string, m long").repartition(len(roots))
    vectors = {r.place: r.v for r in map_arrow(table, run, "place long, v array<array<double>>").collect()}  # k components
    pairs = [(root, v) for i, (root, _) in enumerate(roots) for v in vectors[i]][:k]
    found = Whitening(n, sums, [v for _, v in pairs], [r / (n * n << shift) for r, _ in pairs], [r / (trace << shift) if trace else None for r, _ in pairs])
    m = sum(e > 0 for e in found.variances)
    if not m:
        return found
    plain, square = exact_sums(distinct, lambda batch: np.rint(_projected(_matrix(batch), found)[:, :m] * 2.0**PLACES).astype(np.int64), m, True)
    error = max(abs((n * square[i][j] - plain[i] * plain[j]) / (n * n << 2 * PLACES) - (i == j)) for i in range(m) for j in range(m))
    return Whitening(n, sums, found.components, found.variances, found.explained, error)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Add deviation (long; null beyond its range) and whitened (array<double>, a value for each component; null where it has no
    variance) to rows with an integer vector ``x``. Other columns stay, those of these names are replaced."""

    def work(batch):
        x = _matrix(batch)
        off = _centred(x, model.n, model.sums)
        small = off.dtype != object and (not off.size or int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 63)
        squares = (off if small else off.astype(object)) ** 2
        deviation = [v if v < 1 << 63 else None for v in map(int, squares.sum(1))]
        return [deviation, [[None if math.isnan(v) else v for v in row] for row in _projected(x, model).tolist()]]

    return map_columns(vectors, [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))], lambda: work)


def report(rows: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component.

    See ``integer_vectors`` for the rows that remain and ``whiten`` for nulls. Rows repeat as they do in ``rows``, but the fit
    has each vector once; columns but vec_id and embedding are left out; without a row that remains the result is empty.
    """
    vectors = materialise(integer_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).select("vec_id", "x"), "vectors")
    model = fit(materialise(vectors.select("x").distinct(), "distinct"))
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*[F.lit(v).cast("double") for v in model.explained]), F.col("place") + 1)
    return found.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
