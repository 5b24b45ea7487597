"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Vectors become integers, so the scatter matrix n * sum(x x') - S S' is exact. Its characteristic polynomial comes from
Hessenberg forms modulo many primes (Spark tasks, one batch of primes each) and Chinese remaindering; the largest roots are
isolated by exact sign counts, and each component is the null space of scatter minus root, by inverse iteration in long decimals.
What passes through the driver is bounded by the dimension of the vectors, never by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, session_of

SCALE, SHIFT = 1024, 100_000
#: Larger entries than this count as this.
LARGEST = 2.0**62
LIMBS, LIMB_BITS = 6, 32
#: Bits to which a root is isolated, relative to itself, and decimal digits of the null space beyond those of the matrix.
ROOT_BITS, DIGITS = 110, 80
PRIMES_AT_ONCE = 8


@dataclass
class Whitening:
    """n vectors of so many dims with the sums of their shifted entries, components as columns, roots of the scatter matrix."""

    n: int
    dims: int
    sums: list[int]
    components: np.ndarray
    roots: list[float]
    explained: list[float]


def finite_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of rows whose vector is not null and holds only finite numbers."""
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))


def common_size(rows: DataFrame) -> int:
    """The most common number of dimensions above zero (the least of equals); 0 where there is none."""
    first = rows.groupBy(F.size("v").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 c) of a batch's vectors, without the shift, which no covariance sees."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    return np.clip(flat, -LARGEST, LARGEST).astype(np.int64).reshape(-1, dims)


def product(x: np.ndarray, largest: int) -> np.ndarray:
    """x' x, exact: by floats while all sums fit their 53 bits, else by longs, else by Python's integers."""
    bound = len(x) * largest * largest
    if bound < 2**53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if bound >= 2**62:
        x = x.astype(object)
    return x.T @ x


def partial_sums(rows: DataFrame, dims: int) -> DataFrame:
    """(i, j, l0…) sums of x_i x_j for i <= j, of x_j (i = -1) and of 1 (i = j = -1), in limbs; one set for each task."""
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bound = 0, 0
        total, held = np.zeros((dims + 1, dims), object), np.zeros((dims + 1, dims), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column("v"), dims)
            n += len(x)
            largest = int(np.abs(x).max()) + 1
            more = len(x) * largest * largest
            if bound + more >= 2**62:
                total, held, bound = total + held.astype(object), np.zeros_like(held), 0
            if more >= 2**62:
                total[:dims] += product(x, largest)
                total[dims] += x.astype(object).sum(axis=0)
            else:
                held[:dims] += product(x, largest)
                held[dims] += x.sum(axis=0)
                bound += more
        if n:
            total = total + held.astype(object)
            i, j = np.triu_indices(dims)
            values = np.concatenate([[n], total[dims], total[i, j]])
            places = [np.concatenate([[-1] * (dims + 1), i]), np.concatenate([[-1], np.arange(dims), j])]
            mask = (1 << LIMB_BITS) - 1
            limbs = [((values >> LIMB_BITS * k) & mask if k < LIMBS - 1 else values >> LIMB_BITS * k).astype(np.int64) for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.int32()) for p in places), *map(pa.array, limbs)], names=["i", "j", *names])

    return rows.select("v").mapInArrow(run, "i int, j int, " + ", ".join(f"{x} long" for x in names))


def exact_sums(rows: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and sums of products over all vectors."""
    names = [f"l{k}" for k in range(LIMBS)]
    found = partial_sums(rows, dims).groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in names]).collect()
    value = {(r["i"], r["j"]): sum(r[x] << LIMB_BITS * k for k, x in enumerate(names)) for r in found}
    n = value.get((-1, -1), 0)
    products = [[value.get((min(i, j), max(i, j)), 0) for j in range(dims)] for i in range(dims)]
    return n, [value.get((-1, j), 0) for j in range(dims)], products


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide it for all numbers below 2^32."""
    if n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 7, 61):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the largest, until their product is above the bound."""
    found, whole, p = [], 1, 2**31 - 1
    while whole <= bound:
        if is_prime(p):
            found.append(p)
            whole *= p
        p -= 2
    return found


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix modulo p, similar to a, that is zero below its first subdiagonal."""
    a = a.copy()
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            a[[k + 1, r]] = a[[r, k + 1]]
            a[:, [k + 1, r]] = a[:, [r, k + 1]]
        times = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - times[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * times % p).sum(axis=1)) % p
    return a


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, from the constant on, of det(x - a) modulo p."""
    h, n = hessenberg(a, p), len(a)
    q = np.zeros((n + 1, n + 1), np.int64)
    q[0, 0] = 1
    for k in range(1, n + 1):
        way, t = np.zeros(k, np.int64), 1
        way[k - 1] = h[k - 1, k - 1]
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            if not t:
                break
            way[i - 1] = int(h[i - 1, k - 1]) * t % p
        q[k, 1:] = q[k - 1, :-1]
        q[k] = (q[k] - (way[:, None] * q[:k] % p).sum(axis=0)) % p
    return q[n]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from the constant on, of det(x - matrix) for a positive semidefinite matrix of integers. Primes are
    dealt to tasks; what comes back is one row of residues for each prime."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # The k-th coefficient is a sum of products of k roots, at most what equal roots would give.
    primes = primes_beyond(2 * max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                a = np.array([[x % p for x in row] for row in matrix], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_modulo(a, p).tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = -(-len(primes) // PRIMES_AT_ONCE)
    todo = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks, "p")
    found = sorted(todo.mapInArrow(run, "p long, c array<long>").collect())
    whole, coefficients = 1, [0] * (d + 1)
    for p, residues in found:
        inverse = pow(whole % p, -1, p)
        coefficients = [c + whole * ((r - c) * inverse % p) for c, r in zip(coefficients, residues, strict=True)]
        whole *= p
    return [c - whole if 2 * c > whole else c for c in coefficients]


def roots_above(poly: list[int], at: int) -> int:
    """How many roots lie above a number, of a polynomial whose roots are all real: exactly the changes of sign among the
    coefficients of poly(at + t)."""
    c = poly[::-1]
    for last in range(len(c) - 1, 0, -1):
        for i in range(1, last + 1):
            c[i] += at * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int, guess: float, largest: float) -> tuple[int, int, int, int]:
    """(lo, bits, first, count): the k-th largest root, which is above zero, lies in (lo, lo + 1] / 2^bits, and so do `count`
    roots, of which the first has that number. The guess only sets where the search begins."""
    bits = ROOT_BITS - int(np.floor(np.log2(max(guess, largest * 2.0**-60))))
    while True:
        scaled = [c << max(bits, 0) * (len(poly) - 1 - i) for i, c in enumerate(poly)]
        unit = 1 << max(bits, 0)
        step = max(int(largest * 2.0**-40 * unit), 1)
        lo = hi = max(int(max(guess, 0.0) * unit), 0)
        while roots_above(scaled, hi) >= k:
            hi, step = hi + step, step * 2
        while lo > 0 and roots_above(scaled, lo) < k:
            lo, step = max(lo - step, 0), step * 2
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if roots_above(scaled, mid) >= k else (lo, mid)
        if lo > 0:
            above = roots_above(scaled, hi)
            return lo, max(bits, 0), above + 1, roots_above(scaled, lo) - above
        bits += 2 * ROOT_BITS


def null_space(matrix: list[list[int]], root: Decimal, count: int) -> np.ndarray:
    """`count` orthogonal unit vectors, as rows of decimals, that matrix - root sends next to zero, by inverse iteration."""
    d = len(matrix)
    a = np.array([[Decimal(x) for x in row] for row in matrix], object)
    size = max(abs(x) for x in a.flat)
    for i in range(d):
        a[i, i] -= root
    order = list(range(d))
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, r]] = a[[r, k]]
        order[k], order[r] = order[r], order[k]
        if not a[k, k]:
            a[k, k] = size.scaleb(-DIGITS)
        if k + 1 < d:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])
    rng = np.random.default_rng(d)
    found = [np.array([Decimal(float(x)) for x in rng.standard_normal(d)], object) for _ in range(count)]
    for _ in range(4):
        kept = []
        for v in found:
            z = v[order].copy()
            for k in range(d - 1):
                z[k + 1 :] -= a[k + 1 :, k] * z[k]
            for k in range(d - 1, -1, -1):
                z[k] = z[k] / a[k, k]
                z[:k] -= a[:k, k] * z[k]
            for _ in range(2):
                for u in kept:
                    z = z - (u @ z) * u
                z = z / (z @ z).sqrt()
            kept.append(z)
        found = kept
    return np.array(found, object)


def components(spark, matrix: list[list[int]], poly: list[int], wanted: int) -> list[tuple[float, list[float]]]:
    """(root, unit vector) of the largest roots, one task for each."""
    guesses = np.linalg.eigvalsh(np.array([[float(x) for x in row] for row in matrix]))[::-1].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                lo, bits, first, count = isolate(poly, k, guesses[k - 1], guesses[0])
                with localcontext() as c:
                    c.prec = DIGITS + max(len(str(abs(x))) for row in matrix for x in row)
                    root = Decimal(2 * lo + 1) / Decimal(2 << bits)
                    v = [float(x) for x in null_space(matrix, root, count)[k - first]]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([float(root)]), pa.array([v], pa.list_(pa.float64()))], names=["k", "root", "v"])

    todo = spark.range(1, wanted + 1, 1, wanted)
    return [(r["root"], r["v"]) for r in sorted(todo.mapInArrow(run, "k long, root double, v array<double>").collect())]


def fit(df: DataFrame, wanted: int = 8) -> Whitening | None:
    """The whitening of (vec_id, embedding) rows; None where no vector is left. Rows without a finite vector are left out, and
    so are vectors that have not the most common number of dimensions. Repeated rows count each time. Components without
    variance, whose whitening is not defined, are not among the wanted ones."""
    spark = session_of(df)
    rows = finite_vectors(df)
    if not (dims := common_size(rows)):
        return None
    n, sums, products = exact_sums(rows.filter(F.size("v") == dims), dims)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    trace = sum(scatter[i][i] for i in range(dims))
    found = []
    if trace:
        poly = characteristic_polynomial(spark, scatter)
        rank = dims - next(i for i, c in enumerate(poly) if c)
        found = components(spark, scatter, poly, min(wanted, rank))
    return Whitening(n, dims, sums, np.array([v for _, v in found]).T, [r for r, _ in found], [r / trace for r, _ in found])


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n x - S, exact: longs, or Python's integers where those could overflow."""
    if len(x) and model.n * (int(np.abs(x).max()) + 1) >= 2**61:
        x = x.astype(object)
        return x * model.n - np.array(model.sums, object)
    return x * model.n - np.array(model.sums, np.int64)


def project(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened values: the mean and 1/n cancel against the roots, which are n^2 times the eigenvalues of the covariance."""
    return y.astype(np.float64) @ model.components / np.sqrt(model.roots)


def deviations(y: np.ndarray) -> list[int]:
    """Sums of squares of rows, exact."""
    if y.dtype != object and len(y) and (int(np.abs(y).max()) + 1) ** 2 * y.shape[1] < 2**63:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of |covariance of whitened values - identity|. Each task centres its rows at their own mean; the
    tasks' sums are joined at the mean of all."""
    width = len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, squares = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            if not b.num_rows:
                continue
            w = project(centred(integers(b.column("v"), model.dims), model), model)
            own = w.mean(axis=0)
            apart, m = own - mean, n + len(w)
            squares += (w - own).T @ (w - own) + np.outer(apart, apart) * n * len(w) / m
            mean, n = mean + apart * len(w) / m, m
        if n:
            k, other = (x.ravel() for x in np.indices((width, width)))
            values = [k, other, np.full(len(k), n), mean[k], mean[other], squares.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["k", "o", "n", "mk", "mo", "m2"])

    parts = saved(rows.select("v").mapInArrow(run, "k long, o long, n long, mk double, mo double, m2 double"))
    means = parts.filter("k = o").groupBy("k").agg((F.sum(F.col("n") * F.col("mk")) / F.sum("n")).alias("mean"))
    of = F.create_map(*[F.lit(x) for r in means.collect() for x in (r["k"], r["mean"])])
    apart = (F.col("mk") - of[F.col("k")]) * (F.col("mo") - of[F.col("o")])
    entries = parts.groupBy("k", "o").agg((F.sum(F.col("m2") + F.col("n") * apart) / F.sum("n")).alias("c"))
    return entries.agg(F.max(F.abs(F.col("c") - (F.col("k") == F.col("o")).cast("double")))).first()[0]


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whitened(df: DataFrame, wanted: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): one row for each vector that
    `fit` takes and component. deviation is null where a long can't hold it, deviation_exact beyond 38 digits. Null and
    repeated ids stay; no rows where nothing varies."""
    spark = session_of(df)
    model = fit(df, wanted)
    kind = dict(df.dtypes)["vec_id"]
    if model is None or not model.roots:
        return spark.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    rows = finite_vectors(df).filter(F.size("v") == model.dims)
    error, width = identity_error(rows, model), len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = centred(integers(b.column("v"), model.dims), model)
            far, each = deviations(y), np.repeat(np.arange(len(y)), width)
            most = 10**38
            arrays = [
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1), len(y)), pa.int32()), pa.array(np.full(len(each), model.n)),
                pa.array([x if x < 2**63 else None for x in far], pa.int64()).take(pa.array(each)), pa.array(project(y, model).ravel()),
                pa.array(np.tile(model.explained, len(y))), pa.array(np.full(len(each), error)),
                pa.array([Decimal(x) if x < most else None for x in far], pa.decimal128(38, 0)).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return rows.mapInArrow(run, f"vec_id {kind}, {SCHEMA}")
