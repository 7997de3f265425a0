"""Whitening of embeddings by principal components, from the exact characteristic polynomial of their integer scatter."""
from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geolattice.session import written

#: Bits of one part of an entry: sums of products of parts over BLOCK rows are exact in doubles.
PART = 21
BLOCK = 1 << 10
#: Bits to which a root is worked out, beyond its first.
PRECISION = 128
#: Sums travel as whole numbers below 2^PIECE each.
PIECE = 60
_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("p0", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64())])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """`vec_id` and `x`, each entry c as floor(scale * c), of the rows whose vector is whole: not null, with no null and no non-finite entry.

    Vectors of several lengths are filled up with zeros to the longest.
    """
    # NaN compares above infinity, so one comparison leaves both out
    whole = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(math.inf), F.lit(False)))
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    rows = vectors.where(F.col(vector_col).isNotNull() & whole).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    least, most = rows.select(F.size("x").alias("n")).agg(F.min("n"), F.max("n")).first()
    if least == most:
        return rows
    return rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))).alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def gram(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of whole numbers, as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        rest, parts = x[at:at + BLOCK], []
        while True:   # x = part + 2^PART * part + ..., the last one signed
            if not len(parts) == 3 and np.abs(rest).max(initial=0) >= 1 << PART or rest.min(initial=0) == np.iinfo(np.int64).min:
                parts.append((rest & ((1 << PART) - 1)).astype(float))
                rest = rest >> PART
            else:
                parts.append(rest.astype(float))
                break
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (PART * (i + j)))
    return total


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of a task's vectors, each with a 1 before it: their number, sums and products at once."""
    total = None
    for batch in batches:
        x = matrix(batch.column("x"))
        part = gram(np.hstack([np.ones((len(x), 1), np.int64), x]))
        total = part if total is None else total + part
    if total is None:
        return
    i, j = np.triu_indices(len(total))
    low = (1 << PIECE) - 1
    values = [total[a, b] for a, b in zip(i, j)]
    pieces = [[v & low for v in values], [v >> PIECE & low for v in values], [v >> 2 * PIECE for v in values]]
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(p, pa.int64()) for p in pieces]], schema=_SUMS)


def scatter(distinct: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and n^2 times the covariance of the vectors `x`, in whole numbers: n * sum(x x') - S S'."""
    parts = distinct.mapInArrow(_scatter, "i int, j int, p0 long, p1 long, p2 long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(F.col(p).cast("decimal(20)")).alias(p) for p in ("p0", "p1", "p2")]).collect()   # (d + 1)(d + 2) / 2 rows
    if not sums:
        return 0, [], np.zeros((0, 0), object)
    d = max(r.j for r in sums)
    q = np.zeros((d + 1, d + 1), object)
    for r in sums:
        q[r.i, r.j] = q[r.j, r.i] = int(r.p0) + (int(r.p1) << PIECE) + (int(r.p2) << 2 * PIECE)
    n, s = q[0, 0], q[0, 1:]
    return n, s.tolist(), n * q[1:, 1:] - np.outer(s, s)


def is_prime(n: int) -> bool:
    """Exact for n below 2^32 (three fixed witnesses are enough there)."""
    if n < 62 or n % 2 == 0:
        return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))
    twos = (n - 1 & 1 - n).bit_length() - 1
    for a in (2, 7, 61):
        x = pow(a, n - 1 >> twos, n)
        if x != 1 and n - 1 not in [x := x if k == 0 else x * x % n for k in range(twos)]:
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2^31, the largest first, whose product has more than `bits` bits."""
    out, p, product = [], (1 << 31) - 1, 0.0
    while product <= bits + 1:
        if is_prime(p):
            out.append(p)
            product += math.log2(p)
        p -= 2
    return out


def charpoly_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - m) modulo p, the lowest first: to Hessenberg form by similar matrices, then Hessenberg's recurrence."""
    h, d = m.copy() % p, len(m)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        i = k + int(below[0])
        if i != k:
            h[[i, k]] = h[[k, i]]
            h[:, [i, k]] = h[:, [k, i]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)     # row k: that of the leading k x k block
    polys[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = polys[k - 1, :-1]
        row -= h[k - 1, k - 1] * polys[k - 1] % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            row -= chain * int(h[k - i - 1, k - 1]) % p * polys[k - i - 1] % p
        polys[k] = row % p
    return polys[d]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of det(t - m), the lowest first, of a whole, symmetric matrix without negative eigenvalues: a prime a task, then Chinese remaindering."""
    d, trace = len(m), int(sum(m.diagonal()))
    # the k-th symmetric function of numbers that are not negative is at most trace^k / k!
    bits = max(k * math.log2(max(trace, 1)) - math.lgamma(k + 1) / math.log(2) for k in range(d + 1))
    chosen = primes(int(bits) + 8)
    text = [[str(v) for v in row] for row in m.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(v) for v in row] for row in text], object)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                p = chosen[i]
                yield pa.RecordBatch.from_pylist([{"prime": p, "poly": charpoly_mod((whole % p).astype(np.int64), p).tolist()}],
                                                 schema=pa.schema([("prime", pa.int64()), ("poly", pa.list_(pa.int64()))]))
    tasks = spark.range(0, len(chosen), 1, min(len(chosen), 4 * spark.sparkContext.defaultParallelism))
    found = tasks.mapInArrow(run, "prime long, poly array<long>").collect()   # a row of d + 1 numbers for each prime
    total, product = [0] * (d + 1), 1
    for r in found:
        inverse = pow(product % r.prime, -1, r.prime)
        total = [t + product * ((c - t) * inverse % r.prime) for t, c in zip(total, r.poly)]
        product *= r.prime
    return [t - product if t > product // 2 else t for t in total]


def _scaled(poly: list[int], s: int) -> list[int]:
    """The polynomial whose roots are 2^s times as large."""
    d = len(poly) - 1
    return [c << s * (d - i) for i, c in enumerate(poly)]


def roots_above(poly: list[int], a: int, s: int = 0) -> int:
    """How many roots, counted as often as they come, are above a / 2^s: as all are real, the changes of sign after moving the origin there."""
    c = _scaled(poly, s)
    d = len(c) - 1
    for k in range(d):
        for i in range(d - 1, k - 1, -1):
            c[i] += a * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _positive(poly: list[int], a: int, s: int) -> bool:
    d, value = len(poly) - 1, 0
    for i in range(d, -1, -1):
        value = value * a + (poly[i] << s * (d - i))
    return value > 0


def top_roots(poly: list[int], count: int) -> list[tuple[Fraction, int]]:
    """The `count` largest positive roots, each as often as it comes, with the number of its group of equal ones, of a polynomial with only real roots.

    Halving keeps, between `low` and `low` + 1 (in steps of 2^-s), as many roots as there are left above; once a root is alone there, the sign tells the halves.
    Roots that PRECISION bits do not tell apart are one root.
    """
    out: list[tuple[Fraction, int]] = []
    positive = roots_above(poly, 0)
    top = 1
    while roots_above(poly, top):
        top *= 2
    while len(out) < min(count, positive):
        have = len(out)
        low, step, s = 0, top, 0    # the next largest root lies in (low, low + step] / 2^s
        above = roots_above(poly, top)
        inside = positive
        while step > 1 or s == 0 or (low >> PRECISION) == 0:
            if step == 1:
                low, step, s = 2 * low, 2, s + 1
            half = low + step // 2
            if inside - above == 1:
                # above a lone root the sign is that of the leading term and of the roots over it
                beyond = _positive(poly, half, s) == (above % 2 == 0)
                n = above if beyond else above + 1
            else:
                n = roots_above(poly, half, s)
            if n > have:
                low, inside = half, n
            else:
                above = n
            step //= 2
            if s > 64 and low == 0 and step == 1 and s > 4 * PRECISION:
                break
        root = Fraction(2 * low + 1, 2 << s)
        out += [(root, have)] * (inside - have)
    return out[:min(count, positive)]


def eigenvector(m: np.ndarray, root: Fraction, earlier: list[list[decimal.Decimal]], seed: int) -> list[decimal.Decimal]:
    """A unit vector of the null space of m - root, by inverse iteration in decimals, at right angles to `earlier` ones of an equal root."""
    d = len(m)
    digits = len(str(int(sum(m.diagonal())))) + PRECISION // 3
    with decimal.localcontext() as ctx:
        ctx.prec = digits + 20
        value = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
        a = [[decimal.Decimal(int(v)) for v in row] for row in m.tolist()]
        for i in range(d):
            a[i][i] -= value
        tiny = max(value, decimal.Decimal(1)).scaleb(-digits)
        order = list(range(d))
        for k in range(d):     # row by row, with the largest pivot
            p = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[p], order[k], order[p] = a[p], a[k], order[p], order[k]
            if not a[k][k]:
                a[k][k] = tiny
            top = a[k]
            for i in range(k + 1, d):
                row = a[i]
                f = row[k] / top[k]
                row[k] = f
                if f:
                    for j in range(k + 1, d):
                        row[j] -= f * top[j]
        start = np.random.default_rng(seed).integers(1, 1000, d)
        v = [decimal.Decimal(int(x)) for x in start]
        for _ in range(4):
            y = [v[i] for i in order]
            for i in range(d):
                y[i] -= sum((a[i][j] * y[j] for j in range(i)), decimal.Decimal(0))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), decimal.Decimal(0))) / a[i][i]
            for e in earlier:
                dot = sum(p * q for p, q in zip(e, y))
                y = [q - dot * p for p, q in zip(e, y)]
            size = sum(q * q for q in y).sqrt()
            v = [q / size for q in y]
        return v


@dataclass
class Whitening:
    """What a fit holds: the number of distinct vectors, their sums, per component its direction over its deviation, and its share of all variance."""
    n: int
    sums: list[int]
    directions: np.ndarray      # d x k
    values: list[float]         # eigenvalues of the covariance
    explained: list[float]
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """n * x - S in whole numbers, and whether they are machine numbers whose squares' sum is one as well."""
        most = self.n * int(np.abs(x.astype(object)).max(initial=0) if x.size and x.min() == np.iinfo(np.int64).min else np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 1 << 62 and most * most * max(1, x.shape[1]) < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64), True
        return self.n * x.astype(object) - np.array(self.sums, object), False

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(float) @ self.directions if len(y) else np.zeros((0, self.directions.shape[1]))


def fit_whitening(rows: DataFrame, components: int = 4) -> Whitening:
    """Components of the distinct vectors `x` of `rows`: the largest eigenvalues of their covariance that are not 0.

    On Spark: the distinct vectors, the exact scatter (partial sums a task, summed by entry) and the polynomial modulo each prime. On the driver: what depends on
    the number of dimensions alone, never on rows.
    """
    distinct = written(rows.select("x").distinct(), "distinct")
    n, sums, m = scatter(distinct)
    trace = int(sum(m.diagonal())) if len(m) else 0
    if not trace:
        return Whitening(n, sums, np.zeros((len(sums), 0)), [], [])
    found = top_roots(characteristic(rows.sparkSession, m), components)
    vectors: list[list[decimal.Decimal]] = []
    for k, (root, group) in enumerate(found):
        vectors.append(eigenvector(m, root, vectors[group:k], k))
    values = [float(root / (n * n)) for root, _ in found]
    directions = np.array([[float(c) for c in v] for v in vectors]).T / np.sqrt(values)
    model = Whitening(n, sums, directions, values, [float(root / trace) for root, _ in found])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found)
        total = np.zeros((k, k))
        for batch in batches:
            z = model.project(model.centred(matrix(batch.column("x")))[0])
            total += z.T @ z
        yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "v": float(total[i, j])} for i in range(k) for j in range(k)], schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))
    for r in distinct.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        model.identity_error = max(model.identity_error, abs(r.v / n - (r.i == r.j)))
    return model


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row per row of `quantised` and component: `vec_id`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    `deviation` is the exact sum of (n * x - S)^2; null where it has more than 38 digits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            y, small = model.centred(matrix(batch.column("x")))
            squares = (y * y).sum(axis=1)
            if small:
                deviation = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([decimal.Decimal(v) if v < 10 ** 38 else None for v in squares.tolist()], pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(len(y)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(len(y) * k, model.n), pa.int64()), deviation.take(at),
                pa.array(model.project(y).ravel()), pa.array(np.tile(model.explained, len(y))), pa.array(np.full(len(y) * k, model.identity_error))], schema=_OUT)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)


def whiten_embeddings(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Whitened coordinates of every whole vector, by the components of the distinct ones.

    Integer scatter, its exact characteristic polynomial (modular Hessenberg reduction, Chinese remaindering), roots by exact counts and
    signs, components by inverse iteration near each root.

    Defined cases: rows whose vector is null, or holds a null, NaN or infinite entry, are left out. Entries beyond a long's range become its ends. Vectors of
    several lengths are filled up with zeros. Repeated rows, ids and null ids are kept; equal vectors count once in the fit. Equal eigenvalues get
    vectors at right angles. A component whose eigenvalue is 0 does not exist: fewer than `components` rows come per vector, none where all vectors are
    equal. An empty table gives an empty table. Other columns, of any name, are not read.

    Scale: one shuffle of quantised vectors (for the distinct ones, combined in the tasks first); everything else is sums of a size
    that depends on the dimensions. Fit and application read the vectors in blocks.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    return whiten(rows, fit_whitening(rows, components))
