"""Whitening of embeddings: exact distributed covariance, float32 eigenvectors, mixed-precision refinement.

1. An entry c becomes the whole number u = floor(1024 * c); x = u + 100000. Spark adds up u per dimension, then the products
   of z = u - round(mean u). Both sums are exact: products are taken in float64 in slices small enough not to
   round, larger entries in two halves, and Spark adds them as decimals. What is left of the mean is taken off as
   a fraction, so the covariance is the correctly centred one.
2. The d x d covariance goes to the driver (its size depends on the dimension alone). Its eigenvectors in float32 are
   corrected by Ogita-Aishima iterations (matrix products only) in float64, then in extended precision. Eigenvalues
   that lie within the error bound of an iteration form a cluster; its vectors are turned by the eigenvectors of the cluster's
   own small, shifted matrix, solved the same way.
3. The vectors are read again, centred exactly and projected; co-moments of what was projected give the identity error.

Null vectors and vectors with null, NaN or infinite entries are left out. Shorter vectors count as 0 in the dimensions they
lack (an empty vector in all). u stays within +-2**40. Null ids and repeated rows are kept, each with its own
rows. Components whose variance is zero to the precision have whitened null. `deviation` is null where it passes a
long. Equal eigenvalues: any orthonormal basis. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SHIFT = 100_000
# u is held within this bound
BOUND = 2.0**40
# half of the bits of a large entry
HALF = 2.0**21
# whole numbers up to this are exact in float64
EXACT = 2.0**53


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows whose vector counts."""
    v = vectors[vec_col].cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad)


def scaled(column: pa.Array, d: int | None = None) -> np.ndarray:
    """The u of a batch as rows x d (d: the longest of the batch unless given), as whole float64 numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    u = np.clip(np.floor(1024.0 * flat), -BOUND, BOUND)
    d = int(lengths.max(initial=0)) if d is None else d
    if (lengths == d).all():
        return u.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d))
    out[np.arange(d) < lengths[:, None]] = u
    return out


def _exact_product(z: np.ndarray) -> np.ndarray:
    """z.T @ z of whole numbers, as Python integers."""
    d = z.shape[1]
    total = np.zeros((d, d), object)
    top = float(np.abs(z).max(initial=0.0))
    if top < HALF:
        step = max(1, int(EXACT // max(top * top, 1.0)))
        for i in range(0, len(z), step):
            part = z[i : i + step]
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    high = np.round(z / HALF)
    low = z - high * HALF
    for i in range(0, len(z), 1024):
        h, w = high[i : i + 1024], low[i : i + 1024]
        cross = (h.T @ w).astype(np.int64).astype(object)
        total += ((h.T @ h).astype(np.int64).astype(object) * 2**42) + (cross + cross.T) * 2**21 + (w.T @ w).astype(np.int64).astype(object)
    return total


def _added(i: np.ndarray, j: np.ndarray, values: list[int]) -> pa.RecordBatch:
    amounts = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), amounts], ["i", "j", "amount"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (-1, -1, rows) and the sum of u of each dimension as (i, -1, sum)."""
    n, totals = 0, np.zeros(0, object)
    for batch in batches:
        u = scaled(batch.column("v"))
        n += len(u)
        part = u.astype(np.int64).sum(axis=0).astype(object)
        if len(part) > len(totals):
            part, totals = totals, part
        totals[: len(part)] += part
    if n:
        yield _added(np.arange(-1, len(totals)), np.full(len(totals) + 1, -1), [n, *totals])


ADDED = "i int, j int, amount decimal(38,0)"


def _total(df: DataFrame) -> dict[tuple[int, int], int]:
    """The added amounts; as many rows as pairs of dimensions."""
    rows = df.groupBy("i", "j").agg(F.sum("amount").alias("amount")).collect()
    return {(r.i, r.j): int(r.amount) for r in rows}


@dataclass(frozen=True)
class Moments:
    n: int
    sums: list[int]  # of u, per dimension
    covariance: list[list[Fraction]]  # of x, as of u


def moments(rows: DataFrame) -> Moments:
    """Exact sums and covariance of the `usable` rows, in two passes."""
    first = _total(rows.select("v").mapInArrow(_sums, ADDED))
    n = first.pop((-1, -1), 0)
    d = len(first)
    sums = [first[i, -1] for i in range(d)]
    centre = [round(Fraction(s, n)) for s in sums]
    shift = np.array(centre, float)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = _exact_product(scaled(batch.column("v"), d) - shift)
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(d)
            yield _added(i, j, list(total[i, j]))

    found = _total(rows.select("v").mapInArrow(products, ADDED)) if d else {}
    rest = [s - n * c for s, c in zip(sums, centre)]
    covariance = [[Fraction(n * found[min(i, j), max(i, j)] - rest[i] * rest[j], n * n) for j in range(d)] for i in range(d)]
    return Moments(n, sums, covariance)


def _refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: (vectors, values, gap below which values are not told apart, largest correction)."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    gap = 2 * (np.sqrt((off * off).sum()) + np.abs(values).max() * np.sqrt((r * r).sum()))
    apart = values[None, :] - values[:, None]
    told = np.abs(apart) > gap
    e = np.where(told, (s + values[None, :] * r) / np.where(told, apart, 1), r / 2)
    return x + x @ e, values, float(gap), float(np.abs(e).max())


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Index sets of two or more values whose neighbours lie within `gap`."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigenpairs(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a symmetric matrix, from float32 eigenvectors refined in the precision of `a`.

    Clusters are turned by `eigenpairs` of their own shifted matrix; a cluster without width keeps its basis.
    """
    scale = np.abs(a).max(initial=0)
    if len(a) < 2 or scale == 0:
        return np.diag(a).copy(), np.eye(len(a), dtype=a.dtype)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    for kind in (np.float64, a.dtype):
        b, x = a.astype(kind), x.astype(kind)
        tiny, last = len(a) * np.finfo(kind).eps, np.inf
        for _ in range(12):
            x, values, gap, change = _refine(b, x)
            for c in _clusters(values, gap):
                own = x[:, c]
                middle = values[c].mean()
                small = own.T @ (b @ own) - middle * (own.T @ own)
                small = (small + small.T) / 2
                if np.abs(small).max() <= 8 * tiny:
                    continue
                # the shift takes the common part off, so the small matrix tells its values apart
                turn = eigenpairs(small, depth + 1)[1] if depth < 6 else np.linalg.eigh(small.astype(np.float64))[1]
                x[:, c] = own @ turn.astype(kind)
                rest = turn - np.diag(np.diag(turn))
                # as good as turned already: what is left is below the cluster's own precision
                change = max(change, float(min(np.abs(rest).max(), np.abs(small).max())))
            if change <= tiny or (change >= last and change < 1e-3):
                break
            last = change
    # what is left of the cluster turns' rounding: back to orthonormal columns
    for _ in range(8):
        r = np.eye(len(a), dtype=a.dtype) - x.T @ x
        x = x + x @ (r / 2)
        if np.abs(r).max() <= tiny:
            break
    return np.einsum("ij,ij->j", x, a @ x) * scale, x


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: np.ndarray  # falling
    components: np.ndarray  # unit vectors as columns
    shares: np.ndarray  # of the trace
    kept: np.ndarray  # variance above zero


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening:
    """The first k components of the `usable` rows."""
    m = moments(rows)
    d = len(m.sums)
    a = np.zeros((d, d), np.longdouble)
    for i in range(d):
        for j in range(i + 1):
            v = m.covariance[i][j]
            high = float(v)
            a[i, j] = a[j, i] = np.longdouble(high) + np.longdouble(float(v - Fraction(high)))
    values, x = eigenpairs(a)
    order = np.argsort(-values, kind="stable")[:k]
    values, x = values[order], x[:, order]
    trace = np.longdouble(float(sum(m.covariance[i][i] for i in range(d))))
    # either sign is right; the largest entry is made positive, so that reruns agree
    lead = x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] if d else np.ones(0)
    kept = values > trace * d * np.longdouble(1e-17)
    shares = np.where(trace > 0, values / (trace if trace > 0 else 1), 0).astype(float)
    return Whitening(m, values.astype(float), (x * np.where(lead < 0, -1, 1)).astype(float), np.clip(shares, 0, 1), kept)


def _projected(u: np.ndarray, n: int, sums: list[int], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whitened, deviations as integers, which deviations fit a long) of a batch of u."""
    largest = max([abs(s) for s in sums], default=0) + n * (int(np.abs(u).max(initial=0)) + 1)
    exact = np.int64 if largest < 2**62 else object
    y = u.astype(np.int64).astype(exact) * n - np.array(sums, exact)[None, :]
    top = int(np.abs(y).max()) if y.size else 0
    if y.shape[1] * top * top < 2**63:
        y = y.astype(np.int64)
        deviation, fits = (y * y).sum(axis=1), np.ones(len(u), bool)
    else:
        whole = (y.astype(object) ** 2).sum(axis=1)
        fits = np.array([w < 2**63 for w in whole], bool)
        deviation = np.array([w if f else 0 for w, f in zip(whole, fits)], np.int64)
    # whole numbers above 2**53 round once before the division, as one division of integers may not in numpy
    centred = (y / n).astype(float)
    return centred @ matrix, deviation, fits


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vec_col)
    w = fit(rows, k)
    n, sums = w.moments.n, w.moments.sums
    d, count = len(sums), len(w.values)
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    good = np.flatnonzero(w.kept)
    matrix = np.zeros((d, count))
    matrix[:, good] = w.components[:, good] / np.sqrt(w.values[good])

    def comoments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per batch: rows, sums, products about the batch's mean, and the mean's own share
        for batch in batches:
            y = _projected(scaled(batch.column("v"), d), n, sums, matrix)[0]
            if not len(y):
                continue
            mean = y.mean(axis=0)
            product = (y - mean).T @ (y - mean) + len(y) * np.outer(mean, mean)
            i, j = (g.ravel() for g in np.indices((count, count)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.full(count, -1), i], pa.int32()), pa.array(np.r_[np.arange(count), j], pa.int32()), pa.array(np.r_[y.sum(axis=0), product.ravel()])],
                ["i", "j", "amount"],
            )

    found = rows.select("v").mapInArrow(comoments, "i int, j int, amount double").groupBy("i", "j").agg(F.sum("amount").alias("a")).collect()
    at = {(r.i, r.j): r.a / n for r in found}  # k * (k + 1) rows
    spread = [abs(at[i, j] - at[-1, i] * at[-1, j] - (i == j)) for i in good.tolist() for j in good.tolist()]
    error = max(spread, default=0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, deviation, fits = _projected(scaled(batch.column("v"), d), n, sums, matrix)
            m = len(y)
            each = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n, np.int64)),
                    pa.array(deviation[each], mask=~fits[each]),
                    pa.array(y.ravel(), mask=~np.tile(w.kept, m)),
                    pa.array(np.tile(w.shares, m)),
                    pa.array(np.full(m * count, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
