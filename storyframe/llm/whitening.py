"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become integers x = floor(scale * c) + shift, so counts, sums and the scatter are exact whatever the partitions.

1. One pass counts the vectors (n) and sums each dimension (S).
2. A second pass centres the vectors by the mean rounded to integers and sums their products; what the rounding left
   behind, at most half a unit, is taken out exactly: n times these sums less the products of the remainders is n * n times
   the covariance V.
3. V = P L L' P' by Cholesky with diagonal pivots, which ends at V's rank. One-sided Jacobi rotations make the columns of the
   triangular factor L orthogonal; V itself is never rotated. The squared norms of the columns are V's eigenvalues, the
   columns over their norms its eigenvectors, with an accuracy that Jacobi on V would not reach for small ones.
4. A third pass whitens the vectors and measures the covariance of the outcome, a fourth returns it.

Only sums come to the driver: one per dimension, and one per pair of dimensions. Each pass adds up within its tasks first.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry take no part. Neither do vectors of another
length than the most frequent one (of several the largest). Repeated rows and ids count each. A null id stays null.
Directions without variance have no component, so a table of fewer than two different vectors gives no rows, nor does an
empty one. Scaled entries beyond 2 ** 50 count as 2 ** 50. A deviation of more than 38 digits is null. Other columns are ignored.
Of equal eigenvalues, any basis of their space is used. A component's largest entry is positive, the first of several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm import _vectors

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
LARGEST = 1 << 50
SWEEPS = 60
_EXACT = 1 << 53


class Sums(NamedTuple):
    """Vectors counted, their mean rounded to integers, and per dimension what the rounded mean leaves of the sum."""

    n: int
    centre: np.ndarray
    rest: list[int]


class Whitening(NamedTuple):
    """Unit components as columns by falling eigenvalue, the eigenvalues, and each one's share of the trace."""

    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def integers(entries: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.clip(np.floor(entries * scale), -LARGEST, LARGEST).astype(np.int64) + shift


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers; in doubles as long as these are exact."""
    if not len(y):
        return np.zeros((y.shape[1], y.shape[1]), object)
    most = int(np.abs(y).max())
    if most * most * len(y) < _EXACT:
        real = y.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    fits = (_EXACT - 1) // (most * most) if most else len(y)
    if fits:
        return sum(exact_products(y[at:at + fits]) for at in range(0, len(y), fits))
    wide = y.astype(object)
    return wide.T @ wide


def _added_up(rows: DataFrame, vector: str, size: int, count: int,
              terms: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Sums over all rows of `count` integer terms of a matrix of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(count, object), False
        for _, matrix in _vectors.matrices(batches, vector, size):
            total, seen = total + terms(matrix), True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(count, dtype=np.int32)),
                 pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["place", "value"])

    found = (rows.select(vector).mapInArrow(run, "place int, value decimal(38,0)").groupBy("place")
             .agg(F.sum("value").alias("value")).collect())
    out = [0] * count
    for row in found:
        out[row["place"]] = int(row["value"])
    return out


def sums(rows: DataFrame, vector: str, size: int, scale: float = SCALE, shift: int = SHIFT) -> Sums:
    def terms(matrix: np.ndarray) -> np.ndarray:
        x = integers(matrix, scale, shift)
        return np.append(x.astype(object).sum(axis=0) if np.abs(x).max() > LARGEST >> 20 else x.sum(axis=0).astype(object),
                         len(x))

    *total, n = _added_up(rows, vector, size, size + 1, terms)
    centre = [(2 * s + n) // (2 * n) for s in total] if n else [0] * size
    return Sums(n, np.array(centre, np.int64), [s - n * c for s, c in zip(total, centre, strict=True)])


def covariance(rows: DataFrame, vector: str, known: Sums, scale: float = SCALE, shift: int = SHIFT) -> np.ndarray:
    """The covariance with divisor n, each entry the exact one rounded to a double."""
    size = len(known.centre)
    upper = np.triu_indices(size)

    def terms(matrix: np.ndarray) -> np.ndarray:
        return exact_products(integers(matrix, scale, shift) - known.centre)[upper]

    out, n = np.zeros((size, size)), known.n
    for i, j, value in zip(*upper, _added_up(rows, vector, size, len(upper[0]), terms), strict=True):
        out[i, j] = out[j, i] = (n * value - known.rest[i] * known.rest[j]) / (n * n)
    return out


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L L'; L is lower triangular with as many columns as the rank."""
    size = len(matrix)
    order, left = np.arange(size), matrix.diagonal().astype(np.float64).copy()
    factor = np.zeros((size, size))
    floor = size * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        pivot = k + int(left[k:].argmax())
        if left[pivot] <= floor:
            return factor[:, :k], order
        for array in (order, left, factor):
            array[[k, pivot]] = array[[pivot, k]]
        factor[k, k] = np.sqrt(left[k])
        below = matrix[order[k + 1:], order[k]] - factor[k + 1:, :k] @ factor[k, :k]
        factor[k + 1:, k] = below / factor[k, k]
        left[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def jacobi(factor: np.ndarray) -> np.ndarray:
    """`factor` after rotations of its columns that make them orthogonal; a round rotates disjoint pairs of columns."""
    out = factor.copy()
    n = out.shape[1]
    ring = list(range(n + n % 2))
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1], strict=False) if max(a, b) < n]
            p, q = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            x, y = out[:, p], out[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            skew = np.abs(xy) > np.finfo(np.float64).eps * np.sqrt(xx * yy)
            if skew.any():
                turned = True
                x, y, p, q = x[:, skew], y[:, skew], p[skew], q[skew]
                zeta = (yy[skew] - xx[skew]) / (2 * xy[skew])
                tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cosine = 1 / np.hypot(1, tangent)
                out[:, p], out[:, q] = cosine * (x - tangent * y), cosine * (tangent * x + y)
            ring[1:] = [ring[-1], *ring[1:-1]]
        if not turned:
            break
    return out


def components(matrix: np.ndarray, most: int) -> Whitening:
    """At most `most` components of a covariance matrix."""
    factor, order = pivoted_cholesky(matrix)
    turned = jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    largest = np.argsort(-norms, kind="stable")[:most]
    vectors = np.zeros((len(matrix), len(largest)))
    vectors[order] = turned[:, largest] / norms[largest]
    peak = np.abs(vectors).argmax(axis=0)
    vectors *= np.where(vectors[peak, np.arange(len(largest))] < 0, -1.0, 1.0)
    values = norms[largest] ** 2
    trace = matrix.trace()
    return Whitening(vectors, values, values / trace if trace > 0 else values)


def _white(matrix: np.ndarray, known: Sums, model: Whitening, scale: float, shift: int) -> np.ndarray:
    y = integers(matrix, scale, shift) - known.centre
    return (y - np.array([r / known.n for r in known.rest])) @ model.components / np.sqrt(model.values)


def deviations(matrix: np.ndarray, known: Sums, scale: float = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Per row the sum of the squares of n * x - S, as Python integers."""
    y, rest, n = integers(matrix, scale, shift) - known.centre, known.rest, known.n
    most = max(int(np.abs(y).max(initial=0)), *(abs(r) for r in rest), 1)
    wide = most * most * len(rest) >= 1 << 62
    y, r = (y.astype(object), np.array(rest, object)) if wide else (y, np.array(rest, np.int64))
    squares, mixed = (y * y).sum(axis=1).astype(object), (y * r).sum(axis=1).astype(object)
    return n * n * squares - 2 * n * mixed + sum(v * v for v in rest)


def identity_error(rows: DataFrame, vector: str, known: Sums, model: Whitening, scale: float = SCALE,
                   shift: int = SHIFT) -> float:
    """Largest difference between the covariance of the whitened vectors and the identity."""
    size, k = model.components.shape
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(upper[0]))
        for _, matrix in _vectors.matrices(batches, vector, size):
            white = _white(matrix, known, model, scale, shift)
            total += np.concatenate((white.sum(axis=0), (white.T @ white)[upper]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                         ["place", "value"])

    found = rows.select(vector).mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value")).collect()
    value = np.zeros(k + len(upper[0]))
    for place, total in found:
        value[place] = total / known.n
    centre = value[:k]
    return float(np.abs(value[k:] - centre[upper[0]] * centre[upper[1]] - (upper[0] == upper[1])).max())


def whitened(rows: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding",
             scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per row of `rows` and component up to `most`."""
    kind = rows.schema[key].dataType.simpleString()
    usable = _vectors.usable(rows.select(key, vector), vector)
    usable, size = _vectors.of_one_length(usable, vector)
    schema = (f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    known = sums(usable, vector, size, scale, shift) if size else Sums(0, np.zeros(0, np.int64), [])
    model = components(covariance(usable, vector, known, scale, shift), most) if known.n else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(usable, vector, known, model, scale, shift)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in _vectors.matrices(batches, vector, size):
            m = len(matrix)
            apart = [Decimal(v) if v < 10**38 else None for v in deviations(matrix, known, scale, shift)]
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, known.n)), pa.array(apart, pa.decimal128(38, 0)).take(pa.array(each)),
                 pa.array(_white(matrix, known, model, scale, shift).ravel()), pa.array(np.tile(model.explained, m)),
                 pa.array(np.full(m * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.select(key, vector).mapInArrow(run, schema)
