"""Whitening of embeddings by eigenvectors that are refined in mixed precision.

Sums and centred products are made where the vectors are and added up over partitions; the driver gets
one matrix. Its eigenvectors are computed in single precision and then corrected by the iteration of
Ogita and Aishima, which needs matrix products only, in more than double precision, until rounding is
all that is left. Eigenvalues too close to be told apart at the present accuracy form clusters, whose
vectors are separated by an eigenproblem of the cluster's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.sums import summed

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
_WIDE = np.longdouble
_ROUNDS = 40
# Eigenvalues are told apart if they differ by so many times the bound of what is wrong.
_APART = 16
# Beyond this, 1024 times an entry is no long any more.
_LARGEST = 2.0**62
_LONG = 1 << 63
_BLOCK = 1024


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in wide precision by products of double-precision slices.

    Rows of ``a`` and columns of ``b`` are cut into slices of so few bits that every product of two slices
    and all sums within it are exact; the sum over the slices is made in the wide format.
    """
    bits = (52 - int(np.ceil(np.log2(a.shape[1])))) // 2
    left, right = _sliced(a, 1, bits), _sliced(b, 0, bits)
    total = np.zeros((a.shape[0], b.shape[1]), dtype=_WIDE)
    for i, j in ((0, 2), (1, 1), (2, 0), (0, 1), (1, 0), (0, 0)):
        total += left[i] @ right[j]
    return total


def _sliced(matrix: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    rest, out = matrix.astype(_WIDE), []
    for _ in range(3):
        exponent = np.frexp(np.abs(rest).max(axis=axis, keepdims=True))[1]
        part = np.ldexp(np.rint(np.ldexp(rest, bits - exponent)), exponent - bits)
        out.append(part.astype(np.float64))
        rest = rest - part
    return out


def refined(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """One iteration: better eigenvectors of a symmetric ``matrix``, and how wrong the old ones were.

    With X the vectors, R = I - X'X and S = X'AX measure what is wrong with them. Where two eigenvalues
    differ by much more than that, the error of their vectors follows from S and R. Closer ones form
    clusters: between their vectors only orthogonality is mended, and they are then turned to the
    eigenvectors of the matrix within the cluster.
    """
    missing = np.eye(len(matrix), dtype=_WIDE) - product(vectors.T, vectors)
    seen = product(vectors.T, product(matrix, vectors))
    values = np.diag(seen) / (1 - np.diag(missing))
    wrong = 2 * (_norm(seen - np.diag(values)) + _norm(matrix) * _norm(missing))
    groups = _clusters(values, _APART * wrong)
    group_of = np.empty(len(values), dtype=int)
    for number, group in enumerate(groups):
        group_of[group] = number
    apart = group_of[:, None] != group_of[None, :]
    gaps = np.where(apart, values[None, :] - values[:, None], 1)
    change = np.where(apart, (seen + values * missing) / gaps, missing / 2)
    vectors = vectors + vectors.astype(np.float64) @ change.astype(np.float64)
    for group in groups:
        if len(group) > 1:
            part = vectors[:, group]
            inner = product(part.T, product(matrix, part) - values[group].mean() * part)
            scale = np.abs(inner).max()
            if scale > 0:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * scale)).astype(np.float64))[1]
                vectors[:, group] = product(part, turn)
    return vectors, float(wrong)


def _norm(matrix: np.ndarray) -> float:
    """An upper bound of the spectral norm of a symmetric matrix."""
    size = np.abs(matrix)
    return min(size.sum(axis=1).max(), np.sqrt((size * size).sum()))


def _clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Values by size, cut where neighbours differ by more than ``least``."""
    order = np.argsort(values)
    return np.split(order, np.flatnonzero(np.diff(values[order]) > least) + 1)


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision.

    The largest entry of a vector is positive; of equally large ones, the first. Any orthogonal vectors may
    stand for equal eigenvalues. A matrix without entries other than zero has the unit vectors.
    """
    scale = np.abs(matrix).max()
    if not scale > 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    wide = matrix.astype(_WIDE) / _WIDE(scale)
    vectors = np.linalg.eigh(wide.astype(np.float32))[1].astype(_WIDE)
    least = np.inf
    for _ in range(_ROUNDS):
        vectors, wrong = refined(wide, vectors)
        # The error falls to its square each time, until rounding is all that is left.
        if wrong > least / 2 and least < 1e-9:
            break
        least = min(least, wrong)
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    values = (vectors * product(wide, vectors)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order].astype(np.float64)
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return (values[order] * _WIDE(scale)).astype(np.float64), vectors


@dataclass
class Whitening:
    """What is known of the fit list of one length: ``n`` vectors with exact ``sums``, and their components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def __post_init__(self):
        # Vectors are centred in two steps: by whole numbers without rounding, then by what is left.
        self.centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)
        self.rest = np.array([float(Decimal(s - int(c) * self.n) / self.n) for s, c in zip(self.sums, self.centre)])
        self.left = np.array([s - int(c) * self.n for s, c in zip(self.sums, self.centre)], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(np.float64) - self.rest

    def components(self, count: int = COMPONENTS) -> list[int]:
        """Numbers, from 0, of the first components."""
        return list(range(min(count, len(self.values))))

    def projected(self, x: np.ndarray, count: int = COMPONENTS) -> np.ndarray:
        """Whitened values; not a number along components without variance."""
        used = self.components(count)
        values = self.values[used]
        flat = values <= len(self.sums) * np.finfo(np.float64).eps * self.trace
        with np.errstate(all="ignore"):
            return self.centred(x) @ self.vectors[:, used] / np.sqrt(np.where(flat, np.nan, values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 over the dimensions, exact; null where that is no long."""
        # n x - S = n (x - c) - (S - n c)
        steps = x - self.centre
        largest = int(np.abs(steps).max(initial=0)) * self.n + int(np.abs(self.left).max(initial=0))
        if largest**2 * max(1, x.shape[1]) < _LONG:
            return ((self.n * steps - self.left) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.left.tolist())) for row in steps.tolist()]
        return [e if e < _LONG else None for e in exact]


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as x = floor(1024 c) + 100000) of the usable vectors of a column, for each length.

    Null vectors, and those with null or non-finite entries or entries beyond the range of long, are left out.
    """
    lists = column.cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    entries = flat.to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    with np.errstate(all="ignore"):
        scaled = np.floor(entries * SCALE)
        bad = np.concatenate(([0], np.cumsum(~(np.abs(scaled) < _LARGEST))))
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        rows = rows[bad[starts[rows] + size] == bad[starts[rows]]]
        if len(rows):
            yield rows, scaled[starts[rows][:, None] + np.arange(size)].astype(np.int64) + SHIFT


def _of_length(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((rows, x) for rows, x in whole_numbers(column) if x.shape[1] == size)


def fit_whitening(rows: DataFrame, vector: str = "embedding") -> dict[int, Whitening]:
    """Exact sums, covariance and refined components of all usable vectors, for each length that occurs.

    Vectors of different lengths have nothing to do with each other. Two passes over the vectors: exact
    sums, then centred products; what leaves a partition is one matrix a length, and the driver holds
    one matrix at a time. An empty table has no lengths.
    """
    vectors = rows.select(F.col(f"`{vector}`").alias("v"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for found, x in whole_numbers(batch.column(0)):
                size = x.shape[1]
                total = x.sum(axis=0) if np.abs(x).max() < _LONG // len(x) else x.astype(object).sum(axis=0)
                sums[size] = [a + b for a, b in zip(sums.get(size, [0] * size), total.tolist())]
                counts[size] = counts.get(size, 0) + len(found)
        for size, total in sums.items():
            values = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            columns = [pa.array([v] * size, t) for v, t in ((size, pa.int32()), (counts[size], pa.int64()))]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(range(size), pa.int32()), columns[1], values], ["size", "place", "n", "total"])

    parts = vectors.mapInArrow(added, "size int, place int, n bigint, total decimal(38,0)")
    totals = parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found: dict[int, list] = {}
    for row in totals.orderBy("size", "place").collect():
        found.setdefault(row["size"], []).append(row)
    return {size: _fitted(vectors, [int(r.total) for r in each], each[0].n) for size, each in found.items()}


def _fitted(vectors: DataFrame, sums: list[int], n: int) -> Whitening:
    size = len(sums)
    whitening = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for _, x in _of_length(batch.column(0), size):
                for a in range(0, len(x), _BLOCK):
                    # Whole numbers, so products and sums are exact up to 2**53 and the same in any order.
                    steps = (x[a : a + _BLOCK] - whitening.centre).astype(np.float64)
                    total = steps.T @ steps if total is None else total + steps.T @ steps
        return total

    # What is left of the mean is at most half a unit.
    covariance = summed(vectors, products, size) / n - np.outer(whitening.rest, whitening.rest)
    values, components = eigenpairs((covariance + covariance.T) / 2)
    return Whitening(n, sums, np.maximum(values, 0.0), components, float(np.trace(covariance)))


def identity_error(rows: DataFrame, whitening: Whitening, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity.

    Components without variance are left out; null if none is left.
    """
    size = len(whitening.sums)
    count = len(whitening.components())

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for _, x in _of_length(batch.column(0), size):
                w = whitening.projected(x)
                w = np.hstack([np.ones((len(w), 1)), np.nan_to_num(w)])
                total = w.T @ w if total is None else total + w.T @ w
        return total

    found = summed(rows.select(F.col(f"`{vector}`").alias("v")), moments, count + 1) / whitening.n
    covariance = found[1:, 1:] - np.outer(found[0, 1:], found[0, 1:])
    used = whitening.values[:count] > size * np.finfo(np.float64).eps * whitening.trace
    if not used.any():
        return None
    return float(np.abs(covariance[np.ix_(used, used)] - np.eye(used.sum())).max())


def whiten(rows: DataFrame, fitted: dict[int, Whitening] | None = None, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are those with
    an entry of 2**52 or more, which has no whole number in a long. Vectors of different lengths are
    whitened apart. Components are numbered from 1 by falling eigenvalue, 8 at most; ``whitened`` is null
    along a component without variance, which is all there is of equal vectors, and so are ``explained``
    and ``identity_error`` if no component has any. ``deviation`` is null where it exceeds a long. Repeated rows and rows
    with equal or null ids each have rows of their own; other columns do not matter, and an empty table
    gives no rows. All passes read the vectors only, and no vector is moved between tasks.
    """
    fitted = fit_whitening(rows, vector) if fitted is None else fitted
    errors = {size: identity_error(rows, w, vector) for size, w in fitted.items()}
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, x in whole_numbers(batch.column(1)):
                known = fitted.get(x.shape[1])
                if known is None:
                    continue
                used = known.components()
                ids = batch.column(0).take(pa.array(np.repeat(found, len(used))))
                whitened = known.projected(x).ravel()
                share = [float(known.values[k] / known.trace) if known.trace > 0 else None for k in used]
                count = len(ids)
                columns = [
                    ids,
                    pa.array(np.tile(np.array(used, dtype=np.int32) + 1, len(found))),
                    pa.array(np.full(count, known.n, dtype=np.int64)),
                    pa.array([d for d in known.deviations(x) for _ in used], pa.int64()),
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(share * len(found), pa.float64()),
                    pa.array([errors[x.shape[1]]] * count, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, _COLUMNS)

    found = rows.select("vec_id", F.col(f"`{vector}`").alias("v"))
    return found.mapInArrow(run, _RESULT.format(kind))


_RESULT = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
_COLUMNS = [part.split()[0] for part in _RESULT.split(", ")]
