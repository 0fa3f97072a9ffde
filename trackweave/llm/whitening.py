"""Whitening of embeddings with cyclic Jacobi rotations.

Each entry c of a vector becomes the whole number x = floor(64 c) + 1,000,000. Tasks sum x
by dimension, then the products of the deviations d = x - round(mean); both sums are whole
numbers and exact, so the covariance (sum of d d' less what the rounding of the mean adds)
is rounded once, whatever the order of the tasks. The driver, which holds one matrix of the
size of a vector squared, turns it by symmetric rotations, pair after pair, until every
off-diagonal entry vanishes against the diagonal entries it stands between; small
eigenvalues keep their digits that way. The components, sorted by falling eigenvalue, go to
all tasks. The covariance of what comes out is measured in one more pass.

Rows whose vector is null, empty, or holds a null, NaN or infinite entry are dropped, and so
are vectors of another length than most rows have (the shorter length on a tie) and those with
an entry of 2**53 / 64 or more, which has no exact whole number. Rows with a null or repeated
``vec_id`` count and come back like all others. Components whose eigenvalue is not above
1e-12 of the largest have no direction and are left out, so equal vectors give no rows; an
empty table gives none either. ``deviation`` is null where it exceeds a long. Of tied
eigenvalues the one that the rotations find first comes first; other columns are ignored.
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


SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no exact whole number.
TOO_LARGE = 2.0**53 / SCALE
#: Eigenvalues up to this part of the largest are no directions.
LEAST_PART = 1e-12
_SUM = "decimal(38,0)"


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their whole-number vectors, by length; rows that have none are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        found = entries[starts[rows][:, None] + np.arange(size)]
        with np.errstate(invalid="ignore"):
            good = (np.abs(found) < TOO_LARGE).all(axis=1)
        yield rows[good], np.floor(SCALE * found[good]).astype(np.int64) + SHIFT


def exact_products(d: np.ndarray) -> np.ndarray:
    """d'd in whole numbers, by the widest arithmetic that is exact for these values."""
    most = int(np.abs(d).max(initial=0))
    if most * most * max(1, len(d)) < 2**53:
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return d.T @ d if most * most * max(1, len(d)) < 2**63 else d.astype(object).T @ d.astype(object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    return x * n - np.array(sums, dtype=np.int64) if largest < 2**63 else x.astype(object) * n - np.array(sums, dtype=object)


def squared(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, null beyond a long."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 2**63:
        d = d.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in (d.astype(object) ** 2).sum(axis=1).tolist()]


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix by falling size, and unit eigenvectors in columns, by cyclic rotations."""
    a, turned = np.array(v, dtype=np.float64), np.eye(len(v))
    for _ in range(sweeps):
        quiet = True
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                off = a[p, q]
                if abs(off) <= 2.0**-53 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                quiet = False
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, half) / (abs(half) + np.hypot(1.0, half))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                p_p, q_q = a[p, p] - t * off, a[q, q] + t * off
                a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                a[p], a[q] = a[:, p], a[:, q]
                a[p, p], a[q, q], a[p, q], a[q, p] = p_p, q_q, 0.0, 0.0
                turned[:, p], turned[:, q] = c * turned[:, p] - s * turned[:, q], s * turned[:, p] + c * turned[:, q]
        if quiet:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


@dataclass
class Whitening:
    """What a row needs: vectors counted, sums by dimension, eigenvalues and eigenvectors (columns) and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return deviations(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def dimension_sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """length -> vectors, sum of each dimension; one row a dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column(0)):
                if len(x):
                    held = total.setdefault(x.shape[1], [0, 0])
                    held[0] += len(x)
                    held[1] = held[1] + (x.sum(axis=0) if len(x) * int(np.abs(x).max()) < 2**63 else x.astype(object).sum(axis=0)).astype(object)
        for size, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), _decimals(s)], names=["size", "i", "n", "s"])

    rows = vectors.mapInArrow(add, f"size int, i int, n bigint, s {_SUM}").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows.collect()):
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``, each entry rounded once; the driver gets one row for each pair of dimensions."""
    size = len(sums)
    middle = [round(Fraction(s, n)) for s in sums]
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for _, x in whole_vectors(batch.column(0)):
                if len(x) and x.shape[1] == size:
                    total = total + exact_products(x - np.array(middle, dtype=np.int64))[upper].astype(object)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _decimals(total)], names=["i", "j", "s"])

    rows = vectors.mapInArrow(add, f"i int, j int, s {_SUM}").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    left = [s - n * m for s, m in zip(sums, middle)]
    out = np.empty((size, size))
    for r in rows:
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = float(Fraction(n * int(r["s"]) - left[i] * left[j], n * n))
    return out


def fitted(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of ``vectors(embedding)``; None where no component has a direction."""
    found = dimension_sums(vectors)
    if not found:
        return None
    size = min(found, key=lambda s: (-found[s][0], s))
    n, sums = found[size]
    v = covariance(vectors, n, sums)
    values, directions = jacobi(v)
    keep = [k for k in range(min(components, size)) if values[k] > LEAST_PART * values[0] and values[0] > 0]
    return Whitening(n, sums, values[keep], directions[:, keep], float(np.trace(v))) if keep else None


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of all whitened vectors less the identity."""
    shared, size, k = vectors.sparkSession.sparkContext.broadcast(model), len(model.sums), len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in whole_vectors(batch.column(0)):
                if len(x) and x.shape[1] == size:
                    w = shared.value.whitened(x)
                    total += np.r_[w.T @ w, w.sum(axis=0)[None]]
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    rows = vectors.mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1, k))
    for r in rows:
        total[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


SHAPE = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, *, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each remaining vector and component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    vectors = embeddings.select("embedding")
    model = fitted(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, {SHAPE}")
    error = identity_error(vectors, model)
    shared, size, k = embeddings.sparkSession.sparkContext.broadcast(model), len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        explained = m.values / m.trace
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1)):
                if not len(x) or x.shape[1] != size:
                    continue
                times, each = len(x), np.repeat(np.arange(len(x)), k)
                columns = [
                    batch.column(0).take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, k + 1), times), pa.int32()),
                    pa.array(np.full(times * k, m.n), pa.int64()),
                    pa.array(squared(deviations(x, m.n, m.sums)), pa.int64()).take(pa.array(each)),
                    pa.array(m.whitened(x).ravel()),
                    pa.array(np.tile(explained, times)),
                    pa.array(np.full(times * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *[c.split()[0] for c in SHAPE.split(", ")]])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, {SHAPE}")
