"""Whitening of embedding vectors with eigenvectors refined to double precision.

Entries become whole numbers, so sums and products over all rows are exact: tasks multiply blocks of rows, centred at the whole
number next to the mean, and Spark adds the blocks; the rest of the centring, less than one half, is exact on the total. Only
this matrix, of dimension x dimension numbers however many rows there are, reaches the driver. Its eigenvectors are found in
float32 and corrected there by the iteration of Ogita and Aishima, which needs matrix products in a higher precision only; runs
of eigenvalues too close for it are solved apart, within their own space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ship_by_value

#: What an entry is scaled by and moved by before it becomes a whole number.
SCALE, SHIFT = 1024, 100_000
#: Entries as large as this count as not finite: products of their whole numbers would leave 38 digits.
LARGEST = 2.0 ** 36
#: Rows that are multiplied at a time.
_ROWS = 4096
_LIMB = 20
_DECIMAL = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite entries or such of ``LARGEST`` or more."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & F.coalesce(
        F.abs(x.cast("double")) < LARGEST, F.lit(False)) & ~F.isnan(x.cast("double")))


def _whole(column: pa.Array) -> np.ndarray:
    """The vectors of a column as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """The products of the columns of a matrix of whole numbers, exact (Python numbers where 64 bits may not hold them)."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * max(1, len(rows)) < 1 << 53:
        values = rows.astype(np.float64)
        return (values.T @ values).astype(np.int64)  # no sum is beyond the whole numbers that a double holds
    limbs, rest = [], rows
    while rest.any():
        low = ((rest + (1 << _LIMB - 1)) & ((1 << _LIMB) - 1)) - (1 << _LIMB - 1)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> _LIMB
    parts = [((a.T @ b).astype(np.int64).astype(object), i + j) for i, a in enumerate(limbs) for j, b in enumerate(limbs)]
    return sum(part * (1 << _LIMB * shift) for part, shift in parts)


def refine(cov: np.ndarray, most: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, from a float32 solution."""
    size = float(np.abs(cov).max(initial=0.0))
    wide = np.longdouble
    if not size:
        return np.zeros(len(cov)), np.eye(len(cov))
    a, one = cov.astype(wide) / wide(size), np.eye(len(cov), dtype=wide)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    norm, before = np.sqrt((a * a).sum()), np.inf
    for _ in range(most):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        close = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        # runs of values that the step could not tell apart: within each, the small matrix without its mean has full accuracy
        order = np.argsort(values)
        x, values = x[:, order], values[order]
        bounds = np.flatnonzero(np.diff(values) > close) + 1
        for run in np.split(np.arange(len(values)), bounds):
            if len(run) > 1:
                part = x[:, run]
                middle = values[run].mean()
                inner = part.T @ (a @ part - middle * part)
                inner = (inner + inner.T) / 2
                x[:, run] = part @ np.linalg.eigh((inner / max(np.abs(inner).max(), np.finfo(wide).tiny)).astype(np.float64))[1].astype(wide)
        change = float(np.abs(step).max())
        if change < 1e-18 or change >= before and change < 1e-15:
            break
        before = change
    x = x + x @ ((one - x.T @ x) / 2)
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: the rows and sums of the fit list, the covariance, and its components by falling eigenvalue."""

    rows: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers next to the means."""
        return np.array([(2 * s + self.rows) // (2 * self.rows) for s in self.sums], np.int64)

    def offsets(self) -> list[int]:
        """rows x (mean - centre), exact."""
        return [s - self.rows * int(c) for s, c in zip(self.sums, self.centre)]

    def kept(self, most: int) -> int:
        """Components with an eigenvalue beyond rounding, at most ``most``."""
        floor = np.finfo(np.float64).eps * len(self.values) * float(np.trace(self.covariance))
        return int(min(most, (self.values > floor).sum()))


def _good(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int | None]:
    good = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & (F.size("vector") > 0))
    dim = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return good.where(F.size("vector") == (dim["dim"] if dim else 0)), dim and dim["dim"]


def _added(partial: DataFrame, keys: list[str]) -> dict[tuple, Decimal]:
    """Exact totals of per-task numbers: a bounded number of keys, whatever the rows."""
    found = partial.groupBy(*keys).agg(F.sum("value").alias("value")).collect()
    return {tuple(r[k] for k in keys): r["value"] for r in found}


def fit(good: DataFrame, dim: int) -> Whitening:
    """Exact sums, then the exact covariance (both one pass over all rows), then the refined components."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            whole = _whole(batch.column(0))
            high, low = whole >> 24, whole & ((1 << 24) - 1)
            total = [t + (int(h) << 24) + int(l) for t, h, l in zip(total, high.sum(axis=0), low.sum(axis=0))]
            n += len(whole)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int32()), pa.array(
            [Decimal(v) for v in [n, *total]], _DECIMAL)], ["at", "value"])

    vectors = good.select("vector")
    total = _added(vectors.mapInArrow(sums, "at int, value decimal(38,0)"), ["at"])
    n = int(total.pop((-1,)))
    bare = Whitening(n, [int(total[(i,)]) for i in range(dim)], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    centre = bare.centre

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(dim)
        so_far = np.zeros(len(upper[0]), object)
        for batch in batches:
            whole = _whole(batch.column(0)) - centre
            for at in range(0, len(whole), _ROWS):
                so_far = so_far + exact_gram(whole[at:at + _ROWS])[upper]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(
            [Decimal(int(v)) for v in so_far], _DECIMAL)], ["i", "j", "value"])

    gram = _added(vectors.mapInArrow(products, "i int, j int, value decimal(38,0)"), ["i", "j"])
    rest, cov = bare.offsets(), np.zeros((dim, dim))
    for (i, j), value in gram.items():
        cov[i, j] = cov[j, i] = (n * int(value) - rest[i] * rest[j]) / (n * n)  # whole numbers: rounded once
    return Whitening(n, bare.sums, cov, *refine(cov))


def whiten(rows: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): per row and component, numbered from 1 by falling eigenvalue.

    deviation: the exact sum of (n x - S)^2, a decimal. whitened: x - S/n along the component, over the root of its eigenvalue.
    explained: eigenvalue over trace. identity_error: the largest distance of the whitened rows' covariance from the identity,
    measured over all rows. Vectors that are null or empty, that hold a null or non-finite entry (or one of 2^36 or more), or
    are of another length than the commonest take no part. Rows may repeat; null ids are ids like others; other columns are
    ignored. Components without variance are left out, so equal vectors, one vector or an empty table give no rows."""
    good, dim = _good(rows, id_col, vector_col)
    schema = good.select("id").withColumns({
        "component": F.lit(0), "n": F.lit(0).cast("long"), "deviation": F.lit(None).cast("decimal(38,0)"),
        "whitened": F.lit(None).cast("double"), "explained": F.lit(None).cast("double"),
        "identity_error": F.lit(None).cast("double")}).schema
    found = fit(good, dim) if dim else None
    count = found.kept(most) if found else 0
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    n, centre, rest, trace = found.rows, found.centre, found.offsets(), float(np.trace(found.covariance))
    shift = np.array([r / n for r in rest])
    turn = found.vectors[:, :count] / np.sqrt(found.values[:count])
    explained = found.values[:count] / trace

    def along(near: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk->ik", near - shift, turn)  # each row by itself, whatever its batch

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = along(_whole(batch.column(0)) - centre)
            total, square = total + w.sum(axis=0), square + w.T @ w
        values = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    sums = _added(good.select("vector").mapInArrow(spread, "at int, value double"), ["at"])
    flat = np.array([sums[(i,)] for i in range(count + count * count)]) / n
    error = float(np.abs(flat[count:].reshape(count, count) - np.outer(flat[:count], flat[:count]) - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _whole(batch.column(1)) - centre
            whitened = along(near)
            reach = n * int(np.abs(near).max(initial=0)) + max(map(abs, rest))
            exact = np.int64 if reach * reach * dim < 1 << 62 else object
            far = n * near.astype(exact) - np.array(rest, exact)
            deviation = pa.array([Decimal(int(v)) for v in (far * far).sum(axis=1)], _DECIMAL)
            each = pa.array(np.repeat(np.arange(len(near)), count))
            size = len(near)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1), size), pa.int32()), pa.array(np.full(
                    size * count, n), pa.int64()), deviation.take(each), pa.array(whitened.ravel()), pa.array(
                        np.tile(explained, size)), pa.array(np.full(size * count, error))], schema.names)

    return good.mapInArrow(project, schema)


ship_by_value(__name__)
