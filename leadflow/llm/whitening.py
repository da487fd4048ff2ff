"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum of its centred scatter and updates it with every vector: ``S + c d d'`` where d is the vector less
the running mean. The eigenvalues of such a rank-one update are the roots of a secular equation between the old ones, found for
all roots at once by rational interpolation inside brackets; entries that do not change anything and equal eigenvalues are deflated
first. The update's direction is recomputed from the roots, so that the new eigenvectors are orthogonal. Two spectra join by such
updates along the scaled eigenvectors of one of them and along the difference of their means, in rounds of ``FAN`` partitions.

A last pass over all vectors projects the scatter on the basis found (Rayleigh-Ritz), which makes the components exact to double
precision. An update costs the cube of the dimension; a partition's state is its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.support import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000  # of the fixed-point entries
FAN = 16
EPS = np.finfo(float).eps
ROUNDS = 60


# ---------------------------------------------------------------- rank-one update


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho sum z_j^2 / (d_j - x)`` for rising d, rho > 0 and no zero in z.

    Returned as the pole next to each root and the distance from it, which keeps the differences to all poles exact."""
    k = len(d)
    weight = rho * z * z
    upper = np.r_[d[1:], d[-1] + weight.sum()]
    width = upper - d
    # The sign at the middle of the interval tells which pole is nearer; the last interval has one pole only.
    middle = 1 + (weight / (d - (d + width / 2)[:, None])).sum(axis=1)
    origin = np.where((middle < 0) & (np.arange(k) < k - 1), np.minimum(np.arange(k) + 1, k - 1), np.arange(k))
    right = origin != np.arange(k)
    delta = d - d[origin][:, None]
    low = np.where(right, -width / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(k) < k - 1, width / 2, width))
    low, high = np.where(right | (middle >= 0), low, width / 2), high
    mu = (low + high) / 2
    own, following = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    left_poles = np.tril(np.ones((k, k), dtype=bool))
    open_roots = np.ones(k, dtype=bool)
    for _ in range(ROUNDS):
        gap = delta - mu[:, None]
        terms = weight / gap
        slopes = terms / gap
        value = 1 + terms.sum(axis=1)
        open_roots &= np.abs(value) > 8 * EPS * (1 + np.abs(terms).sum(axis=1))
        if not open_roots.any():
            break
        low, high = np.where(value < 0, mu, low), np.where(value < 0, high, mu)
        near, far = gap[own, own], gap[own, following]
        psi = np.where(left_poles, slopes, 0).sum(axis=1)
        phi = slopes.sum(axis=1) - psi
        with np.errstate(all="ignore"):
            a = (near + far) * value - near * far * (psi + phi)
            b = near * far * value
            c = value - near * psi - far * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = near[-1] + near[-1] ** 2 * psi[-1] / (value[-1] - near[-1] * psi[-1])  # one pole
            step = np.where(value * step >= 0, -value / (psi + phi), step)  # the function rises
        trial = mu + step
        trial = np.where((trial > low) & (trial < high), trial, (low + high) / 2)
        open_roots &= (trial != mu) & (high - low > EPS * np.maximum(np.abs(low), np.abs(high)))
        mu = np.where(open_roots, trial, mu)
    return origin, mu


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of ``V diag(values) V' + rho direction direction'``, for rising values and rho >= 0."""
    z = vectors.T @ direction
    norm = np.sqrt(z @ z)
    if rho <= 0 or norm == 0:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    scale = max(abs(values[-1]), abs(values[0]), rho)
    tolerance = 8 * EPS * scale
    z = np.where(rho * np.abs(z) <= tolerance, 0.0, z)
    live = np.flatnonzero(z)
    close = np.flatnonzero(np.diff(values[live]) <= tolerance) if len(live) > 1 else live[:0]
    if len(close):
        vectors = vectors.copy()
        for at in close:  # of two equal eigenvalues, a rotation leaves the second the whole of both entries
            i, j = live[at], live[at + 1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
            z[i], z[j] = 0.0, r
        live = np.flatnonzero(z)
    d = values[live]
    origin, mu = secular_roots(d, z[live], rho)
    gap = (d - d[origin][:, None]) - mu[:, None]  # pole less root; rows are roots
    gap = np.where(gap == 0, np.copysign(np.finfo(float).tiny, gap), gap)
    poles = d[:, None] - d  # [i, j]: d_i - d_j
    np.fill_diagonal(poles, 1.0)
    exact = np.sqrt(np.abs(np.prod(-gap / np.where(np.eye(len(d), dtype=bool), 1.0, poles), axis=0)))
    exact = np.copysign(exact, z[live])
    turn = (exact / gap).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[live] = d[origin] + mu
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, exact sums and centred scatter of a set of vectors, the scatter by its eigenvalues (rising) and eigenvectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, np.int64), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            away = (self.n * x - self.sums) / self.n  # exact before the division
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n += 1
        self.sums = self.sums + x

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, max(0.0, float(value)))
        if self.n:
            away = (other.sums - other.n * SHIFT) / other.n - (self.sums - self.n * SHIFT) / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / (self.n + other.n))
        self.n += other.n
        self.sums = self.sums + other.sums

    def orthonormal(self) -> np.ndarray:
        """The eigenvectors, cleared of what rounding has left."""
        q, r = np.linalg.qr(self.vectors)
        return q * np.where(np.diag(r) < 0, -1.0, 1.0)


# ---------------------------------------------------------------- over a table

_SPECTRA = "block long, n long, sums array<long>, eigenvalues array<double>, eigenvectors array<double>"
_SPECTRA_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("eigenvalues", pa.list_(pa.float64())), ("eigenvectors", pa.list_(pa.float64()))])


def _row(block: int, s: Spectrum) -> dict:
    return {"block": block, "n": s.n, "sums": s.sums, "eigenvalues": s.values, "eigenvectors": s.vectors.ravel()}


def _spectrum(row: dict) -> Spectrum:
    size = len(row["sums"])
    return Spectrum(row["n"], np.array(row["sums"], np.int64), np.array(row["eigenvalues"]), np.array(row["eigenvectors"]).reshape(size, size))


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` as doubles, without vectors that are null, empty or hold null or non-finite entries."""
    entry = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return found.filter("vector IS NOT NULL AND size(vector) > 0").filter(~F.exists("vector", entry))


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Fixed-point entries of a batch."""
    if len(vectors) and (np.diff(vectors.offsets) != size).any():
        raise ValueError(f"a vector has not {size} entries")
    flat = np.asarray(vectors.flatten()).reshape(len(vectors), size)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def spectrum(found: DataFrame, size: int) -> Spectrum:
    """Of all rows of ``usable``: rank-one updates by partition, joined in rounds of ``FAN`` blocks."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Spectrum.empty(size)
        for batch in batches:
            for x in _matrix(batch.column(0), size):
                mine.add(x)
        if mine.n:
            yield pa.RecordBatch.from_pylist([_row(TaskContext.get().partitionId(), mine)], schema=_SPECTRA_ARROW)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        mine = _spectrum(rows[0])
        for row in rows[1:]:
            mine.join(_spectrum(row))
        return pa.Table.from_pylist([_row(key[0].as_py(), mine)], schema=_SPECTRA_ARROW)

    state = written(found.select("vector").mapInArrow(fit, _SPECTRA), "spectra")
    last = state.agg(F.max("block")).first()[0]
    while last:
        state = written(state.groupBy(F.expr(f"block div {FAN}").alias("up")).applyInArrow(merge, _SPECTRA), "spectra")
        last //= FAN
    rows = state.collect()  # one row of the square of the dimension
    return _spectrum(rows[0].asDict()) if rows else Spectrum.empty(size)


def _summed(rows: DataFrame, width: int, of) -> np.ndarray:
    """Sum over all vectors of ``of(x)' of(x)`` and, in a last row, of ``of(x)``; a task sends one row for each row of the sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            y = of(batch.column(0))
            total[:width] += y.T @ y
            total[width] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select("vector").mapInArrow(add, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width + 1, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # the square of the dimension
        out[r["i"], r["j"]] = r["v"]
    return out


@dataclass(frozen=True)
class Whitening:
    """Means as exact sums and a number, components (columns, by falling eigenvalue), their eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def fit(found: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``usable``; None if there are none. Vectors of several lengths are an error.

    Components whose eigenvalue is zero but for rounding are left out: equal vectors have no direction."""
    sizes = [r[0] for r in found.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors of several lengths")
    if not sizes:
        return None
    whole = spectrum(found, sizes[0])
    basis, size = whole.orthonormal(), sizes[0]
    n, sums = whole.n, whole.sums
    scatter = _summed(found, size, lambda v: ((n * _matrix(v, size) - sums) / n) @ basis)
    values, turn = np.linalg.eigh((scatter[:size] + scatter[:size].T) / (2 * n))
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    kept = min(components, int((values > size * EPS * max(values[0], 0)).sum()))
    return Whitening(n, sums, vectors[:, :kept], values[:kept], float(values.sum()))


def identity_error(found: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity, from a pass over all of them."""
    size, width = len(model.sums), len(model.eigenvalues)
    if not width:
        return 0.0
    total = _summed(found, width, lambda v: model.apply(_matrix(v, size)))
    mean = total[width] / model.n
    return float(np.abs(total[:width] / model.n - np.outer(mean, mean) - np.eye(width)).max())


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: its whitened coordinate, the component's share of the variance, and the measured error.

    ``deviation`` is the sum over the entries of ``(n x - S)^2`` in whole numbers; one that does not fit 63 bits is an error.
    Vectors that are null, empty or hold null or non-finite entries give no rows, nor does a table without variance; repeated rows and ids count as
    often as they occur; other columns are not read; equal eigenvalues may take any axes between them."""
    spark = table.sparkSession
    found = usable(table, vec_id, vector)
    model = fit(found, components)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], _WHITE)
    error, size, width = identity_error(found, model), len(model.sums), len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            away = model.n * x - model.sums
            if len(away) and float((away.astype(float) ** 2).sum(axis=1).max()) >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a deviation does not fit a long")
            deviation, count = (away * away).sum(axis=1), len(x)
            columns = [np.repeat(np.arange(count), width), np.tile(np.arange(1, width + 1, dtype=np.int32), count), np.full(count * width, model.n), np.repeat(deviation, width),
                       model.apply(x).ravel(), np.tile(explained, count), np.full(count * width, error)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *map(pa.array, columns[1:])], names=[c.split()[0] for c in _WHITE.split(", ")])

    return found.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(rows, _WHITE)
