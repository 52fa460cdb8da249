"""Operator 13: embedding whitening by incremental eigendecomposition.

Components become whole numbers on a grid, so that sums and deviations are exact. The fit
list is each distinct grid vector once. Every task keeps the spectrum of what it has read
(count, exact sums, eigenvalues and eigenvectors of the centred scatter) and takes a vector
in as one centred rank-one update: the new eigenvalues are the roots of the secular equation,
after deflation of the directions that the update leaves alone, and the eigenvectors come
from the roots by Loewner's formula. Two spectra combine by successive rank-one updates, one
for each eigenpair of the second and one for the difference of the means, in a tree of
sixteen at a time. Last, a Rayleigh-Ritz step makes the result exact to double precision:
tasks project the centred fit list on the basis found, their Gram matrices are summed in the
same tree, and the eigenvectors of the small matrix turn the basis.

What goes to the driver or to all tasks is a basis (dimensions squared), whatever the rows.

Cases: rows whose vector is NULL or holds a NULL or non-finite entry give no row, nor do
rows whose vector has another length than most distinct vectors (of equally frequent ones
the shorter) or no entry; repeated rows each give theirs but count once in the fit; an empty
table gives no rows; components without variance (of a single vector, of constant
dimensions) are not returned, so there may be fewer than asked for. Extra columns pass
through in ``row``. Where a grid value or an exact deviation needs more than 64 bits the
query fails rather than wraps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StructField, StructType)

from strata.llm._text import release
from strata.session import materialize

GRID, SHIFT = 64, 1_000_000
FAN = 16                                          # spectra or matrices that one task combines
EPS = np.finfo(float).eps


def secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots x of 1 + sum(z2 / (d - x)), d ascending and distinct, z2 positive: one
    between each d and the next, one above the last. Also every d[i] - x[j], to full
    relative accuracy: a root is held as its distance from the nearer pole.

    All roots go together: both halves of the sum are replaced by a pole of equal value and
    slope, the quadratic is solved, and a step out of the bracket becomes a bisection."""
    k = len(d)
    j = np.arange(k)
    gap = np.append(np.diff(d), z2.sum())
    below = (j[:, None] <= j).astype(float)       # poles at or below the root
    half = gap / 2
    at_half = 1 + (z2[:, None] / (d[:, None] - (d + half))).sum(0)
    near = (at_half >= 0) | (j == k - 1)          # the pole below is the origin
    origin = np.where(near, j, j + 1)
    delta = d[:, None] - d[origin]
    low = np.where(near, 0.0, -half)
    high = np.where(near, half, 0.0)
    if at_half[-1] < 0:
        low[-1], high[-1] = half[-1], gap[-1]
    mu, done = (low + high) / 2, np.zeros(k, bool)
    for _ in range(60):
        x = delta - mu
        inverse = 1 / x
        t = z2[:, None] * inverse
        slope = t * inverse
        total, psi = t.sum(0), np.einsum("ij,ij->j", t, below)
        f, phi = 1 + total, total - psi
        done |= np.abs(f) <= 16 * k * EPS * (1 - psi + phi)
        if done.all():
            break
        low, high = np.where(f < 0, mu, low), np.where(f < 0, high, mu)
        dpsi = np.einsum("ij,ij->j", slope, below)
        dphi = slope.sum(0) - dpsi
        a = x[j, j]
        b = np.append(x[j[1:], j[:-1]], 1.0)      # the last root has no pole above it
        q, s = dpsi * a * a, dphi * b * b
        c = 1 + (psi - dpsi * a) + (phi - dphi * b)
        p = c * (a + b) + q + s
        root = np.sqrt(np.maximum(p * p - 4 * c * a * b * f, 0))
        with np.errstate(all="ignore"):
            step = np.where(p > 0, 2 * a * b * f / (p + root), (p - root) / (2 * c))
            step[-1] = a[-1] + q[-1] / c[-1]
            new = mu + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done |= np.abs(new - mu) <= EPS * np.abs(mu)
        mu = np.where(done, mu, new)
    return d[origin] + mu, delta - mu


class Spectrum:
    """Count, exact sums, and the eigenpairs of the centred scatter of the vectors read."""

    def __init__(self, size: int):
        self.n, self.sums = 0, np.zeros(size, np.int64)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def rank_one(self, u: np.ndarray, weight: float) -> None:
        """Adds weight * u u' to the scatter."""
        d = self.values
        z = (u @ self.vectors) * np.sqrt(weight)
        scale = max(d[-1], z @ z)
        if scale == 0:
            return
        tiny = 8 * EPS * scale
        live = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > tiny)
        kept = []
        for i in live.tolist() if np.any(np.diff(d[live]) <= tiny) else ():
            if kept and d[i] - d[kept[-1]] <= tiny:      # equal values: all of z to one of them
                o = kept.pop()
                r = np.hypot(z[o], z[i])
                c, s = z[i] / r, z[o] / r
                v, w = self.vectors[:, o].copy(), self.vectors[:, i].copy()
                self.vectors[:, o], self.vectors[:, i] = c * v - s * w, s * v + c * w
                z[o], z[i] = 0.0, r
            kept.append(i)
        live = np.array(kept) if kept else live
        if not len(live):
            return
        old, zl = d[live], z[live]
        new, diff = secular(old, zl * zl)
        other = old - old[:, None]
        np.fill_diagonal(other, 1.0)
        ratio = -diff / other
        exact = np.copysign(np.sqrt(np.abs(ratio.prod(1))), zl)
        turn = exact[:, None] / diff
        turn /= np.sqrt((turn * turn).sum(0))
        values, vectors = d.copy(), self.vectors
        values[live] = new
        vectors[:, live] = vectors[:, live] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def add(self, x: np.ndarray) -> None:
        """One vector of whole numbers: a centred rank-one update."""
        if self.n:
            away = (self.n * x - self.sums) / self.n
            self.rank_one(away, self.n / (self.n + 1))
        self.n, self.sums = self.n + 1, self.sums + x

    def merge(self, other: Spectrum) -> None:
        """The other's vectors too: a rank-one update for each of its eigenpairs and one for
        the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.rank_one(vector, value)
        apart = other.sums / other.n - self.sums / self.n
        self.rank_one(apart, self.n * other.n / (self.n + other.n))
        self.n, self.sums = self.n + other.n, self.sums + other.sums


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _listed(rows: list, kind) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _fold(parts: DataFrame, combine: Callable, last: int) -> DataFrame:
    """One row of rows numbered ``part`` (0 to ``last``): sixteen at a time, in a tree."""
    while last > 0:
        parts = (parts.withColumn("part", F.expr(f"part div {FAN}"))
                 .groupBy("part").applyInArrow(combine, parts.schema))
        last //= FAN
    return parts


SPECTRUM = "part long, n long, sums array<long>, scale array<double>, basis array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), _listed([s.sums], pa.int64()),
         _listed([s.values], pa.float64()), _listed([s.vectors.ravel()], pa.float64())],
        names=["part", "n", "sums", "scale", "basis"])


def _spectra(size: int):
    def read(batches: Iterator[pa.RecordBatch]):
        s = Spectrum(size)
        for batch in batches:
            for x in _matrix(batch.column("x"), size):
                s.add(x)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)
        release()
    return read


def _unpack(row: dict, size: int) -> Spectrum:
    s = Spectrum(size)
    s.n, s.sums = row["n"], np.array(row["sums"], np.int64)
    s.values, s.vectors = np.array(row["scale"]), np.array(row["basis"]).reshape(size, size)
    return s


def _joined(size: int):
    def combine(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        s = _unpack(rows[0], size)
        for row in rows[1:]:
            s.merge(_unpack(row, size))
        return pa.Table.from_batches([_row(rows[0]["part"], s)])
    return combine


def _gram(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, second moment) of the centred fit list projected on ``basis``."""
    size, k = basis.shape

    def project(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = ((n * _matrix(batch.column("x"), size) - sums) / n) @ basis
            total += y.sum(0)
            square += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), _listed([total], pa.float64()),
             _listed([square.ravel()], pa.float64())], names=["part", "total", "square"])
        release()

    def add(table: pa.Table) -> pa.Table:
        total, square = _matrix(table.column("total"), k).sum(0), _matrix(table.column("square"), k * k).sum(0)
        return pa.table([table.column("part")[:1], _listed([total], pa.float64()), _listed([square], pa.float64())],
                        names=["part", "total", "square"])

    row = _fold(fit.mapInArrow(project, "part long, total array<double>, square array<double>"), add, last).first()
    return np.array(row["total"]) / n, np.array(row["square"]).reshape(k, k) / n


def whiten(vectors: DataFrame, components: int = 16, column: str = "embedding") -> DataFrame:
    """For each row with a finite vector: ``row`` (a struct of its columns), ``n`` (distinct
    grid vectors), ``deviation`` (sum over dimensions of (n x - S)**2, exact), ``whitened``
    and ``explained`` (one entry a component, by falling eigenvalue) and ``identity_error``,
    the largest entry of the whitened fit list's covariance minus the identity."""
    c = F.col(f"`{column}`")
    finite = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double"))
                                      & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * GRID) + F.lit(SHIFT).cast("long"))
    rows = (vectors.where(finite)
            .select(F.struct(*[F.col(f"`{v}`") for v in vectors.columns]).alias("row"), x.alias("x")))
    found = StructType([StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

    fit = materialize(rows.select("x").where(F.size("x") > 0).distinct())
    most = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = most["d"] if most else 0
    fit = fit.where(F.size("x") == size)
    n, kept, explained, error, basis, sums = 0, 0, [], 0.0, np.zeros((size, 0)), np.zeros(size, np.int64)
    if size:
        spectra = materialize(fit.mapInArrow(_spectra(size), SPECTRUM))
        last = spectra.agg(F.max("part")).first()[0]
        whole = _unpack(_fold(spectra, _joined(size), last).first().asDict(), size)
        n, sums = whole.n, whole.sums
        basis = np.linalg.qr(whole.vectors)[0]
        last = fit.rdd.getNumPartitions() - 1
        _, moment = _gram(fit, n, sums, basis, last)
        values, turn = np.linalg.eigh(moment)
        values, basis = values[::-1], (basis @ turn)[:, ::-1]
        kept = int((values[:components] > 8 * size * EPS * max(values[0], 0)).sum())
        basis = basis[:, :kept] / np.sqrt(values[:kept])
        explained = (values[:kept] / values.sum()).tolist()
        if kept:
            mean, moment = _gram(fit, n, sums, basis, last)
            error = float(np.abs(moment - np.outer(mean, mean) - np.eye(kept)).max())

    def project(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in lists:
            away = n * _matrix(part, size) - sums
            if (away.astype(float) ** 2).sum(1).max(initial=0) >= 2.0 ** 63:
                raise OverflowError("an exact deviation needs more than 64 bits")
            white = (away / n) @ basis
            lists_of = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * kept, white.ravel())
            yield pa.StructArray.from_arrays([pa.array((away * away).sum(1)), lists_of], names=["deviation", "whitened"])
        release()

    made = F.arrow_udf(project, found).asNondeterministic()
    return (rows.where((F.size("x") == size) & F.lit(kept > 0)).select("row", made("x").alias("made"))
            .select("row", F.lit(n).cast("long").alias("n"), "made.deviation", "made.whitened",
                    F.lit(explained).cast("array<double>").alias("explained"),
                    F.lit(error).alias("identity_error")))
