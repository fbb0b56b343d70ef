"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become whole numbers, ``floor(scale * c) + shift``, so sums and scatter are exact: they are the
same for every partitioning and after every recomputed task. The scatter is taken around the rounded
means, products of 20-bit limbs by matrix product in doubles that cannot round, and moved to the true
means in whole numbers. A task sends one number for each pair of dimensions, whatever its rows; Spark
adds them, and the driver factors one matrix of at most ``MOST_DIMENSIONS`` squared entries.

With P'VP = LL', one-sided Jacobi turns the columns of L until they are orthogonal. Their squared norms
are then the eigenvalues of V and the normalised columns, rows put back in order, its eigenvectors.

Cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of
another length than most (ties: the shorter); entries beyond 2^43 in size count as that; rows that repeat
an id, or have none, are rows of their own; a component without variance (a constant dimension, equal
dimensions, fewer rows than dimensions) has null ``whitened`` and explains 0; a deviation beyond 64 bits
is null; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
MOST_DIMENSIONS, MOST_ENTRY = 4096, 1 << 53
_LIMB = 20


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vec) > 0), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors) + SHIFT, -MOST_ENTRY, MOST_ENTRY).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _sums(x: np.ndarray) -> np.ndarray:
    """Exact column sums as Python integers."""
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return high.astype(object) * (1 << 32) + low.astype(object)


def exact_scatter(z: np.ndarray) -> np.ndarray:
    """Exact z'z as Python integers, by products of limbs in doubles that stay under 2^53."""
    most = int(np.abs(z).max(initial=0))
    count = max(1, -(-most.bit_length() // _LIMB))
    limbs = [((z >> (_LIMB * i)) & ((1 << _LIMB) - 1) if i < count - 1 else z >> (_LIMB * i)).astype(np.float64) for i in range(count)]
    out = np.zeros((z.shape[1],) * 2, object)
    rows = 1 << (53 - 2 * _LIMB)
    for lo in range(0, len(z), rows):
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a[lo : lo + rows].T @ b[lo : lo + rows]).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return out


def _added(rows: DataFrame, cells) -> dict[int, int]:
    """Sums over all tasks of the whole numbers that ``cells`` makes of a task's batches."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                own = cells(b.column(0))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["cell", "s"])

    summed = rows.mapInArrow(run, "cell long, s decimal(38,0)").groupBy("cell").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    return {r.cell: int(r.s) for r in summed.collect()}


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor L and order p with v[p][:, p] = L L'; it ends where what is left of a diagonal entry is rounding."""
    v, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    noise = d * np.finfo(float).eps * v.diagonal()
    for k in range(d):
        left = np.where(v.diagonal()[k:] > noise[order[k:]], v.diagonal()[k:], 0)
        at = k + int(left.argmax())
        if left[at - k] <= 0:
            return factor[:, :k], order
        for a in (order, factor, v):
            a[[k, at]] = a[[at, k]]
        v[:, [k, at]] = v[:, [at, k]]
        factor[k, k] = np.sqrt(v[k, k])
        factor[k + 1 :, k] = v[k + 1 :, k] / factor[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``a`` with its columns turned in pairs until all are orthogonal; the pairs of a round are disjoint and turn together."""
    a, n = a.copy(), a.shape[1]
    seats = np.arange(n + n % 2)
    tiny = np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            p, q = p[(p < n) & (q < n)], q[(p < n) & (q < n)]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(xy) / np.maximum(np.sqrt(xx * yy), np.finfo(float).tiny)
            worst = max(worst, off.max(initial=0))
            turn = off > tiny
            zeta = (yy - xx) / (2 * np.where(turn, xy, 1))
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            a[:, p], a[:, q] = c * (x - t * y), c * (t * x + y)
            seats = np.r_[seats[0], seats[-1], seats[1:-1]]
        if worst <= len(a) * tiny:
            break
    return a


@dataclass
class Whitening:
    """Rows fitted, their exact sums, and eigenvalues with unit eigenvectors (columns), greatest first; those without variance are left out."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return np.array([round(s / self.n) if abs(s) < 1 << 52 else (2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S of every entry, exactly; Python integers where 64 bits might not hold a row's sum of squares."""
        centre = self.centre
        rest = [s - self.n * int(c) for s, c in zip(self.sums, centre)]
        z = x - centre
        most = self.n * int(np.abs(z).max(initial=0)) + self.n
        kind = np.int64 if most * most * len(centre) < 1 << 63 else object
        return z.astype(kind) * self.n - np.array(rest, kind)

    def project(self, away: np.ndarray, k: int) -> np.ndarray:
        return (away.astype(np.float64) / self.n) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def _length(vectors: DataFrame, vec_col: str) -> int | None:
    lengths = vectors.where(usable(F.col(vec_col))).groupBy(F.size(vec_col).alias("d")).count()
    first = lengths.orderBy(F.desc("count"), "d").first()
    if first is not None and first.d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {first.d} entries; the driver factors at most {MOST_DIMENSIONS}")
    return first and first.d


def fit(vectors: DataFrame, vec_col: str = "embedding") -> Whitening | None:
    """Eigenvalues and eigenvectors of the covariance of all usable vectors; None where there are none."""
    dim = _length(vectors, vec_col)
    if dim is None:
        return None
    rows = vectors.where(usable(F.col(vec_col)) & (F.size(vec_col) == dim)).select(F.col(vec_col).cast("array<double>").alias("v"))

    def count_and_sums(column):
        x = _matrix(column, dim)
        return np.r_[np.array([len(x)], object), _sums(x)]

    cells = _added(rows, count_and_sums)
    n, sums = cells[0], [cells[i + 1] for i in range(dim)]
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)))
    centre, upper = model.centre, np.triu_indices(dim)
    cells = _added(rows, lambda column: exact_scatter(_matrix(column, dim) - centre)[upper])
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    v = np.zeros((dim, dim))
    for at, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        v[i, j] = v[j, i] = (n * cells[at] - rest[i] * rest[j]) / (n * n)
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    best = np.argsort(-norms, kind="stable")
    best = best[norms[best] > 0]
    unit = np.zeros((dim, len(best)))
    unit[order] = turned[:, best] / norms[best]
    # Either sign is right; the greatest entry is positive.
    unit *= np.where(unit[np.abs(unit).argmax(0), np.arange(len(best))] < 0, -1, 1) if len(best) else 1
    return Whitening(n, sums, float(v.trace()), norms[best] ** 2, unit)


def identity_error(vectors: DataFrame, model: Whitening, k: int, vec_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; None without components."""
    k, dim = min(k, len(model.values)), len(model.sums)
    if not k:
        return None

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = model.project(model.deviations(_matrix(b.column(0), dim)), k)
            total, products = total + w.sum(0), products + w.T @ w
        both = np.r_[total, products.ravel()]
        yield pa.record_batch([pa.array(np.arange(len(both))), pa.array(both)], names=["cell", "s"])

    rows = vectors.where(usable(F.col(vec_col)) & (F.size(vec_col) == dim)).select(F.col(vec_col).cast("array<double>").alias("v"))
    cells = {r.cell: r.s for r in rows.mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([cells[i] for i in range(k)]) / model.n
    cov = np.array([cells[k + i] for i in range(k * k)]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` for every usable vector."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = len(model.sums)
    k, real = min(k, dim), min(k, dim, len(model.values))
    share = np.r_[model.values[:real] / model.trace if real else np.zeros(0), np.zeros(k - real)]

    def run(batches):
        for b in batches:
            away = model.deviations(_matrix(b.column(1), dim))
            square = [s if s < 1 << 63 else None for s in (away * away).sum(1).tolist()]
            white = np.column_stack([model.project(away, real), np.zeros((len(away), k - real))]).ravel()
            row = np.repeat(np.arange(len(away)), k)
            component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(away))
            out = [b.column(0).take(pa.array(row)), pa.array(component), pa.array(np.full(len(row), model.n)), pa.array(square, pa.int64()).take(pa.array(row)), pa.array(white, mask=component > real), pa.array(np.tile(share, len(away)))]
            yield pa.record_batch(out, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    rows = vectors.where(usable(F.col(vec_col)) & (F.size(vec_col) == dim))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, schema)


def digest(vectors: DataFrame, k: int = 8) -> DataFrame:
    vectors = vectors.select("vec_id", "embedding")
    model = fit(vectors)
    error = identity_error(vectors, model, k) if model else None
    return whiten(vectors, model, k).withColumn("identity_error", F.lit(error).cast("double"))
