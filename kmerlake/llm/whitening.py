"""Whitening of embeddings: streaming covariance in partitions, merged, then a symmetric QR eigen-solve.

Each partition folds its vectors into (n, mean, scatter) by Welford's rank-one updates. The updates of a block of
vectors are made as one matrix product: vector i of the block adds (k / (k + 1)) d d', d its difference from the mean
of the k vectors before it, and these means are running sums. Partitions are merged by the parallel form of the update.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors folded in at a time.
BLOCK = 1024
#: States merged in one step of the tree, at most.
FAN_IN = 32
STATE = "dim int, n long, total array<decimal(38,0)>, mean array<double>, scatter array<double>, slot int"
#: Integers up to here are summed and multiplied as 64-bit ones, larger as Python's.
SMALL = 1 << 24
LONG = 1 << 63


class Moments:
    """Count, exact integer sum, mean and scatter (sum of outer products about the mean) of vectors of one length."""

    def __init__(self, dim: int):
        self.n, self.total, self.mean, self.scatter = 0, np.zeros(dim, object), np.zeros(dim), np.zeros((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """Folds rows in one after another by rank-one updates, a block of them as one product."""
        if x.dtype.kind == "i":
            self.total = self.total + (x.sum(0).astype(object) if np.abs(x).max(initial=0) < SMALL else x.astype(object).sum(0))
        for at in range(0, len(x), BLOCK):
            block = x[at : at + BLOCK].astype(float)
            start = self.mean if self.n else block[0]  # differences from a near point keep their digits
            run = np.cumsum(block - start, axis=0)
            before = self.n + np.arange(len(block))
            mean = np.vstack([np.zeros(block.shape[1]), run[:-1]]) / np.maximum(before, 1)[:, None]
            away = block - start - mean
            self.scatter += (away * (before / (before + 1.0))[:, None]).T @ away
            self.n += len(block)
            self.mean = start + run[-1] / self.n

    def merge(self, other: "Moments") -> None:
        if not other.n:
            return
        n = self.n + other.n
        away = other.mean - self.mean if self.n else other.mean
        self.scatter = self.scatter + other.scatter + (np.outer(away, away) * (self.n * (other.n / n)))
        self.mean = self.mean + away * (other.n / n) if self.n else other.mean
        self.n, self.total = n, self.total + other.total


def vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of each length in a batch: rows that are not null, not empty and hold finite entries only."""
    lists = batch.column(column)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)  # a null entry becomes NaN
    start, end = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), end - start, 0)
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        values = flat[start[at][:, None] + np.arange(dim)]
        good = np.isfinite(values).all(1)
        if good.any():
            yield at[good], values[good]


def integers(values: np.ndarray, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows that fit, floor(scale * value) + offset of these as 64-bit integers)."""
    with np.errstate(over="ignore"):
        fits = np.flatnonzero((np.abs(scale * values) < LONG / 2 - abs(offset)).all(1))
    return fits, np.floor(scale * values[fits]).astype(np.int64) + offset


@dataclass
class Whitening:
    """Whitening of vectors of one length: exact sums, mean, eigenvalues falling, and unit eigenvectors in columns."""

    n: int
    total: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, the whole part of the mean taken off as an integer."""
        whole = [t // self.n for t in self.total]
        rest = np.array([(t - w * self.n) / self.n for t, w in zip(self.total, whole)])
        return (x - np.array(whole, np.int64)).astype(float) - rest

    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding noise of the largest."""
        return self.values > self.values.max(initial=0) * len(self.values) * np.finfo(float).eps

    def whitened(self, x: np.ndarray, count: int) -> np.ndarray:
        """Projections on the first components over the root of their eigenvalue; NaN for components without variance."""
        use = self.usable()[:count]
        scale = np.where(use, 1 / np.sqrt(np.where(use, self.values[:count], 1)), np.nan)
        return self.centred(x) @ self.axes[:, :count] * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - total)^2, exact; None beyond a long."""
        n = self.n
        if max((abs(n * int(v)) + abs(t) for v, t in zip(np.abs(x).max(0, initial=0), self.total)), default=0) < (1 << 30):
            d = n * x - np.array(self.total, np.int64)
            high = (d * d).astype(object).sum(1) if len(d) else []
            return [int(v) if v < LONG else None for v in high]
        # n^2 x'x - 2 n x'S + S'S, with S in parts of 24 bits and x about a whole middle, so that 64-bit sums stay exact.
        whole = np.array([t // n for t in self.total], np.int64)
        rest = [t - int(w) * n for t, w in zip(self.total, whole)]
        y = x - whole  # n x - S = n y - rest, 0 <= rest < n
        if len(y) and np.abs(y).max() >= SMALL:
            y = y.astype(object)
        parts, left = [], rest
        while any(left):
            parts.append(np.array([r & (SMALL - 1) for r in left], np.int64))
            left = [r >> 24 for r in left]
        square, rest_square = (y * y).sum(1), sum(r * r for r in rest)
        cross = [(y * p).sum(1).tolist() for p in parts]
        out = []
        for i, s in enumerate(square.tolist()):
            v = n * n * s - 2 * n * sum(c[i] << 24 * k for k, c in enumerate(cross)) + rest_square
            out.append(v if v < LONG else None)
        return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, q) with q' a q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        largest = np.abs(v).max()
        if largest < np.finfo(float).tiny / np.finfo(float).eps or not np.any(v[1:]):
            continue
        v /= largest  # whose squares then do not vanish
        norm = np.linalg.norm(v)
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors in columns) of a symmetric matrix: implicit QR steps with Wilkinson's shift on its tridiagonal form."""
    n = len(a)
    scale = np.abs(a).max(initial=0)
    if n == 0 or scale == 0:
        return np.zeros(n), np.eye(n)
    d, e, q = tridiagonal((a + a.T) / (2 * scale))
    q = np.ascontiguousarray(q.T)  # rows are the columns to be rotated
    eps, high, steps = np.finfo(float).eps, n - 1, 0
    while high > 0:
        small = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        steps += 1
        if steps > 60 * n:
            raise ArithmeticError("no convergence")
        half = (d[high - 1] - d[high]) / 2
        root = float(np.hypot(half, e[high - 1]))
        shift = d[high] - e[high - 1] ** 2 / (half + (root if half >= 0 else -root)) if root else d[high]
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dl, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dl
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dl
            e[k] = c * s * (dl - dk) + (c * c - s * s) * ek
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k : k + 2] = np.array(((c, s), (-s, c))) @ q[k : k + 2]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, q[order].T


def _states(rows: DataFrame, fold) -> dict[int, Moments]:
    """Moments by vector length over all rows: one state a task and length from `fold`, merged in a tree of tasks whose last returns one for each length."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for dim, x in fold(batch):
                held.setdefault(dim, Moments(x.shape[1])).add(x)
        yield from map(_packed, held.items())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for dim, m in map(_unpacked, batch.to_pylist()):
                held.setdefault(dim, Moments(len(m.mean))).merge(m)
        yield from map(_packed, held.items())

    states = rows.mapInArrow(first, STATE)
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for slots in sorted({wide, min(wide, FAN_IN), 1}, reverse=True):
        states = states.withColumn("slot", (F.spark_partition_id() % slots).cast("int")).repartition(slots, "slot").sortWithinPartitions("dim", "n", "mean").mapInArrow(merged, STATE)
    return dict(map(_unpacked, (r.asDict() for r in states.collect())))


_STATE_TYPE = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64())), ("slot", pa.int32())])


def _packed(item: tuple[int, Moments]) -> pa.RecordBatch:
    dim, m = item
    return pa.RecordBatch.from_pylist([{"dim": dim, "n": m.n, "total": [Decimal(int(t)) for t in m.total], "mean": m.mean, "scatter": m.scatter.ravel(), "slot": 0}], _STATE_TYPE)


def _unpacked(row: dict) -> tuple[int, Moments]:
    m = Moments(len(row["mean"]))
    m.n, m.total, m.mean = row["n"], np.array([int(t) for t in row["total"]], object), np.array(row["mean"])
    m.scatter = np.array(row["scatter"]).reshape(m.scatter.shape)
    return row["dim"], m


def _table(vecs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vecs.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))


def _folded(batch: pa.RecordBatch, scale: float, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, values in vectors(batch, 1):
        fits, x = integers(values, scale, offset)
        if len(fits):
            yield at[fits], x


def fit(vecs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, offset: int = 100000) -> dict[int, Whitening]:
    """The whitening of all vectors of each length, of x = floor(scale * entry) + offset. A length's state is one d x d matrix, in a task as on the driver."""
    states = _states(_table(vecs, id_col, vector_col), lambda batch: ((x.shape[1], x) for _, x in _folded(batch, scale, offset)))
    out = {}
    for dim, m in states.items():
        covariance = m.scatter / m.n
        values, axes = symmetric_qr(covariance)
        out[dim] = Whitening(m.n, [int(t) for t in m.total], np.maximum(values, 0), axes, float(np.trace(covariance)))
    return out


def whiten(vecs: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, offset: int = 100000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and each of the first components.

    Rows whose vector is null or empty, holds null or non-finite entries, or entries whose x passes half the range of a
    long, are dropped. Vectors of different lengths are tables of their own; n, the sums and the components are their
    length's. Repeated rows and null ids count and return like any others. deviation is null beyond a long; whitened is
    null for components without variance, which identity_error leaves out (0 if none is left); explained is null if no
    component has any. Equal eigenvalues may swap or turn their components. An empty table gives no rows. Rows are read three times; what is shuffled is a state for each task.
    """
    rows = _table(vecs, id_col, vector_col)
    models = fit(vecs, id_col, vector_col, scale, offset)

    def projected(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for _, x in _folded(batch, scale, offset):
            yield x.shape[1], np.nan_to_num(models[x.shape[1]].whitened(x, min(components, x.shape[1])))

    error: dict[int, float] = {}
    for dim, m in _states(rows, projected).items() if models else ():
        use = np.flatnonzero(models[dim].usable()[:components])
        away = m.scatter / m.n - np.eye(len(m.scatter))
        error[dim] = float(np.abs(away[np.ix_(use, use)]).max(initial=0))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _folded(batch, scale, offset):
                m = models[x.shape[1]]
                count = min(components, x.shape[1])
                share = m.values[:count] / m.trace if m.trace else np.full(count, np.nan)
                white = m.whitened(x, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * count, m.n, np.int64)),
                        pa.array([v for v in m.deviation(x) for _ in range(count)], pa.int64()),
                        pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                        pa.array(np.tile(share, len(at)), mask=np.tile(np.isnan(share), len(at))),
                        pa.array(np.full(len(at) * count, error[x.shape[1]])),
                    ],
                    names=names,
                )

    return rows.mapInArrow(work, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
