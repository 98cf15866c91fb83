"""Fitting the binding model: sums over reads are Spark jobs, the solver holds parameters and 4**k-sized tables only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kmerlake.functions import sequence as sq
from kmerlake.operators.model import AffinityHistogram, partition_function
from kmerlake.operators.motifs import LEAST, Motif

_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 85]] = range(4)


@dataclass
class Parameters:
    motifs: list[Motif]
    betas: np.ndarray

    def vector(self) -> np.ndarray:
        return np.concatenate([*([m.a0, *m.matrix.ravel()] for m in self.motifs), self.betas])

    def moved(self, delta: np.ndarray, least_ratio: float = 1e-4) -> "Parameters":
        """The parameters after a step: cells stay positive, a position's best is put back to 1 and the excess goes to A0; affinities of motifs stay within least_ratio."""
        out, at = [], 0
        for m in self.motifs:
            size = m.matrix.size
            cells = np.maximum(m.matrix + delta[at + 1 : at + 1 + size].reshape(m.matrix.shape), LEAST)
            top = cells.max(axis=1, keepdims=True)
            out.append(replace(m, matrix=np.clip(cells / top, LEAST, 1), a0=max(LEAST, m.a0 * float(top.prod()) + delta[at])))
            at += size + 1
        floor = max(m.a0 for m in out) * least_ratio
        return Parameters([replace(m, a0=max(m.a0, floor)) for m in out], np.maximum(self.betas + delta[at:], 1e-9))


@dataclass
class State:
    parameters: Parameters
    free: np.ndarray
    q: np.ndarray  # (samples, 4**k)
    w: np.ndarray
    r: np.ndarray
    error: float
    sample_errors: np.ndarray


class Model:
    """Observed enrichments of pull-down samples against one input library.

    reads(read_id, seq) is the input, persisted by the caller for repeated use; observed is (samples, 4**k).
    """

    def __init__(self, reads: DataFrame, k: int, observed: np.ndarray, totals: list[float], rna_conc: float = 1000.0, linear: bool = False, kmer_weights: np.ndarray | None = None):
        self.reads, self.k, self.observed, self.totals = reads, k, np.asarray(observed, float), list(totals)
        self.rna_conc, self.linear = rna_conc, linear
        self.kmer_weights = np.ones(4**k) if kmer_weights is None else kmer_weights
        self.f0_counts = self._sums(lambda codes, index: (np.ones((len(codes), 1)), 1), 1)[0]
        self.f0 = self.f0_counts / self.f0_counts.sum()

    def _sums(self, weigh: Callable, columns: int) -> np.ndarray:
        """(columns, 4**k): k-mer counts of all reads under each of a batch's weight columns, summed within tasks, then over them."""
        k, pad_k = self.k, self.k

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((columns, 4**k))
            for batch in batches:
                for codes in _by_length(batch.column(0).to_pylist()):
                    index = _kmer_index(codes, pad_k)
                    weights, _ = weigh(codes, index)
                    for c in range(columns):
                        total[c] += np.bincount(index.ravel(), np.repeat(weights[:, c], index.shape[1]), 4**k)
            yield pa.record_batch([pa.array(np.repeat(np.arange(columns), 4**k).astype(np.int32)), pa.array(np.tile(np.arange(4**k), columns)), pa.array(total.ravel())], names=["c", "i", "v"])

        rows = self.reads.select("seq").mapInArrow(work, "c int, i long, v double").groupBy("c", "i").sum("v").toArrow()
        out = np.zeros((columns, 4**k))
        out[rows.column(0).to_numpy(), rows.column(1).to_numpy()] = rows.column(2).to_numpy()
        return out

    def state(self, p: Parameters, free: np.ndarray | None = None) -> State:
        if free is None:
            hist = AffinityHistogram.of(partition_function(self.reads, p.motifs))
            free = np.array([hist.free_protein(t, self.rna_conc, p.motifs[0].a0) for t in self.totals])
        weigh = _occupancy(p.motifs, free, self.linear)
        q = self._sums(weigh, len(free)) + 1e-20
        return self._close(p, free, q)

    def _close(self, p: Parameters, free: np.ndarray, q: np.ndarray) -> State:
        w = q + self.f0_counts * p.betas[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(self.f0 > 0, w / self.f0 / w.sum(axis=1, keepdims=True), 1.0)
        e = (r - self.observed) * self.kmer_weights
        return State(p, free, q, w, r, float((e**2).mean()), (e**2).mean(axis=1))

    def adjoint(self, s: State) -> tuple[np.ndarray, np.ndarray]:
        """(derivative of the error by each q, by each background share), free protein held fixed."""
        total = s.w.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            scale = np.where(self.f0 > 0, 1 / self.f0, 0.0)
        pull = 2 / s.r.size * (s.r - self.observed) * self.kmer_weights**2 * scale
        by_q = pull / total - (pull * s.w).sum(axis=1, keepdims=True) / total**2
        return by_q, by_q @ self.f0_counts

    def gradient(self, s: State, threshold: float = 0.0) -> np.ndarray:
        """Of the mean squared error by every parameter, free protein held fixed.

        The error's derivative by each k-mer's bound weight, (samples, 4**k) numbers, goes to the tasks. A read adds up
        those of its k-mers, times the change of its occupancy, and so has one factor for the derivatives of its sites;
        a task returns one number for each parameter. Reads whose partition function is below `threshold` times the
        greatest are passed over; 0 takes all.
        """
        p = s.parameters
        by_q, by_beta = self.adjoint(s)
        spark = self.reads.sparkSession
        shared = spark.sparkContext.broadcast(by_q)
        k, linear, free = self.k, self.linear, s.free
        motifs = p.motifs
        least = threshold * self.greatest_sum(motifs) if threshold > 0 else 0.0
        size = sum(1 + m.matrix.size for m in motifs)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                for codes in _by_length(batch.column(0).to_pylist()):
                    found = _sites(codes, motifs)
                    total = sum(z.sum(axis=1) for _, z in found)
                    keep = (total > 0) & (total >= least)
                    if not keep.any():
                        continue
                    codes, total, found = codes[keep], total[keep], [(x[keep], z[keep]) for x, z in found]
                    y = total[:, None] * free[None, :] * motifs[0].a0
                    psi = y if linear else y / (y + 1)
                    slope = (psi if linear else psi * (1 - psi)) / total[:, None]
                    index = _kmer_index(codes, k)
                    factor = sum(slope[:, j] * own[index].sum(axis=1) for j, own in enumerate(shared.value))
                    at = 0
                    for m, (x, z) in zip(motifs, found):
                        weighed = z * factor[:, None]
                        out[at] += weighed.sum() / m.a0
                        for d in range(m.width):
                            letters = x[:, d : d + z.shape[1]]
                            out[at + 1 + 4 * d : at + 5 + 4 * d] += np.bincount(letters.ravel(), weighed.ravel(), 4)[:4] / m.matrix[d]
                        at += 1 + m.matrix.size
            yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], names=["y", "v"])

        rows = self.reads.select("seq").mapInArrow(work, "y int, v double").groupBy("y").sum("v").collect()  # one row a parameter
        shared.unpersist()
        out = np.zeros(size)
        for y, v in rows:
            out[y] = v
        return np.concatenate([out, by_beta])

    def greatest_sum(self, motifs: list[Motif]) -> float:
        """The greatest partition function of a read at unit affinity of the first motif."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = 0.0
            for batch in batches:
                for codes in _by_length(batch.column(0).to_pylist()):
                    if len(codes):
                        top = max(top, float(sum(z.sum(axis=1) for _, z in _sites(codes, motifs)).max()))
            yield pa.record_batch([pa.array([top])], names=["z"])

        return self.reads.select("seq").mapInArrow(work, "z double").agg({"z": "max"}).first()[0] or 0.0

    def best_betas(self, s: State, low: float = 1e-9, high: float = 1.0) -> Parameters:
        """Each sample's background share by a nested log-spaced search; no pass over the reads."""
        betas = s.parameters.betas.copy()
        for j in range(len(betas)):

            def err(b: float, j=j) -> float:
                w = s.q[j] + self.f0_counts * b
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.where(self.f0 > 0, w / self.f0 / w.sum(), 1.0)
                return float((((r - self.observed[j]) * self.kmer_weights) ** 2).mean())

            betas[j] = minimise_log(err, low, high)
        return Parameters(s.parameters.motifs, betas)

    def rebeta(self, s: State) -> State:
        return self._close(self.best_betas(s), s.free, s.q)


def _by_length(seqs: list[str]) -> Iterator[np.ndarray]:
    groups: dict[int, list[str]] = {}
    for x in seqs:
        if x:
            groups.setdefault(len(x), []).append(x)
    for n, own in groups.items():
        codes = _CODE[np.frombuffer("".join(own).encode("ascii", "replace"), np.uint8).reshape(-1, n)]
        yield codes[(codes < 4).all(axis=1)]


def _flanked(codes: np.ndarray, n: int) -> np.ndarray:
    left = _CODE[np.frombuffer(sq.ADAPTER_5[len(sq.ADAPTER_5) - n :].encode() if n else b"", np.uint8)]
    right = _CODE[np.frombuffer(sq.ADAPTER_3[:n].encode(), np.uint8)]
    return np.hstack([np.broadcast_to(left, (len(codes), n)), codes, np.broadcast_to(right, (len(codes), n))])


def _kmer_index(codes: np.ndarray, k: int) -> np.ndarray:
    x = _flanked(codes, k - 1).astype(np.int64)
    out = np.zeros((len(x), x.shape[1] - k + 1), np.int64)
    for i in range(k):
        out = out * 4 + x[:, i : i + out.shape[1]]
    return out


def _sites(codes: np.ndarray, motifs: list[Motif]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each motif the letters of the flanked reads and the weight of each site, relative to the first motif's affinity."""
    out = []
    for m in motifs:
        x = _flanked(codes, m.width - 1)
        n = x.shape[1] - m.width + 1
        z = np.full((len(x), n), m.a0 / motifs[0].a0)
        for d in range(m.width):
            z *= m.matrix[d][x[:, d : d + n]]
        out.append((x, z))
    return out


def _occupancy(motifs: list[Motif], free: np.ndarray, linear: bool) -> Callable:
    """Weights of a batch of equal-length reads: psi for each sample."""

    def weigh(codes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, int]:
        total = sum(z.sum(axis=1) for _, z in _sites(codes, motifs))
        y = total[:, None] * free[None, :] * motifs[0].a0
        return (y if linear else y / (y + 1)), len(free)

    return weigh


def minimise_log(f: Callable[[float], float], low: float, high: float, points: int = 15, rounds: int = 6) -> float:
    """Least of a function of one positive variable: a log grid, narrowed around its least again and again."""
    a, b = math.log(low), math.log(high)
    best = a
    for _ in range(rounds):
        grid = np.linspace(a, b, points)
        values = [f(math.exp(x)) for x in grid]
        i = int(np.argmin(values))
        best = grid[i]
        a, b = grid[max(0, i - 1)], grid[min(points - 1, i + 1)]
    return math.exp(best)


def empirical_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, eps: float = 1e-4) -> np.ndarray:
    """Central differences, for tests."""
    out = np.zeros_like(x)
    for i in range(len(x)):
        d = np.zeros_like(x)
        d[i] = eps * max(1.0, abs(x[i]))
        out[i] = (f(x + d) - f(x - d)) / (2 * d[i])
    return out


@dataclass
class Descent:
    parameters: Parameters
    history: list[dict] = field(default_factory=list)
    status: str = ""


def descend(model: Model, start: Parameters, steps: int = 500, seconds: float = 41_400, eps: float = 1e-4, tau: int = 23, decay: float = 0.5, on_step: Callable[[int, State], None] | None = None) -> Descent:
    """Smoothed, scaled gradient steps with a log-spaced line search; ends when the error no longer falls over tau steps, or at a limit."""
    out, began = Descent(start), time.time()
    state = model.rebeta(model.state(start))
    mean, square = None, None
    for t in range(steps):
        out.parameters = state.parameters
        out.history.append({"t": t, "error": state.error, "params": state.parameters.vector().tolist()})
        if on_step:
            on_step(t, state)
        g = model.gradient(state)
        mean = g if mean is None else decay * mean + (1 - decay) * g
        square = g * g if square is None else decay * square + (1 - decay) * g * g
        vec = -mean / (np.sqrt(square) + 1e-12)
        n = len(state.parameters.betas)
        vec[-n:] = 0  # background shares are refitted after every step
        at = 0
        for m in state.parameters.motifs:
            vec[at] *= m.a0
            at += 1 + m.matrix.size

        def after(step: float, vec=vec, state=state) -> State:
            return model.rebeta(model.state(state.parameters.moved(vec * step)))

        steps_ = [1e-4, 1e-3, 1e-2, 5e-2, 0.2]
        tried = [after(x).error for x in steps_]
        i = int(np.argmin(tried))
        if tried[i] >= state.error:
            out.status = "CONVERGED no step lowers the error"
            break
        state = after(steps_[i])
        errors = [h["error"] for h in out.history[-tau:]] + [state.error]
        if len(errors) > tau and (errors[0] - errors[-1]) / tau < eps * errors[-1]:
            out.status = "CONVERGED"
            break
        if time.time() - began > seconds:
            out.status = "TIME"
            break
    out.parameters = state.parameters
    out.history.append({"t": len(out.history), "error": state.error, "params": state.parameters.vector().tolist()})
    out.status = out.status or "STEPS"
    return out


def tune_a0(model: Model, p: Parameters, low: float = 0.1, high: float = 10.0) -> Parameters:
    """All affinities scaled by one factor that lowers the error most."""

    def scaled(x: float) -> Parameters:
        return Parameters([replace(m, a0=m.a0 * x) for m in p.motifs], p.betas)

    return scaled(minimise_log(lambda x: model.rebeta(model.state(scaled(x))).error, low, high, points=5, rounds=3))
