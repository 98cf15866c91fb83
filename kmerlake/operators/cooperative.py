"""Several proteins on one read: sites exclude each other and neighbours may help or hinder, by a transfer matrix.

A state is what ends at a base: a free base, or a site of one protein. Forward sums go along the read once, backward
sums once more, so all placements are weighed in time linear in the read. Reads of equal length in an Arrow batch are
worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.operators.motifs import Motif
from kmerlake.operators.windows import by_length, encode, products

@dataclass(frozen=True)
class Binding:
    """Proteins at free concentrations, and how the kinds of consecutive sites change each other's weight.

    Two consecutive sites at most `reach` free bases apart, of proteins a (left) and b (right), multiply their weight by
    cooperativity[a, b]: above 1 they help each other, below they hinder, 0 excludes. Sites never overlap.
    """

    motifs: list[Motif]
    free: list[float]
    cooperativity: np.ndarray | None = None
    reach: int = 0
    flank: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "flank", max(m.width for m in self.motifs) - 1)
        n = len(self.motifs)
        object.__setattr__(self, "cooperativity", np.ones((n, n)) if self.cooperativity is None else np.asarray(self.cooperativity, float))
        if len(self.free) != n or self.cooperativity.shape != (n, n) or (self.cooperativity < 0).any() or self.reach < 0:
            raise ValueError("one free concentration a motif, and a square of weights that are not negative")


def forward(weights: list[np.ndarray], widths: list[int], length: int, coop: np.ndarray, reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(log, ends): ln of the sum over placements on the first i bases, and for each protein the share of those whose last base is a site's end.

    Sums are kept as logs and shares, so neither long reads nor strong sites overflow.
    """
    rows = len(weights[0])
    log = np.zeros((rows, length + 1))
    ends = [np.zeros((rows, length + 1)) for _ in widths]
    for i in range(1, length + 1):
        terms = []
        for a, w in enumerate(widths):
            if i < w:
                terms.append(np.zeros(rows))
                continue
            start = i - w
            near = np.ones(rows)
            for b in range(len(widths)):
                if coop[b, a] != 1:
                    for d in range(min(reach, start) + 1):
                        near = near + (coop[b, a] - 1) * ends[b][:, start - d] * np.exp(log[:, start - d] - log[:, start])
            terms.append(weights[a][:, start] * np.exp(log[:, start] - log[:, i - 1]) * np.maximum(near, 0))
        grown = 1 + sum(terms)
        log[:, i] = log[:, i - 1] + np.log(grown)
        for a, t in enumerate(terms):
            ends[a][:, i] = t / grown
    return log, ends


def occupancies(weights: list[np.ndarray], widths: list[int], length: int, coop: np.ndarray, reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ln Z, for each protein the probability of each site)."""
    log, ends = forward(weights, widths, length, coop, reach)
    back, begins = forward([x[:, ::-1] for x in weights], widths, length, coop.T, reach)  # the read from its other end
    out = []
    for a, w in enumerate(widths):
        p = np.zeros_like(weights[a])
        for s in range(weights[a].shape[1]):
            # A site's weight with its left side is ends x forward sum; the right side is that of a reversed read.
            j = length - s - w
            near = np.ones(len(p))
            for b in range(len(widths)):
                if coop[a, b] != 1:
                    for d in range(min(reach, j) + 1):
                        near = near + (coop[a, b] - 1) * begins[b][:, j - d] * np.exp(back[:, j - d] - back[:, j])
            p[:, s] = ends[a][:, s + w] * np.exp(log[:, s + w] + back[:, j] - log[:, length]) * np.maximum(near, 0)
        out.append(p)
    return log[:, length], out


def _blocks(batch: pa.RecordBatch, column: int, flank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, codes) of a batch's sequences of each length; null ones count as empty."""
    seqs = [s or "" for s in batch.column(column).to_pylist()]
    for at in by_length(seqs) if seqs else ():
        yield at, encode([seqs[i] for i in at], flank)


def _weights(codes: np.ndarray, binding: Binding, rows: np.ndarray, acc: list) -> list[np.ndarray]:
    out = []
    for a, (m, c) in enumerate(zip(binding.motifs, binding.free)):
        x = products(codes, m) * (m.a0 * c)
        if acc:
            open_ = np.zeros_like(x)
            for r, i in enumerate(rows):
                own = acc[i] or []
                first = max(0, m.acc_shift)
                part = [0.0 if v is None else v for v in own[first : first + x.shape[1]]]
                open_[r, : len(part)] = part
            x = x * open_
        out.append(x)
    return out


def cooperative_binding(reads: DataFrame, binding: Binding, pad: bool = True, acc: str | None = None, profile: bool = False) -> DataFrame:
    """reads with log_z, the natural log of the partition function over all placements of all proteins, p_bound, the probability that any site is bound, and n_bound, the mean number of sites bound for each protein.

    With pad, the ends of the adapters count as part of a read, as many bases as the widest motif reaches over. acc names
    an array with the accessibility of each window; places without one count 0. With profile, `occupancy` is added: for
    each protein the probability that each base lies under one of its sites. Null sequences count as empty, other
    letters than ACGU hold no site, sequences shorter than a motif hold none of its. Repeated rows are repeated.
    """
    plain = [f"c{i}" for i in range(len(reads.columns))]
    inner = reads.toDF(*plain)
    at = plain[[c.lower() for c in reads.columns].index("seq")]
    extra = [F.col(plain[[c.lower() for c in reads.columns].index(acc.lower())]).cast("array<double>").alias("_acc")] if acc else []
    table = inner.select(*plain, F.col(at).cast("string").alias("_seq"), *extra)
    flank = binding.flank if pad else 0
    widths = [m.width for m in binding.motifs]
    coop = binding.cooperativity
    many = pa.list_(pa.float64())
    names = [*plain, "log_z", "p_bound", "n_bound", *(["occupancy"] if profile else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = batch.column(len(plain) + 1).to_pylist() if acc else []
            for rows, codes in _blocks(batch, len(plain), flank):
                length = codes.shape[1]
                log_z, sites = occupancies(_weights(codes, binding, rows, opened), widths, length, coop, binding.reach)
                cols = [pa.array(log_z), pa.array(-np.expm1(-log_z)), pa.array([list(v) for v in zip(*(p.sum(axis=1) for p in sites))], many)]
                if profile:
                    bases = []
                    for p, w in zip(sites, widths):
                        step = np.zeros((len(rows), length + 1))
                        step[:, : p.shape[1]] += p
                        step[:, w : w + p.shape[1]] -= p
                        bases.append(np.cumsum(step, axis=1)[:, :length].clip(0, 1))
                    cols.append(pa.array([[x.tolist() for x in own] for own in zip(*bases)], pa.list_(many)))
                yield pa.RecordBatch.from_arrays([*batch.select(plain).take(pa.array(rows)).columns, *cols], names=names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in table.select(*plain).schema]
    out = table.mapInArrow(work, ", ".join([*kinds, "log_z double", "p_bound double", "n_bound array<double>", *(["occupancy array<array<double>>"] if profile else [])]))
    return out.toDF(*reads.columns, *names[len(plain) :])


def occupancy_profile(reads: DataFrame, binding: Binding, pad: bool = True, acc: str | None = None, by: str = "conc") -> DataFrame:
    """(by, protein, pos, occupancy): mean over reads of the probability that a base is under a site; pos from 0 at the read's first base, adapters before it negative."""
    flank = binding.flank if pad else 0
    rows = cooperative_binding(reads.select(by, "seq", *([acc] if acc else [])), binding, pad, acc, profile=True)
    rows = rows.select(by, F.posexplode("occupancy").alias("protein", "o")).select(by, "protein", F.posexplode("o").alias("pos", "o"))
    return rows.groupBy(by, "protein", (F.col("pos") - flank).alias("pos")).agg(F.avg("o").alias("occupancy"))


def approximation_error(reads: DataFrame, motif: Motif, factors: list[float] | None = None, pad: bool = True, acc: str | None = None) -> DataFrame:
    """reads with kd, the constant of the read as the single-protein approximation has it (1 over its summed affinities), p_at_kd, the exact probability of being bound at that concentration, and rmse, how far the exact binding curve is from c / (c + kd).

    Concentrations are `factors` times each read's own kd, by default 21 from 1/100 to 100 in even log steps. Reads without an affinity have nulls.
    """
    factors = list(10 ** np.linspace(-2, 2, 21)) if factors is None else factors
    plain = [f"c{i}" for i in range(len(reads.columns))]
    lower = [c.lower() for c in reads.columns]
    extra = [F.col(plain[lower.index(acc.lower())]).cast("array<double>").alias("_acc")] if acc else []
    table = reads.toDF(*plain).select("*", F.col(plain[lower.index("seq")]).cast("string").alias("_seq"), *extra)
    unit = Binding([motif], [1.0])
    flank = unit.flank if pad else 0
    names = [*plain, "kd", "p_at_kd", "rmse"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = batch.column(len(plain) + 1).to_pylist() if acc else []
            for rows, codes in _blocks(batch, len(plain), flank):
                x = _weights(codes, unit, rows, opened)[0]
                total = x.sum(axis=1)
                known = total > 0
                x = x / np.where(known, total, 1)[:, None]  # affinity times the read's kd

                def bound(f: float, x=x, length=codes.shape[1]) -> np.ndarray:
                    return -np.expm1(-forward([x * f], [motif.width], length, unit.cooperativity, 0)[0][:, -1])

                square = np.zeros(len(rows))
                for f in factors:
                    square += (bound(f) - f / (f + 1)) ** 2
                found = [1 / np.where(known, total, 1), bound(1.0), np.sqrt(square / len(factors))]
                yield pa.RecordBatch.from_arrays([*batch.select(plain).take(pa.array(rows)).columns, *(pa.array(v, mask=~known) for v in found)], names=names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in table.select(*plain).schema]
    return table.mapInArrow(work, ", ".join([*kinds, "kd double", "p_at_kd double", "rmse double"])).toDF(*reads.columns, "kd", "p_at_kd", "rmse")
