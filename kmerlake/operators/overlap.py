"""Occupancies behind enrichments: a k-mer is enriched by its own sites and by those of k-mers that overlap it.

In the linear model r = M o, M adds to a k-mer's own occupancy those of the k-mers shifted by x bases to either side,
their x new letters weighed by their frequency in the input. A shift's part of M o depends on k - x letters only, so it
is formed by sums over x letters: k x 4**k steps instead of the 16**k of the matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.counts import frequencies, kmer_counts
from kmerlake.operators.resampling import r_values_with_error


@dataclass(frozen=True)
class Overlap:
    """The overlap matrix of k-mers in reads of a length; letters[x - 1] are the frequencies of the 4**x x-mers, 1 in sum."""

    k: int
    length: int
    letters: list[np.ndarray]

    def share(self, x: int) -> float:
        """Share of a read's places at which a k-mer has neighbours x bases away on both sides."""
        places = self.length - self.k + 1
        return max(0.0, (places - 2 * x) / places)

    def times(self, o: np.ndarray) -> np.ndarray:
        out = o.copy()
        for x, f in enumerate(self.letters, 1):
            rest, new = 4 ** (self.k - x), 4**x
            ahead = o.reshape(rest, new) @ f  # by the letters shared with a k-mer further on
            before = f @ o.reshape(new, rest)
            out += self.share(x) * (np.tile(ahead, new) + np.repeat(before, new))
        return out

    def transposed(self, v: np.ndarray) -> np.ndarray:
        out = v.copy()
        for x, f in enumerate(self.letters, 1):
            rest, new = 4 ** (self.k - x), 4**x
            ends, starts = v.reshape(new, rest).sum(axis=0), v.reshape(rest, new).sum(axis=1)
            out += self.share(x) * (np.outer(ends, f).ravel() + np.outer(f, starts).ravel())
        return out

    def dense(self) -> np.ndarray:
        """The matrix itself, for small k."""
        return np.stack([self.times(row) for row in np.eye(4**self.k)], axis=1)

    def bound(self) -> float:
        """Greatest eigenvalue of M'M."""
        v, size = np.ones(4**self.k), 1.0
        for _ in range(60):
            v = self.transposed(self.times(v))
            size = float(np.linalg.norm(v))
            v /= size
        return size * 1.02

    def _unmet(self, o: np.ndarray, pull: np.ndarray) -> float:
        """Greatest gradient component along which o may still move."""
        g = self.transposed(self.times(o)) - pull
        return float(np.abs(np.where(o > 0, g, np.minimum(g, 0))).max())

    def _polished(self, o: np.ndarray, pull: np.ndarray, limit: float, most: int = 500) -> np.ndarray:
        """o with its positive elements moved to the least squares of these alone, by conjugate gradients; what falls below 0 is set to it."""
        free = o > 0
        x, r = o.copy(), np.where(free, pull - self.transposed(self.times(o)), 0)
        p, square = r.copy(), float(r @ r)
        for _ in range(most):
            if square <= limit * limit:
                break
            q = np.where(free, self.transposed(self.times(p)), 0)
            step = square / float(p @ q)
            x += step * p
            r -= step * q
            new = float(r @ r)
            p, square = r + new / square * p, new
        return np.maximum(x, 0)

    def fitted(self, r: np.ndarray, tolerance: float = 1e-11, most: int = 20_000) -> np.ndarray:
        """Occupancies, none negative, whose overlaps come nearest to r: accelerated projected gradient steps, begun anew where they no longer descend, and polished on the elements above 0 whenever these are nearly settled.

        Ends when no gradient component that may move exceeds `tolerance` times the greatest of the start.
        """
        step = 1 / self.bound()
        pull = self.transposed(r)
        o = np.maximum(pull, 0) * step
        ahead, t = o.copy(), 1.0
        scale = max(1e-300, float(np.abs(pull).max()))
        polish = 1e-4
        for i in range(most):
            g = self.transposed(self.times(ahead)) - pull
            new = np.maximum(ahead - step * g, 0)
            if (ahead - new) @ (new - o) > 0:  # uphill: lose the momentum
                ahead, t = o.copy(), 1.0
                continue
            grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / grown * (new - o)
            o, t = new, grown
            if i % 20 == 19:
                unmet = self._unmet(o, pull)
                if tolerance * scale < unmet <= polish * scale:
                    polish /= 10
                    better = self._polished(o, pull, tolerance * scale / 10)
                    if self._unmet(better, pull) < unmet:
                        o, unmet = better, self._unmet(better, pull)
                        ahead, t = o.copy(), 1.0
                if unmet <= tolerance * scale:
                    break
        return o

    def enrichment(self, o: np.ndarray, kappa: np.ndarray, limit: bool = True) -> tuple[np.ndarray, float]:
        """(r, background) that occupancies predict, kappa being the input's k-mer shares; with limit, strong binding counts as its inverse hyperbolic sine."""
        background = float((o * kappa).sum()) * (self.length - 3 * self.k + 2)
        vec = self.times(o) + background
        taken = kappa * (np.arcsinh(1.5 * vec) if limit else vec)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(kappa > 0, taken / taken.sum() / kappa, np.nan), background


def of_input(reads: DataFrame, k: int, pseudo: float = 10.0, length: int | None = None) -> Overlap:
    """The overlap matrix of the input's letters. 4**(k - 1) frequencies at most reach the driver."""
    control = reads.where("conc = 0")
    if length is None:
        length = control.agg(F.max(F.length("seq"))).first()[0] or k
    out = None
    for x in range(1, k):
        part = frequencies(kmer_counts(control, x), x, pseudo).select(F.lit(x).alias("x"), sq.kmer_index("kmer").alias("i"), (F.col("f") / 4**x).alias("f"))
        out = part if out is None else out.unionByName(part)
    letters = [np.full(4**x, 0.25**x) for x in range(1, k)]
    if out is not None:
        t = out.toArrow()
        xs, at, f = (t.column(c).to_numpy() for c in ("x", "i", "f"))
        for x in range(1, k):
            letters[x - 1][at[xs == x]] = f[xs == x]
    return Overlap(k, int(length), letters)


def occupancies(values: DataFrame, overlap: Overlap, *columns: str) -> DataFrame:
    """values(conc, kmer, columns) -> (conc, kmer, columns) with each column's occupancies instead.

    One task solves one column of one sample, a vector of 4**k numbers whatever the number of reads. K-mers that are
    missing or null count as 0, repeated ones as their last; the result has all 4**k.
    """
    k = overlap.k
    rows = values.select("conc", sq.kmer_index("kmer").alias("i"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("column", "v"))
    kind = pa.schema([("conc", pa.float64()), ("column", pa.int32()), ("i", pa.int64()), ("v", pa.float64())])

    def solve(table: pa.Table) -> pa.Table:
        r = np.zeros(4**k)
        at, v = table.column("i").to_numpy(), table.column("v").to_numpy(zero_copy_only=False).astype(float)
        r[at] = np.nan_to_num(v)
        n = 4**k
        return pa.table([pa.array(np.full(n, table.column("conc")[0].as_py())), pa.array(np.full(n, table.column("column")[0].as_py(), np.int32)), pa.array(np.arange(n)), pa.array(overlap.fitted(r))], schema=kind)

    solved = rows.select(F.col("conc").cast("double"), "column", "i", "v").groupBy("conc", "column").applyInArrow(solve, "conc double, column int, i long, v double")
    named = [F.max(F.when(F.col("column") == c, F.col("v"))).alias(name) for c, name in enumerate(columns)]
    return solved.groupBy("conc", "i").agg(*named).select("conc", sq.index_kmer("i", k).alias("kmer"), *columns)


def o_values(reads: DataFrame, k: int, replicates: int = 10, pseudo: float = 10.0, length: int | None = None) -> DataFrame:
    """(conc, kmer, o, err): occupancies fitted to the enrichments, and the greater of their changes when each enrichment is lowered or raised by its bootstrap error."""
    r = r_values_with_error(reads, k, replicates, pseudo)
    fits = occupancies(r.select("conc", "kmer", F.col("r").alias("o"), (F.col("r") - F.col("err")).alias("low"), (F.col("r") + F.col("err")).alias("high")), of_input(reads, k, pseudo, length), "o", "low", "high")
    return fits.select("conc", "kmer", "o", F.greatest(F.abs(F.col("o") - F.col("low")), F.abs(F.col("o") - F.col("high"))).alias("err"))


def predicted_enrichment(occupied: DataFrame, overlap: Overlap, kappa: DataFrame, limit: bool = True) -> DataFrame:
    """occupied(conc, kmer, o), kappa(kmer, share) -> (conc, kmer, r, background) that occupancies predict through their overlaps; null where the input has no share."""
    k = overlap.k
    shares = np.zeros(4**k)
    for row in kappa.select(sq.kmer_index("kmer").alias("i"), "share").toLocalIterator():  # 4**k rows
        shares[row["i"]] = row["share"]

    def predict(table: pa.Table) -> pa.Table:
        o = np.zeros(4**k)
        o[table.column("i").to_numpy()] = np.nan_to_num(table.column("o").to_numpy(zero_copy_only=False).astype(float))
        r, background = overlap.enrichment(o, shares, limit)
        n = 4**k
        return pa.table({"conc": pa.array(np.full(n, table.column("conc")[0].as_py())), "i": pa.array(np.arange(n)), "r": pa.array(r, mask=np.isnan(r)), "background": pa.array(np.full(n, background))})

    rows = occupied.select(F.col("conc").cast("double"), sq.kmer_index("kmer").alias("i"), F.col("o").cast("double"))
    return rows.groupBy("conc").applyInArrow(predict, "conc double, i long, r double, background double").select("conc", sq.index_kmer("i", k).alias("kmer"), "r", "background")
