"""Seed motifs from the enriched k-mers of a fit: a few hundred k-mers on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.operators.motifs import Motif
from kmerlake.operators.ranking import significant_kmers


def corrected_r(r: DataFrame, q_nonspecific: float = 5.0) -> DataFrame:
    """(kmer, r): mean enrichment over samples, corrected for the non-specific level, which is a low percentile of the means."""
    mean = r.groupBy("kmer").agg(F.avg("r").alias("m"))
    ns = F.percentile("m", F.lit(q_nonspecific / 100)).over(Window.partitionBy())
    return mean.withColumn("_ns", ns).select("kmer", (F.col("m") + F.col("_ns") * (F.col("m") - 1) / (1 - F.col("_ns"))).alias("r"))


@dataclass(eq=False)
class Stack:
    """Weighted k-mers laid over each other; weight[position, nucleotide] is their sum."""

    weight: np.ndarray
    kmers: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, kmer: str, w: float) -> "Stack":
        return cls(_one_hot(kmer) * w, [kmer], [w])

    def align(self, kmer: str) -> tuple[int, float]:
        """(offset, score): the offset of greatest score, at least one base overlapping; columns not covered count their least. The score is relative to the stack's greatest."""
        x, n, k = _one_hot(kmer), len(self.weight), len(kmer)
        least = np.concatenate(([0.0], np.cumsum(self.weight.min(axis=1))))
        padded = np.vstack([np.zeros((k - 1, 4)), self.weight, np.zeros((k - 1, 4))])
        offsets = np.arange(1 - k, n)
        own = np.array([(padded[o + k - 1 : o + 2 * k - 1] * x).sum() for o in offsets])
        outside = least[np.maximum(offsets, 0)] + least[n] - least[np.minimum(offsets + k, n)]
        score = own + outside
        i = int(score.argmax())
        return int(offsets[i]), float(score[i] / self.weight.max(axis=1).sum())

    def blend(self, kmer: str, offset: int, w: float) -> None:
        before, after = max(0, -offset), max(0, offset + len(kmer) - len(self.weight))
        self.weight = np.pad(self.weight, ((before, after), (0, 0)))
        at = offset + before
        self.weight[at : at + len(kmer)] += _one_hot(kmer) * w
        self.kmers.append(kmer)
        self.weights.append(w)

    def motif(self, keep: float = 0.99, widest: int = 11, pseudo: float = 0.0) -> Motif:
        """The shortest window with the share `keep` of the weight, `widest` positions at most (then the fullest of that width), each column raised to the same height."""
        col = self.weight.sum(axis=1)
        total = np.concatenate(([0.0], np.cumsum(col))) / col.sum()
        for width in range(1, min(widest, len(col)) + 1):
            inside = total[width:] - total[:-width]
            i = int(inside.argmax())
            if inside[i] >= keep:
                break
        m = self.weight[i : i + width]
        top = m.max(axis=1, keepdims=True)
        m = m + 1 - top / top.max()
        m = m / m.max(axis=1, keepdims=True) + pseudo
        return Motif.of(m / m.max(axis=1, keepdims=True), max(self.weights))


def _one_hot(kmer: str) -> np.ndarray:
    return np.array([[float(x == nt) for nt in "ACGU"] for x in kmer])


def cluster(kmers: list[tuple[str, float]], threshold: float = 0.75, most: int = 5, n_min: int = 10) -> list[Stack]:
    """Greedy clustering of k-mers given in order of weight.

    The k-mer that fits a stack best joins it; where none reaches the threshold, the heaviest one left founds a new stack
    while there are fewer than `most`. Stacks of fewer than n_min k-mers, but for the largest, are dissolved and theirs dealt out anew.
    """
    left = list(kmers)
    if not left:
        return []
    stacks = [Stack.of(*left.pop(0))]

    def best() -> tuple[int, int, int, float]:
        fits = [max(((*s.align(kmer), j) for j, s in enumerate(stacks)), key=lambda f: (f[1], -f[2])) for kmer, _ in left]
        i = max(range(len(left)), key=lambda i: (fits[i][1], -i))
        return i, fits[i][2], fits[i][0], fits[i][1]

    while left:
        i, j, offset, score = best()
        if score < threshold and len(stacks) < most:
            stacks.append(Stack.of(*left.pop(0)))
        else:
            stacks[j].blend(left[i][0], offset, left[i][1])
            left.pop(i)
    stacks.sort(key=lambda s: -len(s.kmers))
    weak = [s for s in stacks[1:] if len(s.kmers) < n_min]
    stacks = [s for s in stacks if s not in weak]
    left = sorted(((k, w) for s in weak for k, w in zip(s.kmers, s.weights)), key=lambda x: -x[1])
    while left:
        i, j, offset, _ = best()
        stacks[j].blend(left[i][0], offset, left[i][1])
        left.pop(i)
    return sorted(stacks, key=lambda s: -max(s.weights))


def seed_motifs(kmers: list[tuple[str, float]], threshold: float = 0.75, most: int = 5, n_min: int = 10, widest: int = 11, keep: float = 0.99, pseudo: float = 0.0) -> list[Motif]:
    """Motifs of the clusters, padded to one width, in order of affinity."""
    found = [s.motif(keep, widest, pseudo) for s in cluster(kmers, threshold, most, n_min)]
    width = max((m.width for m in found), default=0)
    return sorted((m.padded(width) for m in found), key=lambda m: -m.a0)


def enriched_kmers(r: DataFrame, z_cut: float = 4.0, n_min: int = 10, n_max: int = 1000) -> list[tuple[str, float]]:
    """The significant k-mers and their values in order, n_max at most."""
    return [(x["kmer"], x["r"]) for x in significant_kmers(r, "r", z_cut, n_min, n_max).orderBy("rank").collect()]
