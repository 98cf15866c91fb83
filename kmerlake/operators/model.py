"""The binding model over reads: partition functions, free protein, predicted enrichment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.counts import frequencies, kmer_counts
from kmerlake.operators.motifs import Motif, site_weights
from kmerlake.operators.tokens import dense
from kmerlake.operators.windows import by_length, encode, products


def mixture_weights(motifs: list[Motif], acc: dict[tuple[int, float], Column] | None = None) -> Column:
    """Per read: the summed site weights of all motifs, each relative to the first one's affinity; padded with adapters. acc maps (acc_k, acc_scale) to an accessibility array."""
    total = F.lit(0.0)
    for m in motifs:
        a = (acc or {}).get((m.acc_k, m.acc_scale)) if m.acc_k else None
        sites = site_weights(sq.padded("seq", m.width), m, a, m.acc_shift)
        total = total + F.aggregate(sites, F.lit(0.0), lambda s, x: s + x) * (m.a0 / motifs[0].a0)
    return total


def partition_function(reads: DataFrame, motifs: list[Motif], acc: dict[tuple[int, float], Column] | None = None, clip: float | None = None) -> DataFrame:
    """reads with z: the read's clipped partition function at unit affinity, null for a null sequence. Without accessibilities the windows of a batch of reads are weighed together."""
    if acc:
        z = mixture_weights(motifs, acc)
        return reads.withColumn("z", F.least(z, F.lit(clip)) if clip is not None else z)
    kept = [c for c in reads.columns if c.lower() != "z"]
    table = reads.select(*kept, F.col("seq").cast("string").alias("_seq"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(kept)).to_pylist()
            seqs = [s or "" for s in held]
            z = np.zeros(len(seqs))
            for at in by_length(seqs) if seqs else ():
                own = [seqs[i] for i in at]
                for m in motifs:
                    z[at] += products(encode(own, m.width - 1), m).sum(axis=1) * (m.a0 / motifs[0].a0)
            if clip is not None:
                z = np.minimum(z, clip)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(z, mask=np.array([s is None for s in held], bool))], names=[*kept, "z"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*kept).schema]
    return table.mapInArrow(work, ", ".join([*kinds, "z double"]))


def best_site(sequences: DataFrame, motif: Motif) -> DataFrame:
    """(seq, total, best, at, share): sum of the sites' weights, the greatest, its place from 0 and its share; nulls where the motif does not fit."""
    z = sequences.select("seq", site_weights(F.col("seq"), motif).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + x)
    return z.select("seq", total.alias("total"), F.array_max("z").alias("best"), F.when(F.size("z") > 0, F.array_position("z", F.array_max("z")) - 1).alias("at"), (F.array_max("z") / total).alias("share"))


def single_protein(reads: DataFrame, k: int, affinity: DataFrame, acc: str | None = None) -> DataFrame:
    """(conc, read_id, z): sum of a k-mer affinity table over a read's k-mers, times the accessibility where given. The table of at most 4**k rows is joined by k-mer."""
    x = sq.bound(F.col(acc) if acc else F.lit(None), lambda own: F.transform(sq.kmers("seq", k), lambda m, i: F.struct(m.alias("kmer"), (F.get(own, i) if acc else F.lit(1.0)).alias("a"))))
    rows = reads.select("conc", "read_id", F.explode(x).alias("x")).select("conc", "read_id", F.col("x.kmer").alias("kmer"), "x.a")
    return rows.join(affinity, "kmer").groupBy("conc", "read_id").agg(F.sum(F.col("affinity") * F.col("a")).alias("z"))


def site_correlation(reads: DataFrame, a: Motif, b: Motif) -> DataFrame:
    """(dist, s): sum over reads of the product of two motifs' site weights at each separation. A task adds up its reads and returns a row for each separation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, float] = {}
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for at in by_length(seqs) if seqs else ():
                codes = encode([seqs[i] for i in at], 0)
                za, zb = products(codes, a), products(codes, b)
                na, nb = za.shape[1], zb.shape[1]
                for dist in range(1 - na, nb) if na and nb else ():
                    i, j = max(0, -dist), min(na, nb - dist)
                    if i < j:
                        sums[dist] = sums.get(dist, 0.0) + float(np.einsum("ij,ij->", za[:, i:j], zb[:, i + dist : j + dist]))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.float64())], names=["dist", "s"])

    rows = reads.select(F.col("seq").cast("string").alias("seq")).where("seq is not null")
    return rows.mapInArrow(work, "dist int, s double").groupBy("dist").agg(F.sum("s").alias("s"))


@dataclass
class AffinityHistogram:
    """Reads by log-spaced bins of z > 0; enough to solve for the free protein whatever the number of reads."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, reads: DataFrame, bins: int = 1000) -> "AffinityHistogram":
        rows = reads.where("z > 0")
        span = rows.agg(F.min("z").alias("lo"), F.max("z").alias("hi")).first()
        if span["lo"] is None:
            return cls(np.empty(0), np.empty(0))
        lo, hi = float(np.log(span["lo"])), float(np.log(span["hi"]))
        step = (hi - lo) / bins or 1.0
        at = F.least(F.lit(bins - 1), F.floor((F.log("z") - lo) / step))
        got = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect()  # `bins` rows at most
        b = np.array([r["bin"] for r in got], float)
        return cls((np.exp(lo + b * step) + np.exp(lo + (b + 1) * step)) / 2, np.array([r["n"] for r in got], float))

    def free_protein(self, total: float, rna_conc: float, scale: float = 1.0) -> float:
        """Free protein at which bound and free add up to total; the bound part grows with the free one, so halving finds it."""
        if not len(self.z):
            return total
        lo, hi = 0.0, total
        for _ in range(80):
            free = (lo + hi) / 2
            y = free * self.z * scale
            if free + rna_conc * (y / (y + 1) * self.n).sum() / self.n.sum() < total:
                lo = free
            else:
                hi = free
        return (lo + hi) / 2


def occupied(reads: DataFrame, free: float, a0: float, linear: bool = False) -> DataFrame:
    """reads(z) with psi, the probability that the read is bound."""
    y = F.col("z") * free * a0
    return reads.withColumn("psi", y if linear else y / (y + 1))


def bound_counts(reads: DataFrame, k: int, psi: list[Column], pad: bool = True) -> DataFrame:
    """(sample, kmer, q): input k-mers weighed by each sample's occupancy, in one pass."""
    seq = sq.padded("seq", k) if pad else F.col("seq")
    rows = reads.select(F.explode(sq.kmers(seq, k)).alias("kmer"), *[p.alias(f"_p{i}") for i, p in enumerate(psi)])
    sums = rows.groupBy("kmer").agg(*[F.sum(f"_p{i}").alias(f"_p{i}") for i in range(len(psi))])
    return sums.select("kmer", F.posexplode(F.array(*[f"_p{i}" for i in range(len(psi))])).alias("sample", "q"))


def predicted_r(reads: DataFrame, k: int, psi: list[Column], betas: list[float]) -> DataFrame:
    """(sample, kmer, r): predicted enrichment w / (f0 W) with w = q + F0 beta, reads being the input sample."""
    spark = reads.sparkSession
    f0 = dense(kmer_counts(reads, k), k).groupBy("kmer").agg(F.sum("n").alias("n0"))
    whole = f0.agg(F.sum("n0").alias("all0"))
    q = bound_counts(reads, k, psi)
    beta = spark.createDataFrame([(i, float(b)) for i, b in enumerate(betas)], "sample int, beta double")
    w = f0.crossJoin(F.broadcast(beta)).join(q, ["sample", "kmer"], "left").withColumn("w", F.coalesce("q", F.lit(0.0)) + F.col("n0") * F.col("beta"))
    total = w.groupBy("sample").agg(F.sum("w").alias("all_w"))
    return w.join(F.broadcast(total), "sample").crossJoin(F.broadcast(whole)).where("n0 > 0").select("sample", "kmer", (F.col("w") / (F.col("n0") / F.col("all0")) / F.col("all_w")).alias("r"))


def beta_estimates(q: DataFrame, observed: DataFrame, f0: DataFrame) -> DataFrame:
    """(sample, kmer, beta): the background share at which a k-mer's prediction meets its observed enrichment."""
    total = q.groupBy("sample").agg(F.sum("q").alias("all_q"))
    rows = q.join(observed, ["sample", "kmer"]).join(f0, "kmer").join(F.broadcast(total), "sample")
    return rows.where("r <> 1").select("sample", "kmer", ((F.col("r") * F.col("f") * F.col("all_q") - F.col("q")) / (F.col("n0") * (1 - F.col("r")))).alias("beta"))


def ska_weights(reads: DataFrame, k: int, passes: int = 3, pseudo: float = 10.0) -> DataFrame:
    """(kmer, weight): streaming k-mer assignment by batch passes, for one sample's reads against the input's frequencies.

    Each pass shares a read among its k-mers by weight over background, then adds the shares up; weights of a pass are
    fixed, so the order of reads does not matter (the sequential form lets each read see the ones before). A task of a
    pass holds the 4**k sums of its reads; windows with a letter other than ACGU have no share. Rows are reads of their
    own, whatever their id.
    """
    spark = reads.sparkSession
    background = frequencies(kmer_counts(reads.where("conc = 0"), k), k, pseudo).orderBy("kmer").collect()  # 4**k rows
    if not background:
        return spark.createDataFrame([], "kmer string, weight double")
    b = np.array([r["f"] for r in background])
    weights = np.ones(4**k)
    rows = reads.where("conc <> 0 and seq is not null").select(F.col("seq").cast("string").alias("seq"))

    def shares(s: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(s))
            for batch in batches:
                seqs = batch.column(0).to_pylist()
                for at in by_length(seqs) if seqs else ():
                    codes = encode([seqs[i] for i in at], 0).astype(np.int64)
                    width = codes.shape[1] - k + 1
                    if width < 1:
                        continue
                    index = sum(codes[:, d : d + width] * 4 ** (k - 1 - d) for d in range(k))
                    strange = sum((codes[:, d : d + width] == 4) for d in range(k)) > 0 if (codes == 4).any() else np.zeros(index.shape, bool)
                    own = np.where(strange, 0.0, s[np.where(strange, 0, index)])
                    whole = own.sum(axis=1, keepdims=True)
                    own = np.divide(own, whole, out=np.zeros_like(own), where=whole > 0)
                    sums += np.bincount(index[~strange], weights=own[~strange], minlength=len(s))
            seen = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.float64())], names=["kidx", "g"])

        out = np.zeros(len(s))
        for r in rows.mapInArrow(work, "kidx long, g double").groupBy("kidx").agg(F.sum("g").alias("g")).collect():  # 4**k rows
            out[r["kidx"]] = r["g"]
        return out

    for _ in range(passes):
        weights = weights + shares(weights / b)
        weights = weights / weights.sum() * 4**k
    return spark.createDataFrame([(r["kmer"], float(w)) for r, w in zip(background, weights)], "kmer string, weight double")


def concentrations(q_total: float, w_total: float, reads: int, length: int, k: int, rna_conc: float = 1000.0) -> tuple[float, float]:
    """(specific complex, non-specific) in nM from the bound and the whole k-mer weight."""
    unit = rna_conc / (reads * (length + k - 1))
    return q_total * unit, (w_total - q_total) * unit
