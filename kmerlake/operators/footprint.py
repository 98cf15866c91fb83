"""Footprints: mean accessibility around bound sites, and the accessibility scale that explains the pull-down's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions.energy import accessibility
from kmerlake.operators.motifs import Motif
from kmerlake.operators.ordering import exact_quantiles
from kmerlake.operators.windows import by_length, encode, lists, products


def synthetic_energies(reads: DataFrame, k: int) -> DataFrame:
    """reads with e, open energies in kcal/mol for each window of k bases: a deterministic stand-in for a folding program, without physical meaning."""
    e = F.transform(F.sequence(F.lit(0), F.length("seq") - k), lambda i: F.pmod(F.col("read_id") * 31 + i * 17, F.lit(97)) / 24.25)
    return reads.withColumn("e", e)


def with_accessibility(reads: DataFrame, celsius: float = 4.0, scale: float = 1.0) -> DataFrame:
    return reads.withColumn("acc", F.transform("e", lambda x: accessibility(x, celsius, scale)))


def joined_energies(reads: DataFrame, energies: DataFrame, width: int) -> DataFrame:
    """reads with e from energies(conc, read_id, e); where it is missing the read counts as open, energies of 0, and `missing` is set."""
    rows = reads.join(energies, ["conc", "read_id"], "left")
    return rows.withColumn("missing", F.col("e").isNull()).withColumn("e", F.coalesce("e", F.array_repeat(F.lit(0.0), width)))


def informative_reads(reads: DataFrame, z: str = "z", share: float = 1e-3) -> DataFrame:
    """Reads whose z is above a share of the greatest; above the median if that keeps over half of them."""
    top = reads.agg(F.max(z)).first()[0]
    if top is None:
        return reads
    cut = share * top
    n = reads.agg(F.avg((F.col(z) > cut).cast("double"))).first()[0]
    if n > 0.5:
        cut = exact_quantiles(reads, z, [0.5]).first()["value"]
    return reads.where(F.col(z) > cut)


def _sums(rows: DataFrame, motif: Motif, pad: int, psi: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, columns: int) -> DataFrame:
    """(conc, rel, i, top, low): sums over rows(conc, seq, acc, w) and their sites of weight times accessibility, and of the weight, at each place around a site; psi(site weights, accessibilities) gives further weights of a read, one a column."""
    reach = np.arange(-pad, motif.width + pad)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[float, np.ndarray] = {}
        for batch in batches:
            conc, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 3))
            seqs = [s or "" for s in batch.column(1).to_pylist()]
            values, start, size = lists(batch.column(2))
            for at in by_length(seqs, size) if seqs else ():
                n, width = int(size[at[0]]), len(seqs[at[0]]) - motif.width + 1
                if not n or width < 1:
                    continue
                z = products(encode([seqs[i] for i in at], 0), motif)
                acc = values[start[at][:, None] + np.arange(n)]
                more = np.ones((len(at), 1)) if psi is None else psi(z, acc)
                z = z * np.nan_to_num(w[at])[:, None]
                open_, known = np.nan_to_num(acc), (~np.isnan(acc)).astype(float)
                for c in np.unique(conc[at]):
                    own = totals.setdefault(float(c), np.zeros((2, columns, len(reach))))
                    mine = conc[at] == c
                    for k, rel in enumerate(reach):
                        lo, hi = max(0, -rel), min(width, n - rel)
                        if lo < hi:
                            part = z[mine, lo:hi]
                            own[0, :, k] += more[mine].T @ (part * open_[mine, lo + rel : hi + rel]).sum(axis=1)
                            own[1, :, k] += more[mine].T @ (part * known[mine, lo + rel : hi + rel]).sum(axis=1)
        for c, own in totals.items():
            i, k = np.indices((columns, len(reach)))
            yield pa.record_batch([pa.array(np.full(i.size, c)), pa.array(reach[k.ravel()].astype(np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(own[0].ravel()), pa.array(own[1].ravel())], names=["conc", "rel", "i", "top", "low"])

    rows = rows.select(F.col("conc").cast("double"), F.col("seq").cast("string"), F.col("acc").cast("array<double>"), F.col("w").cast("double"))
    return rows.mapInArrow(work, "conc double, rel int, i int, top double, low double").groupBy("conc", "rel", "i").agg(F.sum("top").alias("top"), F.sum("low").alias("low")).where("low > 0")


def footprint(reads: DataFrame, motif: Motif, weight: Column | None = None, pad: int = 5) -> DataFrame:
    """(conc, rel, acc): mean accessibility at each place from pad before a site to pad behind it, weighed by the site's affinity and the read's weight.

    A task adds up the places of its reads in arrays and returns a row for each sample and place.
    """
    sums = _sums(reads.select("conc", "seq", "acc", (F.lit(1.0) if weight is None else weight).alias("w")), motif, pad, None, 1)
    return sums.select("conc", "rel", (F.col("top") / F.col("low")).alias("acc"))


def calibrate(reads: DataFrame, motif: Motif, shifts: range, free: float, scales: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), pad: int = 5) -> DataFrame:
    """(shift, scale, error) over a grid: how far the input's footprint under predicted occupancies is from the pull-down's.

    A read's occupancy at a grid point weighs its sites by the accessibility `shift` bases on, to the power of `scale`;
    all grid points are columns of one pass over the input reads.
    """
    spark = reads.sparkSession
    target = footprint(reads.where("conc <> 0"), motif, pad=pad).groupBy("rel").agg(F.avg("acc").alias("seen"))
    points = [(s, a) for s in shifts for a in scales]

    def psi(z: np.ndarray, acc: np.ndarray) -> np.ndarray:
        out = np.zeros((len(z), len(points)))
        for i, (shift, scale) in enumerate(points):
            open_ = np.zeros(z.shape)
            lo, hi = max(0, -shift), min(z.shape[1], acc.shape[1] - shift)
            if lo < hi:
                open_[:, lo:hi] = np.nan_to_num(acc[:, lo + shift : hi + shift])
            y = (z * open_**scale).sum(axis=1) * (free * motif.a0)
            out[:, i] = y / (y + 1)
        return out

    sums = _sums(reads.where("conc = 0").select("conc", "seq", "acc", F.lit(1.0).alias("w")), motif, pad, psi, len(points))
    made = sums.select("rel", F.col("i").alias("point"), (F.col("top") / F.col("low")).alias("acc"))
    grid = spark.createDataFrame([(i, s, float(a)) for i, (s, a) in enumerate(points)], "point int, shift int, scale double")
    return made.join(F.broadcast(target), "rel").groupBy("point").agg(F.sum((F.col("acc") - F.col("seen")) ** 2).alias("error")).join(F.broadcast(grid), "point").select("shift", "scale", "error")


def complete_records(energies: DataFrame) -> DataFrame:
    """(conc, records): reads for which energies of every k are there; energies(conc, read_id, k)."""
    return energies.groupBy("conc", "k").agg(F.count_distinct("read_id").alias("n")).groupBy("conc").agg(F.min("n").alias("records"))


def unfolded(reads: DataFrame, energies: DataFrame) -> DataFrame:
    """Reads that an interrupted folding run has yet to do."""
    return reads.join(energies.select("conc", "read_id"), ["conc", "read_id"], "left_anti")


def good_footprint(overlap: Column, rel_err: Column, least_overlap: float = 0.5, most_err: float = 0.9) -> Column:
    return (overlap > least_overlap) & (rel_err < most_err)
