"""Comparison of fits: with observations, with measured constants, and between runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.functions.sequence import col
from kmerlake.operators.fit import minimise_log
from kmerlake.operators.statistics import correlations


def predicted_and_observed(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """(sample, kmer, x, y): log2 of predicted and observed enrichments."""
    return predicted.select("sample", "kmer", F.log2("r").alias("x")).join(observed.select("sample", "kmer", F.log2("r").alias("y")), ["sample", "kmer"])


def agreement(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """(sample, error, pearson): mean squared difference of the enrichments and correlation of their logs."""
    rows = predicted.join(observed.select("sample", "kmer", F.col("r").alias("r0")), ["sample", "kmer"])
    return rows.groupBy("sample").agg(F.avg((F.col("r") - F.col("r0")) ** 2).alias("error"), F.corr(F.log2("r"), F.log2("r0")).alias("pearson"))


def constants_agreement(known: DataFrame, predicted: DataFrame) -> DataFrame:
    """known(protein, seq, kd), predicted(seq, affinity) -> (protein, pearson, spearman, n) of ln Kd against the prediction."""
    rows = known.join(predicted, "seq").where("kd > 0 and affinity > 0").select("protein", F.log("kd").alias("x"), (-F.log("affinity")).alias("y"))
    return correlations(rows, "x", "y", "protein")


def log_fold(x: str | Column, y: str | Column) -> Column:
    return F.log10(col(y) / col(x))


def run_differences(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, log_error, d_corr) of two tables (keys, error, corr): log2 ratio of the errors and difference of the correlations."""
    right = b.select(*keys, F.col("error").alias("_error"), F.col("corr").alias("_corr"))
    return a.join(right, list(keys)).select(*keys, F.log2(F.col("error") / F.col("_error")).alias("log_error"), (F.col("corr") - F.col("_corr")).alias("d_corr"))


def structure_effect(fits: DataFrame, *within: str) -> DataFrame:
    """(within, slope, intercept, r2, n) of fits(kd_plain, kd_structure, gc): how the log2 ratio of the dissociation constants with and without structure goes with a motif's mean GC preference."""
    rows = fits.where("kd_plain > 0 and kd_structure > 0 and gc is not null").withColumn("_y", F.log2(F.col("kd_structure") / F.col("kd_plain")))
    return rows.groupBy(*within).agg(F.regr_slope("_y", "gc").alias("slope"), F.regr_intercept("_y", "gc").alias("intercept"), F.regr_r2("_y", "gc").alias("r2"), F.count("*").alias("n"))


def labelled_runs(**runs: DataFrame) -> DataFrame:
    """The tables of several runs below each other, with the run's name."""
    out = None
    for name, df in runs.items():
        part = df.withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def joined_histories(first: DataFrame, second: DataFrame) -> DataFrame:
    """history(run, t, ...) of a run and of its continuation, whose steps are counted on."""
    last = first.groupBy("run").agg((F.max("t") + 1).alias("_t0"))
    return first.unionByName(second.join(last, "run", "left").withColumn("t", F.col("t") + F.coalesce("_t0", F.lit(0))).drop("_t0"))


def footprint_summary(results: DataFrame, least_overlap: float = 0.5, most_err: float = 0.9) -> DataFrame:
    """results(rbp, rel_err, scale, overlap) -> (rbp, mean_err, min_err, mean_scale, failed, all_good)."""
    good = (F.col("overlap") > least_overlap) & (F.col("rel_err") < most_err)
    return results.groupBy("rbp").agg(F.avg("rel_err").alias("mean_err"), F.min("rel_err").alias("min_err"), F.avg("scale").alias("mean_scale"), F.count_if(~good).alias("failed"), F.bool_and(good).alias("all_good"))


def enrichment_class(value: str | Column) -> Column:
    v = col(value)
    return F.when(v > 20, "20+").when(v > 5, "5-20").when(v > 2, "2-5").when(v > 1, "1-2").otherwise("NA")


def domain_class(domains: str | Column) -> Column:
    """The only kind of domain in a comma-separated list, 'mixed' for several, 'NA' for none."""
    kinds = F.array_distinct(F.split(col(domains), ","))
    return F.when(col(domains).isNull(), "NA").when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")


def constant_ranges(quartiles: DataFrame) -> DataFrame:
    """(run, idx, kd_low, kd_high) from the quartiles of an affinity."""
    return quartiles.select("run", "idx", (1 / F.col("q75")).alias("kd_low"), (1 / F.col("q25")).alias("kd_high"))


def background_share(bound: np.ndarray, background: np.ndarray, seen: np.ndarray) -> float:
    """Factor of the background histogram at which, with the bound one, it has the seen one's shape."""
    shape = seen / seen.sum()

    def err(b: float) -> float:
        p = bound + b * background
        return float(((shape - p / p.sum()) ** 2).sum())

    return minimise_log(err, 1e-8, 100.0)


def neighbour_occupancy(affinity: DataFrame, frequency: DataFrame, letters: DataFrame, k: int) -> DataFrame:
    """(kmer, p): chance that a k-mer is there and its site or that of the k-mer one base beside it is bound, averaged over the side.

    affinity(kmer, b), frequency(kmer, p0), letters(nt, q).
    """
    ends = affinity.select("kmer", "b").crossJoin(F.broadcast(letters))  # four rows for each k-mer
    sides = F.array(F.concat(F.expr(f"substring(kmer, 2, {k - 1})"), F.col("nt")), F.concat(F.col("nt"), F.expr(f"left(kmer, {k - 1})")))
    rows = ends.select("kmer", "b", "q", F.explode(sides).alias("beside")).join(affinity.select(F.col("kmer").alias("beside"), F.col("b").alias("b2")), "beside")
    z = F.col("b") + F.col("b2")
    return rows.groupBy("kmer").agg((F.sum(F.col("q") * z / (z + 1)) / 2).alias("_s")).join(frequency, "kmer").select("kmer", (F.col("p0") * F.col("_s")).alias("p"))


def overlap_matrix(k: int) -> np.ndarray:
    """How often one k-mer's site implies, by an overlap with uniform letters, a site of another: 4**k squared, for small k."""
    n = 4**k
    m, x = np.eye(n), np.arange(n)
    for s in range(1, k):
        keep = 4 ** (k - s)
        ahead = (x[:, None] % keep) == (x[None, :] // 4**s)
        m += (ahead + ahead.T) / 4.0**s
    return m


def occupancies_from_r(r: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Occupancies whose overlaps give the enrichments, by least squares, not negative."""
    return np.maximum(np.linalg.lstsq(matrix, r, rcond=None)[0], 0.0)


def complementarity_check(r: DataFrame, energies: DataFrame) -> DataFrame:
    """r(conc, kmer, r), energies(kmer, dg) -> (conc, pearson, spearman, n) of log2 r with the energy of pairing with an adapter, over k-mers at or below the median energy."""
    low = energies.withColumn("_m", F.percentile("dg", F.lit(0.5)).over(Window.partitionBy())).where(F.col("dg") <= F.col("_m")).drop("_m")
    return correlations(r.join(low, "kmer").select("conc", F.log2("r").alias("x"), F.col("dg").alias("y")), "x", "y", "conc")


def subgroup_effects(differences: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, t, n): one-sample t of a difference within each subgroup."""
    return differences.groupBy(group).agg(F.avg(value).alias("mean"), (F.avg(value) / (F.stddev_samp(value) / F.sqrt(F.count(value)))).alias("t"), F.count(value).alias("n"))
