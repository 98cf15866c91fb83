"""Ranks, windows and selections over k-mer metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.operators.ordering import below


def kmer_ranking(r: DataFrame, value: str = "r") -> DataFrame:
    """(kmer, median, rank): k-mers by their median over samples, greatest first; rank from 1."""
    med = r.groupBy("kmer").agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return med.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("median"), "kmer")))  # 4**k rows


def z_scores(values: DataFrame, value: str, *within: str) -> DataFrame:
    """Adds z, by the population's deviation; null where that is 0."""
    w = Window.partitionBy(*within)
    return values.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def share_within(values: DataFrame, value: str, *within: str) -> DataFrame:
    return values.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*within)))


def significant_kmers(values: DataFrame, value: str, z_cut: float = 4.0, n_min: int = 10, n_max: int = 1000) -> DataFrame:
    """The k-mers of z at least z_cut, of these n_max at most and n_min at least in order of value."""
    ranked = z_scores(values, value).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "kmer")))  # 4**k rows
    return ranked.withColumn("cut", F.least(F.lit(n_max), F.greatest(F.lit(n_min), F.sum((F.col("z") >= z_cut).cast("int")).over(Window.partitionBy())))).where("rank <= cut").drop("cut")


def sample_ranks(r: DataFrame, kmer: str, min_r: float = 1.1) -> DataFrame:
    """(conc, r, rank): samples in which the k-mer passes min_r, by its value."""
    return r.where((F.col("kmer") == kmer) & (F.col("r") >= min_r)).select("conc", "r", F.rank().over(Window.orderBy(F.desc("r"))).alias("rank"))


def best_samples(r: DataFrame, ranks: tuple[int, ...] = (1, 2, 3), min_r: float = 1.1) -> DataFrame:
    """(conc, kmer, r, rank): the samples in which the overall best k-mer passes min_r, of the wanted ranks; all samples if none passes."""
    best = r.groupBy("kmer").agg(F.max("r").alias("top")).orderBy(F.desc("top"), "kmer").limit(1).select("kmer")
    rows = r.join(F.broadcast(best), "kmer").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r"), "conc")))
    passed = F.max((F.col("r") >= min_r).cast("int")).over(Window.partitionBy())
    return rows.withColumn("_any", passed).where((F.col("_any") == 0) | ((F.col("r") >= min_r) & F.col("rank").isin(*ranks))).select("conc", "kmer", "r", "rank")


def diagnostic_kmers(r: DataFrame) -> DataFrame:
    """(kmer, score): each sample's best k-mer, by its least value times the share of samples in which it is above 1."""
    best = r.groupBy("conc").agg(F.max_by("kmer", F.struct("r", F.col("kmer"))).alias("kmer")).select("kmer").distinct()
    return r.join(F.broadcast(best), "kmer").groupBy("kmer").agg((F.min("r") * F.avg((F.col("r") > 1).cast("double"))).alias("score"))


def until_insignificant(r: DataFrame, value: str = "r", error: str = "err", cut: float = 1.0, n_min: int = 10) -> DataFrame:
    """k-mers in order of value, up to the first beyond n_min whose value less its error is at most cut."""
    ranked = r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "kmer")))  # 4**k rows
    stop = F.min(F.when((F.col(value) - F.col(error) <= cut) & (F.col("rank") > n_min), F.col("rank"))).over(Window.partitionBy())
    return ranked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("rank") < F.col("_stop"))).drop("_stop")


def top(values: DataFrame, n: int, value: str, *ties: str) -> DataFrame:
    return values.orderBy(F.desc(value), *ties).limit(n)


def capped(rows: DataFrame, n: int, group: list[str], order: list[Column | str]) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def convergence(history: DataFrame, tau: int = 23) -> DataFrame:
    """history(run, t, error) -> adds change, the difference from the step before, and slope over the last tau steps."""
    w = Window.partitionBy("run").orderBy("t")
    return history.withColumn("change", F.col("error") - F.lag("error").over(w)).withColumn("slope", F.regr_slope("error", "t").over(w.rowsBetween(-(tau - 1), 0)))


def forward_filled(history: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn(value, F.last(value, ignorenulls=True).over(w))


def log_changes(history: DataFrame, value: str) -> DataFrame:
    """Adds change: absolute log10 ratio to the step before."""
    w = Window.partitionBy("run", "name").orderBy("t")
    return history.withColumn("change", F.abs(F.log10(F.col(value) / F.lag(value).over(w))))


def near_best(history: DataFrame, within: float = 1.05) -> DataFrame:
    """States whose error is within a factor of their run's least."""
    return history.withColumn("_least", F.min("error").over(Window.partitionBy("run"))).where(F.col("error") <= F.col("_least") * within).drop("_least")


def uncertainty(history: DataFrame, within: float = 1.05, least: int = 10) -> DataFrame:
    """(run, idx, q25, q50, q75) of parameters over the states near the best, where there are enough of them."""
    near = near_best(history, within)
    q = near.groupBy("run", "idx").agg(F.count("*").alias("n"), *[F.percentile("value", F.lit(p)).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)])
    return q.where(F.col("n") >= least)


def cumulative_curve(values: DataFrame, x: str, weight: str, *within: str) -> DataFrame:
    """Adds cum: share of weight at or below x, null where x is. Sums go by value and by range of values, not by a window over the group."""
    sums = below(values, x, *within, w=F.col(weight))
    total = values.groupBy(*within).agg(F.sum(weight).alias("_whole"))
    names = [F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]
    upto = sums.select(*names, F.col(x).alias("_x"), (F.col("w_below") + F.col("w")).alias("_upto"))
    of_group = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(within)]
    rows = values.join(upto, [F.col(x) == F.col("_x"), *of_group], "left").drop("_x", *[f"_w{i}" for i in range(len(within))])
    rows = rows.join(total.select(*names, "_whole"), of_group, "left").drop(*[f"_w{i}" for i in range(len(within))]) if within else rows.crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("cum", F.col("_upto") / F.col("_whole")).drop("_upto", "_whole")


def smoothed(values: DataFrame, x: str, y: str, sigma: float, reach: int, *within: str) -> DataFrame:
    """Adds smooth: Gaussian-weighted mean of y over the rows around, in order of x."""
    w = Window.partitionBy(*within).orderBy(x)
    top_, whole = F.lit(0.0), F.lit(0.0)
    for d in range(-reach, reach + 1):
        g = math.exp(-0.5 * (d / sigma) ** 2)
        v = F.col(y) if not d else F.lead(y, d).over(w) if d > 0 else F.lag(y, -d).over(w)
        top_ = top_ + F.coalesce(v, F.lit(0.0)) * g
        whole = whole + F.when(v.isNotNull(), g).otherwise(0.0)
    return values.withColumn("smooth", top_ / whole)


def most_variable(values: DataFrame, item: str, value: str, n: int = 15) -> DataFrame:
    return values.groupBy(item).agg(F.stddev_pop(value).alias("sd")).orderBy(F.desc("sd"), item).limit(n)
