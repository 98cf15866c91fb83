"""Bootstrap errors of k-mer statistics, all replicates in one pass over the reads.

A read's multiplicities in the replicates are a vector, added up by k-mer next to the count itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.sampling import poisson_weight, replicate_uniform
from kmerlake.operators.tokens import kmer_domain


def multiplicities(replicates: int, key: str = "read_id", fixed: Column | None = None) -> Column:
    """Array with the read's Poisson(1) multiplicity in each replicate; 1 in all of them where `fixed`."""
    drawn = [poisson_weight(replicate_uniform(key, i)) for i in range(replicates)]
    return F.array(*[w if fixed is None else F.when(fixed, 1).otherwise(w) for w in drawn]).cast("array<int>")


def _summed(rows: DataFrame, replicates: int, *keys: str) -> DataFrame:
    """(keys, n, b): rows counted, and their multiplicities added up by replicate."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("_m")[i]).alias(f"_b{i}") for i in range(replicates)])
    return sums.select(*keys, "n", F.array(*[f"_b{i}" for i in range(replicates)]).cast("array<bigint>").alias("b"))


def resampled_counts(reads: DataFrame, k: int, replicates: int = 10, distinct: bool = False, pad: bool = True, input_too: bool = False) -> tuple[DataFrame, DataFrame]:
    """((conc, kmer, n, b) over the full domain of every sample, (conc, n, b) of its reads): counts and those of each replicate.

    With distinct, k-mers count once a read. The input (conc 0) is drawn anew only with input_too. reads are read twice;
    k-mers are shuffled once, one row a k-mer and task, whatever the number of replicates.
    """
    seq = sq.padded("seq", k) if pad else F.col("seq")
    found = F.array_distinct(sq.kmers(seq, k)) if distinct else sq.kmers(seq, k)
    weighed = reads.select("conc", "seq", multiplicities(replicates, fixed=None if input_too else F.col("conc") == 0).alias("_m"))
    counts = _summed(weighed.select("conc", "_m", F.explode(found).alias("kmer")), replicates, "conc", "kmer")
    totals = _summed(weighed, replicates, "conc")
    every = kmer_domain(reads.sparkSession, k).select("kmer").crossJoin(F.broadcast(totals.select("conc")))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), replicates)
    dense = every.join(counts, ["conc", "kmer"], "left").select("conc", "kmer", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("b", zeros).alias("b"))
    return dense, totals


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def deviation(values: Column) -> Column:
    """Population's deviation of an array about its mean; 0 for one element."""
    mean = mean_of(values)
    return sq.bound(mean, lambda m: F.sqrt(mean_of(F.transform(values, lambda x: (x - m) * (x - m)))))


def r_values_with_error(reads: DataFrame, k: int, replicates: int = 10, pseudo: float = 10.0) -> DataFrame:
    """(conc, kmer, r, err): ratio of a sample's k-mer frequencies to the input's, and its deviation over bootstrap replicates of the sample."""
    counts, _ = resampled_counts(reads, k, replicates)
    whole = counts.groupBy("conc").agg((F.sum("n") + pseudo * 4**k).alias("_n"), *[(F.sum(F.col("b")[i]) + pseudo * 4**k).alias(f"_t{i}") for i in range(replicates)])
    whole = whole.select("conc", "_n", F.array(*[f"_t{i}" for i in range(replicates)]).alias("_t"))
    rows = counts.join(F.broadcast(whole), "conc")
    f = (F.col("n") + pseudo) / F.col("_n")
    fb = F.transform("b", lambda x, i: (x + pseudo) / F.get(F.col("_t"), i))
    control = rows.where("conc = 0").select("kmer", f.alias("_f0"))
    out = rows.where("conc <> 0").select("conc", "kmer", f.alias("_f"), fb.alias("_fb")).join(control, "kmer")
    return out.select("conc", "kmer", (F.col("_f") / F.col("_f0")).alias("r"), (deviation(F.col("_fb")) / F.col("_f0")).alias("err"))


def explained_with_error(reads: DataFrame, k: int, replicates: int = 10, pseudo: float = 10.0) -> DataFrame:
    """(conc, kmer, fraction, err): share of a sample's reads that hold the k-mer; err is the root mean square of the replicates' differences from it over the root of their number. The input is drawn anew too."""
    counts, totals = resampled_counts(reads, k, replicates, distinct=True, input_too=True)
    rows = counts.join(F.broadcast(totals.select("conc", F.col("n").alias("_n"), F.col("b").alias("_t"))), "conc")
    share = (F.col("n") + pseudo) / (F.col("_n") + pseudo)
    shares = F.transform("b", lambda x, i: (x + pseudo) / (F.get(F.col("_t"), i) + pseudo))
    rows = rows.select("conc", "kmer", share.alias("fraction"), shares.alias("_s"))
    square = mean_of(F.transform("_s", lambda x: (x - F.col("fraction")) * (x - F.col("fraction"))))
    return rows.select("conc", "kmer", "fraction", F.sqrt(square / replicates).alias("err"))


def subset_explained_with_error(reads: DataFrame, wanted: list[str], replicates: int = 10, pad: bool = True) -> DataFrame:
    """(conc, fraction, err): share of a sample's reads that hold any of the k-mers, with its error as above."""
    k = len(wanted[0])
    seq = sq.padded("seq", k) if pad else F.col("seq")
    hit = F.arrays_overlap(sq.kmers(seq, k), F.array(*map(F.lit, wanted))).cast("int")
    rows = reads.select("conc", hit.alias("_h"), multiplicities(replicates).alias("_m"))
    sums = [F.sum(F.col("_m")[i] * F.col("_h")) / F.sum(F.col("_m")[i]) for i in range(replicates)]
    rows = rows.groupBy("conc").agg(F.avg("_h").alias("fraction"), *[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    square = sum(((F.col(f"_s{i}") - F.col("fraction")) ** 2 for i in range(replicates)), F.lit(0.0))
    return rows.select("conc", "fraction", (F.sqrt(square) / replicates).alias("err"))
