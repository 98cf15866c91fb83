"""Resampling and simulation with reproducible hash uniforms, so that a lost task repeats its draws."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.functions.energy import energy_to_kd


def lcg_uniform(x: str | Column, salt: int = 12345) -> Column:
    """A uniform in [0, 1) of an integer key by one linear congruential step; the same in any SQL engine. The key is taken modulo 2**31 first, which changes no step and keeps its product within a long."""
    return F.pmod(F.pmod(sq.col(x), F.lit(2147483648)) * 1103515245 + salt, F.lit(2147483648)) / 2147483648.0


def replicate_uniform(x: str | Column, i: int) -> Column:
    """A uniform in [0, 1) of an integer key for the i-th replicate, the same in any SQL engine: the middle of the square of a congruential step, so that replicates are not shifts of each other."""
    v = F.pmod(F.pmod(sq.col(x), F.lit(2147483648)) * 1103515245 + (12345 + 610839777 * i) % 2147483648, F.lit(2147483648))
    return sq.bound(v, lambda y: F.pmod(F.shiftright(y * y, 16), F.lit(2147483648)) / 2147483648.0)


def hash_uniform(*cols: Column | str, seed: int = 0) -> Column:
    return (F.pmod(F.xxhash64(*[sq.col(c) for c in cols], F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def poisson_steps(most: int = 8) -> list[tuple[int, float]]:
    """(n, limit): a uniform below the limit, and not below the one before, gives a Poisson(1) variate n; those above all give `most`."""
    p = total = math.exp(-1)
    out = [(0, total)]
    for n in range(1, most):
        p /= n
        total += p
        out.append((n, total))
    return out


def poisson_weight(u: Column, most: int = 8) -> Column:
    """Poisson(1) multiplicity of a uniform: how often a bootstrap with replacement takes the row."""
    out = None
    for n, limit in poisson_steps(most):
        out = F.when(u < limit, n) if out is None else out.when(u < limit, n)
    return out.otherwise(most).cast("int")


def bootstrap(reads: DataFrame, replicates: int, key: str = "read_id") -> DataFrame:
    """Reads with their replicate and multiplicity; those not taken are left out. One row in 1.6 for each replicate, made within the row."""
    weights = F.array(*[F.struct(F.lit(i).alias("replicate"), poisson_weight(replicate_uniform(key, i)).alias("copies")) for i in range(replicates)])
    rows = reads.withColumn("_b", F.explode(F.filter(weights, lambda w: w["copies"] > 0)))
    return rows.withColumn("replicate", F.col("_b.replicate")).withColumn("copies", F.col("_b.copies")).drop("_b")


def with_error(replicated: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, mean, err) over replicates; err is the population's deviation."""
    return replicated.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("err"))


def resampled_metric(reads: DataFrame, metric: Callable[[DataFrame], DataFrame], value: str, replicates: int, *keys: str) -> DataFrame:
    """A metric with its error over bootstrap replicates of the pull-down samples; the input is taken as it is. One pass for each replicate."""
    out = None
    for i in range(replicates):
        copies = F.when(F.col("conc") == 0, 1).otherwise(poisson_weight(replicate_uniform("read_id", i)))
        drawn = reads.withColumn("_c", F.explode(F.array_repeat(F.lit(1), copies))).drop("_c")
        part = metric(drawn)
        out = part if out is None else out.unionByName(part)
    return with_error(out, value, *keys)


def chunk(reads: DataFrame, i: int, of: int, key: str = "read_id") -> DataFrame:
    """The i-th of `of` equal, contiguous ranges of the key. Rows without a key are in none."""
    ends = reads.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return reads.limit(0)
    width = (ends["hi"] - ends["lo"] + of) // of
    first = ends["lo"] + i * width
    return reads.where((F.col(key) >= first) & (F.col(key) < first + width))


def subset(reads: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Reads whose keys, read_id by default, are among the rows of `wanted`; each once, however often it is named. Null keys are in none."""
    keys = keys or ("read_id",)
    return reads.join(wanted.select(*keys), list(keys), "left_semi")


def random_reads(spark: SparkSession, n: int, length: int, seed: int = 0, transition: dict[str, list[float]] | None = None, partitions: int | None = None) -> DataFrame:
    """(read_id, seq) of uniform letters, or of a Markov chain with the given next-letter probabilities (start uniform)."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    u = lambda p: hash_uniform("id", F.lit(p) if isinstance(p, int) else p, seed=seed)
    if transition is None:
        letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda p: F.element_at(F.array(*map(F.lit, sq.NUCLEOTIDES)), (F.floor(u(p) * 4) + 1).cast("int")))
        return ids.select(F.col("id").alias("read_id"), F.array_join(letters, "").alias("seq"))

    def following(last: Column, x: Column) -> Column:
        out = None
        for nt, row in transition.items():
            total, pick = 0.0, None
            for letter, q in zip(sq.NUCLEOTIDES[:-1], row):
                total += q
                pick = F.when(x < total, letter) if pick is None else pick.when(x < total, letter)
            pick = pick.otherwise(sq.NUCLEOTIDES[-1])
            out = F.when(last == nt, pick) if out is None else out.when(last == nt, pick)
        return out.otherwise(F.element_at(F.array(*map(F.lit, sq.NUCLEOTIDES)), (F.floor(x * 4) + 1).cast("int")))

    seq = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.lit(""), lambda s, p: F.concat(s, following(F.substring(s, -1, 1), u(p))))
    return ids.select(F.col("id").alias("read_id"), seq.alias("seq"))


def bound_reads(reads: DataFrame, z: str, nonspecific: float, seed: int = 0) -> DataFrame:
    """Reads that a rejection step accepts: u < 1 - (1 - Z / (Z + 1)) (1 - p_ns)."""
    p = 1 - (1 - F.col(z) / (F.col(z) + 1)) * (1 - nonspecific)
    return reads.where(hash_uniform("read_id", seed=seed) < p)


def simulated_pulldown(reads: DataFrame, concentrations: dict[float, float], psi: str = "psi", per_sample: int | None = None) -> DataFrame:
    """(conc, read_id, seq): reads that each concentration's sample takes, u <= 1 - (1 - psi) (1 - beta) with one u for a read in all of them.

    concentrations maps conc to beta; psi is an array of occupancies in the same order. With per_sample the first rows by read_id are kept.
    """
    options = F.array(*[F.struct(F.lit(float(c)).alias("conc"), F.col(psi)[i].alias("psi"), F.lit(float(b)).alias("beta")) for i, (c, b) in enumerate(concentrations.items())])
    u = lcg_uniform("read_id")
    taken = F.filter(options, lambda o: u <= 1 - (1 - o["psi"]) * (1 - o["beta"]))
    out = reads.select("read_id", "seq", F.explode(taken).alias("o")).select(F.col("o.conc").alias("conc"), "read_id", "seq")
    if per_sample is None:
        return out
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy("conc").orderBy("read_id"))).where(F.col("_rn") <= per_sample).drop("_rn")


def by_affinity(reads: DataFrame, z: str, per_bin: int, low: float = 1e-4, high: float = 1.0, bins: int = 8) -> DataFrame:
    """Up to per_bin reads for each bin of log10 Z, first by read_id."""
    step = (math.log10(high) - math.log10(low)) / (bins - 1)
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.log10(F.col(z)) - math.log10(low)) / step) + 1)).cast("int")
    rows = reads.where(F.col(z) > 0).withColumn("bin", b)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("bin").orderBy("read_id"))).where(F.col("_rn") <= per_bin).drop("_rn")


def lognormal_kds(kmers: DataFrame, mean_energy: float, sd_energy: float, celsius: float = 22.0, seed: int = 0) -> DataFrame:
    """Adds energy (kcal/mol, normal by Box and Muller) and kd (nM) for each k-mer."""
    u, v = hash_uniform("kmer", seed=seed), hash_uniform("kmer", seed=seed + 1)
    e = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v) * sd_energy + mean_energy
    return kmers.withColumn("energy", e).withColumn("kd", energy_to_kd("energy", celsius))


def permuted(rows: DataFrame, value: str, replicates: int, key: str) -> DataFrame:
    """(replicate, key, value) with the values dealt out anew in hash order: a null distribution for a statistic of pairs."""
    w = Window.partitionBy("replicate")
    every = rows.select(key, value).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    a = every.select("replicate", key, F.row_number().over(w.orderBy(key)).alias("_rn"))
    b = every.select("replicate", value, F.row_number().over(w.orderBy(hash_uniform(key, "replicate"), key)).alias("_rn"))
    return a.join(b, ["replicate", "_rn"]).drop("_rn")
