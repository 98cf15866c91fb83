"""Enrichment metrics: the input sample (lowest concentration, 0) against each pull-down sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import counts as kc
from kmerlake.operators.model import ska_weights
from kmerlake.operators.overlap import o_values
from kmerlake.operators.resampling import r_values_with_error
from kmerlake.operators.tokens import dense, kmer_domain
from kmerlake.sources.shared import cut


def against_input(values: DataFrame, value: str, *keys: str, input_conc: float = 0.0) -> DataFrame:
    """Rows of the pull-down samples with the input's value as `control`. Keys default to kmer."""
    keys = keys or ("kmer",)
    control = values.where(F.col("conc") == input_conc).select(*keys, F.col(value).alias("control"))
    return values.where(F.col("conc") != input_conc).join(control, list(keys))


def ratio(values: DataFrame, value: str, name: str) -> DataFrame:
    return against_input(values, value).select("conc", "kmer", (F.col(value) / F.col("control")).alias(name))


def r_values(reads: DataFrame, k: int, pseudo: float = 10.0) -> DataFrame:
    """(conc, kmer, r): ratio of k-mer frequencies, adapters included."""
    return ratio(kc.frequencies(kc.kmer_counts(reads, k), k, pseudo), "f", "r")


def w_values(reads: DataFrame, k: int, acc: str = "acc") -> DataFrame:
    """(conc, kmer, w): ratio of accessibility-weighted counts per read, pseudo-count 1."""
    n = kc.totals(reads)
    per_read = dense(kc.accessible_counts(reads, k, acc), k, "w").join(F.broadcast(n), "conc").select("conc", "kmer", ((F.col("w") + 1) / F.col("reads")).alias("per_read"))
    return ratio(per_read, "per_read", "w")


def f_ratios(reads: DataFrame, k: int, pseudo: float = 10.0) -> DataFrame:
    """(conc, kmer, f_ratio): ratio of the fractions of reads that hold the k-mer."""
    return ratio(kc.read_fractions(kc.reads_with_kmer(reads, k), kc.totals(reads), k, pseudo), "fraction", "f_ratio")


def _share(found: DataFrame, reads: DataFrame, wanted: list[str], pseudo: float) -> DataFrame:
    """(conc, kmer, fraction) for the wanted k-mers of every sample, absent ones included."""
    spark = reads.sparkSession
    n = kc.totals(reads)
    every = n.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in wanted], "kmer string")))
    joined = every.join(found.select("conc", "kmer", "n_reads"), ["conc", "kmer"], "left")
    return joined.select("conc", "kmer", ((F.coalesce("n_reads", F.lit(0)) + pseudo) / (F.col("reads") + pseudo)).alias("fraction"))


def pure_f_ratios(reads: DataFrame, candidates: list[str], pseudo: float = 10.0) -> DataFrame:
    return ratio(_share(kc.pure_reads(reads, candidates), reads, candidates, pseudo), "fraction", "pure_f_ratio")


def recall_ratios(reads: DataFrame, ranking: list[str], pseudo: float = 10.0) -> DataFrame:
    return ratio(_share(kc.recall_by_rank(reads, ranking), reads, ranking, pseudo), "fraction", "recall_ratio")


def differential_information(reads: DataFrame, k: int) -> DataFrame:
    """(conc, kmer, di) in bits, without pseudo-counts; null where a count is zero."""
    n = dense(kc.kmer_counts(reads, k), k).withColumn("whole", F.sum("n").over(Window.partitionBy("conc")))
    both = against_input(n, "n").join(n.where("conc = 0").select("kmer", F.col("whole").alias("whole_in")), "kmer")
    p = F.col("whole") / (F.col("whole") + F.col("whole_in"))
    px = (F.col("n") + F.col("control")) / (F.col("whole") + F.col("whole_in"))
    pd, pi = F.col("n") / F.col("whole"), F.col("control") / F.col("whole_in")
    di = p * F.log2(pd / (px * p)) + (1 - p) * F.log2(pi / (px * (1 - p)))
    return both.select("conc", "kmer", F.when((F.col("n") > 0) & (F.col("control") > 0), di).alias("di"))


def explained_fraction(reads: DataFrame, ranking: list[str]) -> DataFrame:
    """(conc, fraction): share of reads that hold any of the k-mers."""
    return kc.reads_with_any(reads, ranking).select("conc", (F.col("n_hit") / F.col("n_reads")).alias("fraction"))


def mutual_information(reads: DataFrame, k: int, pseudo: float = 0.0) -> DataFrame:
    """(conc, dist, mi): bits that a k-mer tells of the one at a distance, over the seen pairs."""
    joint = kc.joint_frequencies(reads, k, pseudo)
    fa, fb = (F.sum("f").over(Window.partitionBy("conc", "dist", c)) for c in ("kmer_a", "kmer_b"))  # 4**k rows at most
    rows = joint.withColumn("fa", fa).withColumn("fb", fb)
    return rows.groupBy("conc", "dist").agg(F.sum(F.col("f") * F.log2(F.col("f") / (F.col("fa") * F.col("fb")))).alias("mi"))


def flank_divergence(reads: DataFrame, core: str, k_flank: int, pseudo: float = 10.0) -> DataFrame:
    """(conc, rel, flank, log_ratio, kl_term) of flanking k-mers against the input; 0 where the flank overlaps the core."""
    spark = reads.sparkSession
    n = cut(kc.flank_profile(reads, core, k_flank))  # a row for each sample, place and flank; the reads are gone through once
    every = n.select("rel").distinct().crossJoin(F.broadcast(n.select("conc").distinct())).crossJoin(F.broadcast(kmer_domain(spark, k_flank).select(F.col("kmer").alias("flank"))))
    full = every.join(n, ["conc", "rel", "flank"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + pseudo)
    f = full.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("conc", "rel")))
    both = against_input(f, "f", "rel", "flank")
    masked = (F.col("rel") > -k_flank) & (F.col("rel") < len(core))
    lr = F.when(masked, 0.0).otherwise(F.log2(F.col("f") / F.col("control")))
    return both.select("conc", "rel", "flank", lr.alias("log_ratio"), (lr * F.col("f")).alias("kl_term"))


def top_interactors(divergence: DataFrame, n: int = 10) -> DataFrame:
    """(flank, best): the flanking k-mers of greatest single KL term."""
    return divergence.groupBy("flank").agg(F.max("kl_term").alias("best")).orderBy(F.desc("best"), "flank").limit(n)


def cooccurrence_ratios(reads: DataFrame, wanted: list[str], length: int = 40) -> DataFrame:
    """(conc, kmer_a, kmer_b, dist, log_expected, log_input): observed pairs against those expected from the positions, and against the input's."""
    n = kc.cooccurrence(reads, wanted)
    expected = kc.expected_cooccurrence(kc.position_profile(reads, len(wanted[0])), kc.totals(reads), wanted, length)
    keys = ["kmer_a", "kmer_b", "dist"]
    control = n.where("conc = 0").select(*keys, F.col("n").alias("control"))
    rows = n.where("conc <> 0").join(expected, ["conc", *keys], "left").join(control, keys, "left")
    return rows.select(
        "conc", *keys,
        F.log2((F.col("n") + 1) / (F.coalesce("expected", F.lit(0.0)) + 1)).alias("log_expected"),
        F.log2((F.col("n") + 1) / (F.coalesce("control", F.lit(0)) + 1)).alias("log_input"),
    )


def count_modes(reads: DataFrame, k: int, rna_conc: float = 1000.0, pseudo: float = 10.0, length: int = 40) -> DataFrame:
    """(conc, kmer, count, freq, rfreq, nm): the four ways to report a k-mer."""
    n = dense(kc.kmer_counts(reads, k), k)
    f = kc.frequencies(n, k, pseudo)
    return n.join(f, ["conc", "kmer"]).select("conc", "kmer", F.col("n").alias("count"), F.col("f").alias("freq"), (F.col("f") / 4**k).alias("rfreq"), (F.col("f") / 4**k * rna_conc * (length - k + 1)).alias("nm"))


def accessibility_enrichment(reads: DataFrame, kmer: str, bins: int = 8, low: float = 0.0, high: float = 8.0) -> DataFrame:
    """(conc, bin, ratio): occurrences of a k-mer by open-energy bin, their share against the input's."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("e") - low) / ((high - low) / bins)))).cast("int")
    n = kc.energies_of(reads, kmer).groupBy("conc", at.alias("bin")).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("conc")))
    return against_input(share, "share", "bin").select("conc", "bin", (F.col("share") / F.col("control")).alias("ratio"))


def extrapolated_frequencies(reads: DataFrame, k: int, level: int = 2, pseudo: float = 10.0) -> DataFrame:
    """(conc, kmer, p): k-mer probabilities from those of (level - 1)-mers and the transitions between them."""

    first = kc.frequencies(kc.kmer_counts(reads, level - 1), level - 1, pseudo)
    start = first.select("conc", F.col("kmer").alias("_state"), (F.col("f") / 4 ** (level - 1)).alias("_p0"))
    step = kc.frequencies(kc.kmer_counts(reads, level), level, pseudo)
    step = step.withColumn("q", F.col("f") / F.sum("f").over(Window.partitionBy("conc", F.expr(f"left(kmer, {level - 1})")))).select("conc", F.col("kmer").alias("_step"), "q")
    every = kmer_domain(reads.sparkSession, k).select("kmer", F.expr(f"left(kmer, {level - 1})").alias("_state"))
    out = every.join(F.broadcast(start), "_state").select("conc", "kmer", F.log("_p0").alias("_log"))
    steps = every.select("kmer", F.posexplode(sq.kmers("kmer", level)).alias("_i", "_step")).join(F.broadcast(step), "_step").groupBy("conc", "kmer").agg(F.sum(F.log("q")).alias("_steps"))
    return out.join(steps, ["conc", "kmer"]).select("conc", "kmer", F.exp(F.col("_log") + F.col("_steps")).alias("p"))


METRICS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "R_value": r_values,
    "F_ratio": f_ratios,
    "DI": differential_information,
    "W_value": w_values,
    "O_value": lambda reads, k: o_values(reads, k).select("conc", "kmer", "o"),
    "pure_F_ratio": lambda reads, k: pure_f_ratios(reads, _ranking(reads, k)),
    "recall_ratio": lambda reads, k: recall_ratios(reads, _ranking(reads, k)),
    "SKA_weight": lambda reads, k: _for_each_sample(reads, lambda own: ska_weights(own, k)),
}

#: Metrics that come with an error: (conc, kmer, value, err).
WITH_ERROR: dict[str, Callable[[DataFrame, int], DataFrame]] = {"R_value": r_values_with_error, "O_value": o_values}
#: K-mers that a metric over ranked candidates takes.
CANDIDATES = 100


def _ranking(reads: DataFrame, k: int) -> list[str]:
    """The k-mers of greatest mean enrichment, best first, at most CANDIDATES."""
    return [x["kmer"] for x in r_values(reads, k).groupBy("kmer").agg(F.avg("r").alias("r")).orderBy(F.desc("r"), "kmer").limit(CANDIDATES).collect()]


def _for_each_sample(reads: DataFrame, metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A metric of one pull-down sample against the input, for each sample."""
    out = None
    for row in reads.where("conc <> 0").select("conc").distinct().orderBy("conc").collect():
        part = metric(reads.where(F.col("conc").isin(0.0, row["conc"])))
        part = part.select(F.lit(row["conc"]).alias("conc"), *part.columns)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there is no pull-down sample")
    return out


def metric(name: str, reads: DataFrame, k: int) -> DataFrame:
    """(conc, kmer, metric, value) of a registered metric. W_value takes reads with an accessibility array `acc`."""
    found = METRICS[name](reads, k)
    return found.select("conc", "kmer", F.lit(name).alias("metric"), F.col(found.columns[-1]).alias("value"))


def metric_with_error(name: str, reads: DataFrame, k: int) -> DataFrame:
    """(conc, kmer, metric, value, err); err is null for a metric without one."""
    if name not in WITH_ERROR:
        return metric(name, reads, k).withColumn("err", F.lit(None).cast("double"))
    found = WITH_ERROR[name](reads, k)
    return found.select("conc", "kmer", F.lit(name).alias("metric"), F.col(found.columns[-2]).alias("value"), "err")


def gather(reads: DataFrame, names: list[str], k: int) -> DataFrame:
    out = metric(names[0], reads, k)
    for name in names[1:]:
        out = out.unionByName(metric(name, reads, k))
    return out


