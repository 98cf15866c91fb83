"""Aggregations over k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.pairs import pair_counts
from kmerlake.operators.tokens import dense, kmer_positions, read_kmers


def kmer_counts(reads: DataFrame, k: int, pad: bool = True, **adapters: str) -> DataFrame:
    """(conc, kmer, n). With pad a read contributes L + k - 1 k-mers, else L - k + 1."""
    seq = sq.padded("seq", k, **adapters) if pad else F.col("seq")
    return reads.select("conc", F.explode(sq.kmers(seq, k)).alias("kmer")).groupBy("conc", "kmer").agg(F.count("*").alias("n"))


def kmer_counts_deduplicated(reads: DataFrame, k: int, pad: bool = True) -> DataFrame:
    """kmer_counts() by way of distinct reads: worth its shuffle where reads repeat much."""
    seq = sq.padded("seq", k) if pad else F.col("seq")
    distinct = reads.groupBy("conc", "seq").agg(F.count("*").alias("copies"))
    return distinct.select("conc", "copies", F.explode(sq.kmers(seq, k)).alias("kmer")).groupBy("conc", "kmer").agg(F.sum("copies").alias("n"))


def valid_kmer_counts(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of any sequences, without windows that hold a letter other than ACGU."""
    return sequences.select(F.explode(sq.valid_kmers("seq", k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def counts_per_read(reads: DataFrame, k: int) -> DataFrame:
    """(conc, read_id, kmer, n), made within each row."""
    found = read_kmers(reads, k).select("conc", "read_id", "kmers", F.explode(F.array_distinct("kmers")).alias("kmer"))
    return found.select("conc", "read_id", "kmer", F.size(F.filter("kmers", lambda x: x == F.col("kmer"))).cast("long").alias("n"))


def weighted_counts(reads: DataFrame, k: int, weight: Column, floor: float = 1e-20, pad: bool = True) -> DataFrame:
    """(conc, kmer, w): k-mers counted with their read's weight."""
    seq = sq.padded("seq", k) if pad else F.col("seq")
    return reads.select("conc", weight.alias("w"), F.explode(sq.kmers(seq, k)).alias("kmer")).groupBy("conc", "kmer").agg((F.sum("w") + floor).alias("w"))


def accessible_counts(reads: DataFrame, k: int, acc: str = "acc") -> DataFrame:
    """(conc, kmer, w): k-mers counted with the accessibility at their position; acc is an array with a value for each position."""
    pairs = reads.select("conc", F.explode(F.arrays_zip(sq.kmers("seq", k).alias("kmer"), F.col(acc).alias("a"))).alias("x"))
    return pairs.where("x.kmer is not null and x.a is not null").groupBy("conc", F.col("x.kmer").alias("kmer")).agg(F.sum("x.a").alias("w"))


def reads_with_kmer(reads: DataFrame, k: int, pad: bool = True) -> DataFrame:
    """(conc, kmer, n_reads): reads that hold each k-mer, repeats within a read not counted."""
    return read_kmers(reads, k, pad, distinct=True).select("conc", F.explode("kmers").alias("kmer")).groupBy("conc", "kmer").agg(F.count("*").alias("n_reads"))


def reads_with_any(reads: DataFrame, wanted: list[str], pad: bool = True) -> DataFrame:
    """(conc, n_hit, n_reads): reads that hold any of the k-mers."""
    k = len(wanted[0])
    hit = F.arrays_overlap("kmers", F.array(*map(F.lit, wanted)))
    return read_kmers(reads, k, pad).groupBy("conc").agg(F.sum(hit.cast("long")).alias("n_hit"), F.count("*").alias("n_reads"))


def pure_reads(reads: DataFrame, candidates: list[str], pad: bool = True) -> DataFrame:
    """(conc, kmer, n_reads): reads whose only candidate is the k-mer."""
    k = len(candidates[0])
    found = read_kmers(reads, k, pad, distinct=True).select("conc", F.array_intersect("kmers", F.array(*map(F.lit, candidates))).alias("own"))
    return found.where(F.size("own") == 1).groupBy("conc", F.col("own")[0].alias("kmer")).agg(F.count("*").alias("n_reads"))


def recall_by_rank(reads: DataFrame, ranking: list[str], pad: bool = True) -> DataFrame:
    """(conc, kmer, rank, n_reads): each read counts for the best-ranked k-mer that it holds; rank from 1."""
    k = len(ranking[0])
    order = F.array(*map(F.lit, ranking))
    best = F.array_min(F.filter(F.transform("kmers", lambda x: F.array_position(order, x)), lambda r: r > 0))
    return read_kmers(reads, k, pad, distinct=True).select("conc", best.alias("rank")).where("rank is not null").groupBy("conc", "rank").agg(F.count("*").alias("n_reads")).select("conc", F.element_at(order, F.col("rank").cast("int")).alias("kmer"), "rank", "n_reads")


def frequencies(counts: DataFrame, k: int, pseudo: float = 10.0) -> DataFrame:
    """(conc, kmer, f): pseudo-counted share of each k-mer of the full domain, 1 on average."""
    every = dense(counts, k).withColumn("n", F.col("n") + pseudo)
    return every.select("conc", "kmer", (F.col("n") / F.sum("n").over(Window.partitionBy("conc")) * 4**k).alias("f"))


def read_fractions(with_kmer: DataFrame, totals: DataFrame, k: int, pseudo: float = 10.0) -> DataFrame:
    """(conc, kmer, fraction) of reads that hold each k-mer of the full domain."""
    every = dense(with_kmer, k, "n_reads").join(F.broadcast(totals), "conc")
    return every.select("conc", "kmer", ((F.col("n_reads") + pseudo) / (F.col("reads") + pseudo)).alias("fraction"))


def totals(reads: DataFrame) -> DataFrame:
    return reads.groupBy("conc").agg(F.count("*").alias("reads"))


def position_profile(reads: DataFrame, k: int) -> DataFrame:
    """(conc, kmer, pos, n), without adapters."""
    return kmer_positions(reads, k).groupBy("conc", "kmer", "pos").agg(F.count("*").alias("n"))


def count_and_last(reads: DataFrame, kmer: str) -> DataFrame:
    """(conc, read_id, n, last_pos) of one k-mer in every read; last_pos is -1 where it is absent."""
    places = F.filter(F.transform(sq.kmers("seq", len(kmer)), lambda x, i: F.when(x == kmer, i).otherwise(-1)), lambda i: i >= 0)
    return reads.select("conc", "read_id", F.size(places).cast("long").alias("n"), F.coalesce(F.array_max(places), F.lit(-1)).cast("long").alias("last_pos"))


def _hits(reads: DataFrame, wanted: list[str], pad: bool = False) -> DataFrame:
    k = len(wanted[0])
    seq = sq.padded("seq", k) if pad else F.col("seq")
    rows = reads.select("conc", "read_id", seq.alias("seq")).where(F.col("seq").rlike("|".join(wanted)))
    own = F.transform(sq.kmers("seq", k), lambda x, i: F.when(x.isin(*wanted), F.struct(i.alias("pos"), x.alias("kmer"))))
    return rows.select("conc", "read_id", F.array_compact(own).alias("hits"))


def _pairs(hits: DataFrame, least: int) -> DataFrame:
    """(conc, kmer_a, kmer_b, dist) of ordered hits of a read at least `least` apart, made from each row alone."""
    first = hits.select("conc", "hits", F.posexplode("hits").alias("i", "a"))
    pairs = first.select("conc", "a", F.explode(F.slice("hits", F.col("i") + 2, F.greatest(F.size("hits") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return pairs.select("conc", F.col("a.kmer").alias("kmer_a"), F.col("b.kmer").alias("kmer_b"), (F.col("b.pos") - F.col("a.pos")).alias("dist")).where(F.col("dist") >= least)


def cooccurrence(reads: DataFrame, wanted: list[str]) -> DataFrame:
    """(conc, kmer_a, kmer_b, dist, n): b starts dist after a in the same read, overlaps included."""
    return _pairs(_hits(reads, wanted), 1).groupBy("conc", "kmer_a", "kmer_b", "dist").agg(F.count("*").alias("n"))


def joint_frequencies(reads: DataFrame, k: int, pseudo: float = 1.0) -> DataFrame:
    """(conc, dist, kmer_a, kmer_b, f): share of each pair of k-mers that do not overlap among those at its distance, adapters included; seen pairs only, the pseudo-count spread over all 16**k."""
    n = pair_counts(reads, k, k, least=k, seq=sq.padded("seq", k)).withColumnsRenamed({"kmer_1": "kmer_a", "kmer_2": "kmer_b", "rel": "dist"})
    whole = F.sum("n").over(Window.partitionBy("conc", "dist")) + pseudo * 16**k
    return n.select("conc", "dist", "kmer_a", "kmer_b", ((F.col("n") + pseudo) / whole).alias("f"))


def expected_cooccurrence(profile: DataFrame, totals_: DataFrame, wanted: list[str], length: int) -> DataFrame:
    """(conc, kmer_a, kmer_b, dist, expected): mean over positions m of f_a[m] * n_b[m + dist], 0 where the overlap disagrees."""
    k = len(wanted[0])
    width = length - k + 1
    own = profile.where(F.col("kmer").isin(*wanted))
    a = own.join(F.broadcast(totals_), "conc").select("conc", F.col("kmer").alias("kmer_a"), F.col("pos").alias("m"), "n", "reads")
    b = own.select("conc", F.col("kmer").alias("kmer_b"), F.col("pos").alias("at"), F.col("n").alias("n_b"))
    pairs = a.join(b, "conc").withColumn("dist", F.col("at") - F.col("m")).where("dist > 0")
    agrees = (F.col("dist") >= k) | (F.expr(f"substring(kmer_a, dist + 1, {k})") == F.expr(f"substring(kmer_b, 1, {k} - dist)"))
    return pairs.where(agrees).groupBy("conc", "kmer_a", "kmer_b", "dist").agg((F.sum(F.col("n") * F.col("n_b")) / F.first("reads") / (F.lit(width) - F.first("dist"))).alias("expected"))


def core_flank_profile(reads: DataFrame, k_core: int, k_flank: int, pseudo: float = 1.0) -> DataFrame:
    """(conc, core, flank, rel, n): flanking k-mers by position relative to each core k-mer, pseudo-count added to the seen."""
    return pair_counts(reads, k_core, k_flank).select("conc", F.col("kmer_1").alias("core"), F.col("kmer_2").alias("flank"), "rel", (F.col("n") + pseudo).alias("n"))


def flank_profile(reads: DataFrame, core: str, k_flank: int) -> DataFrame:
    """(conc, flank, rel, n): k-mers around every occurrence of the core, by relative position."""
    return pair_counts(reads, len(core), k_flank, core=core).select("conc", F.col("kmer_2").alias("flank"), "rel", "n")


def crosstalk(reads: DataFrame, k1: int, k2: int) -> DataFrame:
    """(conc, kmer_1, kmer_2, n): pairs of k-mers of two lengths that share a base of a read."""
    return pair_counts(reads, k1, k2, 1 - k2, k1 - 1).groupBy("conc", "kmer_1", "kmer_2").agg(F.sum("n").alias("n"))


def energy_histogram(reads: DataFrame, k: int, energy: str = "e", bins: int = 256, low: float = 0.0, high: float = 8.0) -> DataFrame:
    """(conc, kmer, bin, n): open energies of each k-mer in linear bins, ends clipped; bin from 0."""
    at = F.explode(F.arrays_zip(sq.kmers("seq", k).alias("kmer"), F.col(energy).alias("e")))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x.e") - low) / ((high - low) / bins)))).cast("int")
    return reads.select("conc", at.alias("x")).where("x.kmer is not null and x.e is not null").groupBy("conc", F.col("x.kmer").alias("kmer"), b.alias("bin")).agg(F.count("*").alias("n"))


def energy_profile(reads: DataFrame, kmer: str, energy: str = "e", reach: int = 10) -> DataFrame:
    """(conc, rel, n, mean_e): open energies around every occurrence of a k-mer."""
    places = F.filter(F.transform(sq.kmers("seq", len(kmer)), lambda x, i: F.when(x == kmer, i).otherwise(-1)), lambda i: i >= 0)
    rows = reads.select("conc", energy, F.explode(places).alias("at")).select("conc", "at", F.posexplode(energy).alias("pos", "e"))
    rows = rows.withColumn("rel", F.col("pos") - F.col("at")).where(F.abs("rel") <= reach)
    return rows.groupBy("conc", "rel").agg(F.count("*").alias("n"), F.avg("e").alias("mean_e"))


def aligned_profile(reads: DataFrame, kmer: str, energy: str = "e", up: int = 5, length: int = 12) -> DataFrame:
    """(conc, rel, n, mean_e) over the occurrences whose whole surroundings fit the row; rel from 0 is `up` before the hit."""
    places = F.filter(F.transform(sq.kmers("seq", len(kmer)), lambda x, i: F.when(x == kmer, i).otherwise(-1)), lambda i: (i >= up) & (i - up + length <= F.size(energy)))
    rows = reads.select("conc", energy, F.explode(places).alias("at")).select("conc", F.posexplode(F.slice(energy, F.col("at") - up + 1, F.lit(length))).alias("rel", "e"))
    return rows.groupBy("conc", "rel").agg(F.count("*").alias("n"), F.avg("e").alias("mean_e"))


def energies_of(reads: DataFrame, kmer: str, energy: str = "e") -> DataFrame:
    """(conc, read_id, pos, e) for every occurrence of a k-mer."""
    found = sq.bound(F.col(energy), lambda e: F.transform(sq.kmers("seq", len(kmer)), lambda x, i: F.struct(i.alias("pos"), F.get(e, i).alias("e"), (x == kmer).alias("hit"))))
    own = F.filter(found, lambda h: h["hit"] & h["e"].isNotNull())
    return reads.select("conc", "read_id", F.explode(own).alias("h")).select("conc", "read_id", "h.pos", "h.e")


def energies_of_best(reads: DataFrame, ranking: list[str], energy: str = "e") -> DataFrame:
    """(kmer, rank, conc, read_id, pos, e) for every occurrence of each of the k-mers, all of one length; rank from 1."""
    k = len(ranking[0])
    order = F.array(*map(F.lit, ranking))
    own = sq.bound(F.col(energy), lambda e: F.transform(sq.kmers("seq", k), lambda x, i: F.struct(x.alias("kmer"), F.array_position(order, x).alias("rank"), i.alias("pos"), F.get(e, i).alias("e"))))
    rows = reads.select("conc", "read_id", F.explode(F.filter(own, lambda h: (h["rank"] > 0) & h["e"].isNotNull())).alias("h"))
    return rows.select("h.kmer", F.col("h.rank").cast("int").alias("rank"), "conc", "read_id", "h.pos", "h.e")


def nucleotide_entropy_by_position(reads: DataFrame) -> DataFrame:
    """(conc, pos, entropy) in bits."""
    p = position_profile(reads, 1).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("conc", "pos")))
    return p.groupBy("conc", "pos").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))
