"""Reads as k-mers: domains and positions. Reads are rows (conc, read_id, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq


def kmer_domain(spark: SparkSession, k: int) -> DataFrame:
    """(kmer, kidx) for all 4**k k-mers."""
    return spark.range(4**k).select(sq.index_kmer("id", k).alias("kmer"), F.col("id").alias("kidx"))


def kmer_positions(reads: DataFrame, k: int, pad: bool = False, **adapters: str) -> DataFrame:
    """(conc, read_id, pos, kmer), pos from 0. With pad, also the k-mers that overlap the adapters."""
    seq = sq.padded("seq", k, **adapters) if pad else F.col("seq")
    return reads.select("conc", "read_id", F.posexplode(sq.kmers(seq, k)).alias("pos", "kmer"))


def read_kmers(reads: DataFrame, k: int, pad: bool = False, distinct: bool = False, **adapters: str) -> DataFrame:
    """(conc, read_id, kmers) with the k-mers of each read as an array."""
    seq = sq.padded("seq", k, **adapters) if pad else F.col("seq")
    found = sq.kmers(seq, k)
    return reads.select("conc", "read_id", (F.array_distinct(found) if distinct else found).alias("kmers"))


def dense(counts: DataFrame, k: int, value: str = "n") -> DataFrame:
    """(conc, kmer, value) over the full k-mer domain of every sample, 0 where unseen. 4**k and the samples are both small."""
    spark = counts.sparkSession
    samples = counts.select("conc").distinct()
    every = kmer_domain(spark, k).select("kmer").crossJoin(F.broadcast(samples))
    return every.join(counts.select("conc", "kmer", value), ["conc", "kmer"], "left").withColumn(value, F.coalesce(value, F.lit(0)))
