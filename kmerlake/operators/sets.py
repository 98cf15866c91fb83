"""Set operations on k-mer tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq


def excluded(kmers: DataFrame, banned: DataFrame, k_banned: int) -> DataFrame:
    """k-mers that hold none of the shorter banned ones; banned has a column `core`."""
    parts = kmers.select("kmer", F.explode(sq.kmers("kmer", k_banned)).alias("core"))
    bad = parts.join(banned.select("core"), "core", "left_semi").select("kmer").distinct()
    return kmers.join(bad, "kmer", "left_anti")


def containing(kmers: DataFrame, cores: DataFrame, k_core: int) -> DataFrame:
    """k-mers that hold any of the cores."""
    parts = kmers.select("kmer", F.explode(sq.kmers("kmer", k_core)).alias("core"))
    return kmers.join(parts.join(cores.select("core"), "core", "left_semi").select("kmer").distinct(), "kmer", "left_semi")


def neighbourhood(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, variant): each k-mer with itself and its single substitutions."""
    return kmers.select("kmer", F.explode(sq.hull("kmer", k)).alias("variant"))


def extensions(kmers: DataFrame) -> DataFrame:
    """(kmer, side, extended)."""
    left = kmers.select("kmer", F.lit("left").alias("side"), F.explode(sq.expanded("kmer", True)).alias("extended"))
    return left.unionByName(kmers.select("kmer", F.lit("right").alias("side"), F.explode(sq.expanded("kmer", False)).alias("extended")))


def shifted_neighbours(kmers: DataFrame, k: int, most: int = 1, factor: float = 1.0) -> DataFrame:
    """(kmer, shift, neighbour, weight): k-mers that overlap it after a shift of up to `most` bases, weighed (k - 2x) / k * factor."""
    out = None
    for x in range(1, most + 1):
        ends = F.array(*[F.lit("".join(p)) for p in product(sq.NUCLEOTIDES, repeat=x)])
        e = kmers.select("kmer", F.explode(ends).alias("e"))
        weight = F.lit((k - 2 * x) / k * factor)
        for shift, made in ((-x, F.concat("e", F.expr(f"left(kmer, {k - x})"))), (x, F.concat(F.expr(f"substring(kmer, {x + 1}, {k - x})"), "e"))):
            part = e.select("kmer", F.lit(shift).alias("shift"), made.alias("neighbour"), weight.alias("weight"))
            out = part if out is None else out.unionByName(part)
    return out
