"""Column expressions on sequences over ACGU."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUCLEOTIDES = ("A", "C", "G", "U")

# Default adapters that flank a read, and the complement of each nucleotide code.
ADAPTER_5 = "GGGAGUUCUACAGUCCGACGAUC"
ADAPTER_3 = "UGGAAUUCUCGGGUGUCAAGG"
CODES = "ACGUTNRYSWKMBDHV"
COMPLEMENTS = "UGCAANYRSWMKVHDB"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalised(seq: str | Column) -> Column:
    """Upper case, T as U."""
    return F.translate(F.upper(col(seq)), "T", "U")


def is_canonical(seq: str | Column) -> Column:
    """Whether every letter is one of ACGU, T and lower case included; empty sequences are not."""
    return col(seq).rlike("^[ACGUTacgut]+$")


def right(seq: Column, n: int) -> Column:
    return F.substring(seq, -n, n) if n > 0 else F.lit("")


def padded(seq: str | Column, k: int, adapter_5: str = ADAPTER_5, adapter_3: str = ADAPTER_3) -> Column:
    """The sequence with as much of its adapters as a k-mer that overlaps it can reach."""
    return F.concat(F.lit(adapter_5[len(adapter_5) - (k - 1) :] if k > 1 else ""), col(seq), F.lit(adapter_3[: k - 1]))


def kmers(seq: str | Column, k: int) -> Column:
    """Array of the k-mers of a sequence in order; empty if it is shorter. One pass over the sequence, which is evaluated once.

    Letters are taken as single UTF-16 units, as those of sequences are.
    """
    return F.regexp_extract_all(col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def valid_kmers(seq: str | Column, k: int) -> Column:
    """The k-mers over ACGU of any text in order: windows with another letter are left out."""
    return F.regexp_extract_all(normalised(seq), F.lit(f"(?=([ACGU]{{{k}}}))"), F.lit(1))


def bound(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmer_index(kmer: str | Column) -> Column:
    """Number of a k-mer in alphabetical order, k up to 31."""
    return F.conv(F.translate(col(kmer), "ACGU", "0123"), 4, 10).cast("long")


def index_kmer(index: str | Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(col(index).cast("string"), 10, 4), k, "0"), "0123", "ACGU")


def complement(seq: str | Column) -> Column:
    return F.translate(F.upper(col(seq)), CODES, COMPLEMENTS)


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(complement(seq))


def count_of(seq: str | Column, letter: str) -> Column:
    s = col(seq)
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def gc_content(seq: str | Column) -> Column:
    return (count_of(seq, "G") + count_of(seq, "C")) / F.length(col(seq))


def nucleotide_entropy(seq: str | Column) -> Column:
    """Bits of the nucleotide composition."""
    total = F.lit(0.0)
    for nt in NUCLEOTIDES:
        p = count_of(seq, nt) / F.length(col(seq))
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def hull(kmer: str | Column, k: int) -> Column:
    """The k-mer and its single substitutions (1 + 3k), distinct."""
    s = col(kmer)
    variants = [F.overlay(s, F.lit(nt), F.lit(p + 1)) for p in range(k) for nt in NUCLEOTIDES]
    return F.array_distinct(F.array(s, *variants))


def expanded(kmer: str | Column, left: bool = True) -> Column:
    """The k-mer extended by each nucleotide on one side."""
    s = col(kmer)
    return F.array(*[F.concat(F.lit(nt), s) if left else F.concat(s, F.lit(nt)) for nt in NUCLEOTIDES])


def significant(value: str | Column, error: str | Column) -> Column:
    """Value rounded to the first significant digit of its error, as text."""
    digits = F.greatest(F.lit(0), -F.floor(F.log10(col(error)))).cast("int")
    power = F.pow(F.lit(10.0), digits)
    return F.when(col(error) > 0, F.round(col(value) * power) / power).otherwise(col(value))


def stars(p: str | Column) -> Column:
    c = col(p)
    return F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*").otherwise("n.s.")


def concentration_label(conc: str | Column) -> Column:
    """A concentration in nM with a fitting unit."""
    c = col(conc)
    return F.when(c < 1, F.concat(F.round(c * 1000, 1).cast("string"), F.lit(" pM"))).when(c < 1000, F.concat(F.round(c, 1).cast("string"), F.lit(" nM"))).otherwise(F.concat(F.round(c / 1000, 1).cast("string"), F.lit(" uM")))
