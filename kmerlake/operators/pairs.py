"""Pairs of k-mers of a read, counted in Arrow batches: a task returns a row for each pair it has seen, not one for each two places of a read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.windows import _CODE, by_length

#: Counts that a task holds for one sample, length and alphabet, beyond which pairs are sorted instead; and for all of them, beyond which they are given out.
DENSE, HELD = 1 << 22, 1 << 23


def letters(seqs: list[str]) -> tuple[np.ndarray, str]:
    """(places x sequences letter numbers of sequences of one length, the letters): ACGU, or those that occur if there are others."""
    whole, n = "".join(seqs), len(seqs[0])
    if whole.isascii():
        units = np.frombuffer(whole.encode(), np.uint8)
        codes = _CODE[units]
        if not (codes == 4).any():
            return np.ascontiguousarray(codes.reshape(-1, n).T, np.int64), "".join(sq.NUCLEOTIDES)
    units = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    own, codes = np.unique(units, return_inverse=True)
    return np.ascontiguousarray(codes.reshape(-1, n).T, np.int64), "".join(map(chr, own.tolist()))


def numbered(codes: np.ndarray, m: int, k: int) -> tuple[np.ndarray, int]:
    """(numbers of the k-mers at each place, bound of these): in base m, the number of letters, or by order among those that occur where that leaves 31 bits."""
    width = len(codes) - k + 1
    out, size = codes[:width], m
    for d in range(1, k):
        out, size = out * m + codes[d : d + width], size * m
        if size >= 1 << 31:
            own, out = np.unique(out, return_inverse=True)
            out, size = out.reshape(width, -1), len(own)
    return out, size


def _spelt(numbers: np.ndarray, seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers by order among those that occur, the k-mer of each)."""
    own, first, by_order = np.unique(numbers, return_index=True, return_inverse=True)
    place, read = np.divmod(first, numbers.shape[1])
    return by_order.reshape(numbers.shape), np.array([seqs[j][p : p + k] for p, j in zip(place.tolist(), read.tolist())], object)


def pair_counts(reads: DataFrame, k1: int, k2: int, least: int | None = None, most: int | None = None, seq: Column | None = None, core: str | None = None) -> DataFrame:
    """(conc, kmer_1, kmer_2, rel, n): pairs of a k1-mer and a k2-mer of the same read that starts rel after it, from least to most, all by default. With core only pairs of that k1-mer."""
    rows = reads.select("conc", (F.col("seq") if seq is None else seq).cast("string").alias("seq")).where("seq is not null")
    if core is not None:
        rows = rows.where(F.contains("seq", F.lit(core)))
    names = ["conc", "kmer_1", "kmer_2", "rel", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kind = None

        def out(conc, one, two, rel, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conc], kind).take(pa.array(np.zeros(len(n), np.int32))), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(rel.astype(np.int32)), pa.array(n.astype(np.int64))], names=names)

        def given() -> Iterator[pa.RecordBatch]:
            for (conc, _, alphabet, low), n in held.items():
                rel, one, two = np.nonzero(n)
                firsts, seconds = (np.array(["".join(x) for x in product(alphabet, repeat=k)], object) for k in (k1, k2))
                yield out(conc, np.full(len(one), core, object) if core is not None else firsts[one], seconds[two], rel + low, n[rel, one, two])
            held.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            coded = batch.column(0).dictionary_encode()
            concs = [*coded.dictionary.to_pylist(), None]
            which = coded.indices.fill_null(len(concs) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            seqs = batch.column(1).to_pylist()
            for at in by_length(seqs, which) if seqs else ():
                conc, own = concs[which[at[0]]], [seqs[i] for i in at]
                size = len(own[0])
                na, nb = size - k1 + 1, size - k2 + 1
                low = max(1 - na, least) if least is not None else 1 - na
                high = min(nb - 1, most) if most is not None else nb - 1
                if na < 1 or nb < 1 or high < low:
                    continue
                codes, alphabet = letters(own)
                (a, ma), (b, mb) = numbered(codes, len(alphabet), k1), numbered(codes, len(alphabet), k2)
                if core is not None:
                    ends = [(p, j) for j, s in enumerate(own) for p in range(na) if s.startswith(core, p)] if len(alphabet) ** k1 != ma else None
                    wanted = sum(alphabet.index(x) * len(alphabet) ** (k1 - 1 - i) for i, x in enumerate(core)) if set(core) <= set(alphabet) else -1
                    place, read = np.nonzero(a == wanted) if ends is None else np.array(ends, np.int64).reshape(-1, 2).T
                    if not len(place):
                        continue
                    a, ma = None, 1
                spread = (high - low + 1, ma, mb)
                sparse = len(alphabet) ** k2 != mb or (core is None and len(alphabet) ** k1 != ma) or spread[0] * ma * mb > DENSE
                if sparse:
                    b, seconds = _spelt(b, own, k2)
                    mb = len(seconds)
                    if core is None:
                        a, firsts = _spelt(a, own, k1)
                        ma = len(firsts)
                    else:
                        firsts = np.array([core], object)
                    for rel in range(low, high + 1):
                        if core is None:
                            i, j = max(0, -rel), min(na, nb - rel)
                            keys = a[i:j] * mb + b[i + rel : j + rel]
                        else:
                            fits = (place + rel >= 0) & (place + rel < nb)
                            keys = b[place[fits] + rel, read[fits]]
                        keys, n = np.unique(keys, return_counts=True)
                        if len(n):
                            yield out(conc, firsts[keys // mb], seconds[keys % mb], np.full(len(n), rel), n)
                    continue
                key = (conc, size, alphabet, low)
                if key not in held:
                    if sum(x.size for x in held.values()) + spread[0] * ma * mb > HELD:
                        yield from given()
                    held[key] = np.zeros(spread, np.int64)
                sums = held[key]
                if core is not None:
                    rel = np.arange(nb) - place[:, None]
                    keys = ((rel - low) * mb + b.T[read])[(rel >= low) & (rel <= high)]
                    sums += np.bincount(keys, minlength=sums.size).reshape(spread)
                    continue
                a = a * mb
                for rel in range(low, high + 1):
                    i, j = max(0, -rel), min(na, nb - rel)
                    sums[rel - low] += np.bincount((a[i:j] + b[i + rel : j + rel]).ravel(), minlength=ma * mb).reshape(ma, mb)
        yield from given()

    kinds = f"conc {reads.schema['conc'].dataType.simpleString()}, kmer_1 string, kmer_2 string, rel int, n long"
    return rows.mapInArrow(work, kinds).groupBy("conc", "kmer_1", "kmer_2", "rel").agg(F.sum("n").alias("n"))
