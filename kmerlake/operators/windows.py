"""Reads of an Arrow batch as arrays of letter numbers, and the weights of their windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kmerlake.functions import sequence as sq
from kmerlake.operators.motifs import Motif

_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 85]] = range(4)
#: Reads worked on together, fewer where they are longer than 64 letters; bounds the sums held.
BLOCK = 2048


def encode(seqs: list[str], flank: int) -> np.ndarray:
    """Letter numbers of sequences of one length, adapters' ends before and behind; 4 for a letter other than ACGU."""
    n = len(seqs[0])
    own = _CODE[np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8).reshape(-1, n)] if n else np.empty((len(seqs), 0), np.uint8)
    left = _CODE[np.frombuffer(sq.ADAPTER_5[len(sq.ADAPTER_5) - flank :].encode() if flank else b"", np.uint8)]
    right = _CODE[np.frombuffer(sq.ADAPTER_3[:flank].encode(), np.uint8)]
    return np.hstack([np.broadcast_to(left, (len(seqs), len(left))), own, np.broadcast_to(right, (len(seqs), len(right)))])


def products(codes: np.ndarray, motif: Motif) -> np.ndarray:
    """(reads, windows) products of a motif's cells; a letter other than ACGU counts 0."""
    n = max(0, codes.shape[1] - motif.width + 1)
    table = np.hstack([motif.matrix, np.zeros((motif.width, 1))])
    out = np.ones((len(codes), n))
    for d in range(motif.width):
        out *= table[d][codes[:, d : d + n]]
    return out


def by_length(seqs: list[str], *sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of sequences of one length, and alike in sizes too, BLOCK at a time at most."""
    keys = np.stack([np.array([len(s) for s in seqs], np.int64), *sizes])
    order = np.lexsort(keys[::-1])
    cuts = np.flatnonzero((keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)) + 1
    for at in np.split(order, cuts):
        step = min(BLOCK, max(1, BLOCK * 64 // max(1, len(seqs[at[0]]))))
        for k in range(0, len(at), step):
            yield at[k : k + step]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, sizes) of a list column of numbers; null elements are NaN, null lists have size 0."""
    values = column.values.to_numpy(zero_copy_only=False).astype(float)
    ends = column.offsets.to_numpy()
    return values, ends[:-1].astype(np.int64), np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0).astype(np.int64)
