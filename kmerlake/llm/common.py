"""Helpers shared by the text operators: shared-folder checkpoints, vectorised word hashing, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time; bounds the scratch arrays for one very long text.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a session without executors of its own (tests) may leave it unset and gets a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kmerlake-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


#: Tables of ids are broadcast up to this many bytes, else joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def sized(table: DataFrame, row_bytes: int) -> DataFrame:
    """The table, marked for a broadcast if its counted rows take no more than BROADCAST_BYTES."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... that clash with no column an operator adds, and the new name of each old one, upper or lower case."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return inner, {k: new for old, new in zip(docs.columns, inner.columns) for k in (old, old.lower(), old.upper())}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def uniform(*cols) -> "F.Column":
    """A reproducible uniform in (0, 1) from the columns' hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (public-domain constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(PIECE + 1, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def byte_class(chars: str) -> np.ndarray:
    """Boolean table of byte values that belong to words. 'space': all but ASCII white space; 'alnum': letters, digits and all bytes above ASCII."""
    table = np.zeros(256, bool)
    if chars == "space":
        table[:] = True
        table[[0x20, 9, 10, 11, 12, 13]] = False
    else:
        table[128:] = True
        for lo, hi in ((48, 57), (65, 90), (97, 122)):
            table[lo : hi + 1] = True
    return table


SPACE, ALNUM = byte_class("space"), byte_class("alnum")


def hashed_words(raw: bytes, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end) of each maximal run of word bytes. Long texts are hashed a piece at a time."""
    a = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([False], table[a], [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    up, down = _powers()
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        base = start[k]
        stop = max(k + 1, int(np.searchsorted(end, base + PIECE, "right")))
        piece = a[base : end[stop - 1]]
        if len(piece) > PIECE:  # one word longer than a piece
            value = 0
            for at in range(0, len(piece), PIECE):
                part = piece[at : at + PIECE].astype(np.uint64)
                value = (value * 31 + int((part * up[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
            out[k] = value
        else:
            prefix = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=prefix[1:])
            s, e = start[k:stop] - base, end[k:stop] - base
            out[k:stop] = (prefix[e] - prefix[s]) * down[s]
        k = stop
    return mix64(out), start, end


def hashed_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of n consecutive words; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(_BASE) + words[i : len(words) - n + 1 + i])
    return out


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, one at a time: one text in Python's memory beside its Arrow batch."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in cols)


def emit(schema: pa.Schema, found: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded size."""
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
