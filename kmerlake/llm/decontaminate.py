"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import ALNUM, documents, emit, hashed_shingles, hashed_words, mix64, rows

SHINGLE = 5
CONTAINMENT = 0.8
#: Hash functions. A window holds at most 4 times an item's shingles, so a match has a Jaccard index of 0.19 at
#: least and is missed by all functions with probability 0.81 ** 64 = 1.4e-6.
HASHES = 64
#: Items held by a task at once; more are searched in blocks, each over all documents.
ITEM_BLOCK = 20_000
_SLOTS = 1 << 16
#: Shingles hashed at a time by all functions, a multiple of every window step up to it.
_CHUNK = 1 << 13
_ROW = (np.arange(HASHES, dtype=np.uint32) * np.uint32(_SLOTS))[:, None]
_XOR = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MUL = (mix64(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def word_list(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word hashes, starts, ends); a word is a run of letters and digits."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return raw, *hashed_words(raw, ALNUM)


def shingle_texts(raw: bytes, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [b" ".join(raw[s:e] for s, e in zip(start[i : i + SHINGLE].tolist(), end[i : i + SHINGLE].tolist())) for i in at.tolist()]


@dataclass
class SizeClass:
    """Items of 2**(level-1) < n <= 2**level shingles, for windows of 2**(level+1) shingles that start every 2**level."""

    level: int
    slots: np.ndarray  # (HASHES, 65536) bool: low bits of any item's minimum
    keys: list[dict[int, list[int]]]  # by hash function, minimum -> items


class ItemIndex:
    def __init__(self, items: list[tuple[int | str, str | None]]):
        """Items shorter than five words have no shingle, cannot be judged and match nothing. A null id is kept as null."""
        self.ids, self.shingles, self.hashes = [], [], []
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            raw, words, start, end = word_list(text)
            s = hashed_shingles(words, SHINGLE)
            if not len(s):
                continue
            texts = set(shingle_texts(raw, start, end, np.arange(len(s))))
            s = np.unique(s)
            self.ids.append(item_id)
            self.shingles.append(texts)
            self.hashes.append(s)
            classes.setdefault(int(np.ceil(np.log2(len(s)))), []).append((len(self.ids) - 1, s))
        self.classes = []
        for level, members in sorted(classes.items()):
            slots = np.zeros((HASHES, _SLOTS), bool)
            keys: list[dict[int, list[int]]] = [{} for _ in range(HASHES)]
            for item, s in members:
                low = (s >> np.uint64(32)).astype(np.uint32)
                for i in range(HASHES):
                    least = int(((low ^ _XOR[i]) * _MUL[i]).min())
                    slots[i, least & (_SLOTS - 1)] = True
                    keys[i].setdefault(least, []).append(item)
            self.classes.append(SizeClass(level, slots, keys))

    def candidates(self, s: np.ndarray) -> set[int]:
        """Items whose minimum agrees with that of a window under any hash function."""
        found: set[int] = set()
        if not len(s) or not self.classes:
            return found
        low = (s >> np.uint64(32)).astype(np.uint32)
        overlap = 1 << self.classes[-1].level
        step = max(_CHUNK, overlap)
        for at in range(0, len(low), step):
            block, level = (low[None, at : at + step + overlap] ^ _XOR[:, None]) * _MUL[:, None], 0
            for c in self.classes:
                while level < c.level:
                    n = block.shape[1]
                    half = np.minimum(block[:, 0 : n - 1 : 2], block[:, 1::2])
                    block = np.concatenate((half, block[:, -1:]), axis=1) if n % 2 else half
                    level += 1
                window = np.minimum(block[:, :-1], block[:, 1:]) if block.shape[1] > 1 else block
                row, place = np.nonzero(c.slots.ravel()[(window & np.uint32(_SLOTS - 1)) + _ROW])
                for i, v in set(zip(row.tolist(), window[row, place].tolist())):
                    found.update(c.keys[i].get(v, ()))
        return found

    def matches(self, text: str | None, least: float = CONTAINMENT) -> list[tuple[int | str, int, int, float]]:
        """(item id, shared shingles, item's shingles, containment) for each item that the whole text holds."""
        raw, words, start, end = word_list(text)
        s = hashed_shingles(words, SHINGLE)
        found = self.candidates(s)
        if not found:
            return []
        wanted = np.unique(np.concatenate([self.hashes[i] for i in found]))
        spot = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
        _, at = np.unique(np.where(wanted[spot] == s, s, 0), return_index=True)
        have = set(shingle_texts(raw, start, end, at))
        out = []
        for i in sorted(found):
            n, shared = len(self.shingles[i]), len(self.shingles[i] & have)
            if shared >= least * n:
                out.append((self.ids[i], shared, n, shared / n))
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = ITEM_BLOCK) -> Iterator[ItemIndex]:
    """Indexes of at most about `block` items each, gathered one at a time."""
    base = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    n = max(1, -(-base.count() // block))
    for i in range(n):
        part = base if n == 1 else base.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield ItemIndex([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment): each document and item of which the document holds at least `least` of the distinct 5-word shingles.

    Words are lower-cased runs of letters and digits. Documents are cut into windows by the item's size class, so a
    short item is found in a document of any length. Null, empty and short texts match nothing; rows repeated in
    either table repeat their matches; empty tables give an empty result. No shuffle: items come in blocks of bounded size.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int32()), ("n_shingles", pa.int32()), ("containment", pa.float64())])
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in item_blocks(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            x = held.value
            yield from emit(schema, ((i, *m) for i, t in rows(batches, "doc_id", "text") for m in x.matches(t, least)))

        found = base.mapInArrow(work, "doc_id long, item_id long, shared int, n_shingles int, containment double")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no item; decided by contaminated()'s rule."""
    place = docs.columns.index(text_col)
    for index in item_blocks(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            x = held.value
            for b in batches:
                yield b.filter(pa.array([not x.matches(t.as_py(), least) for t in b.column(place)], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
g AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
n AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::INTEGER AS shared, any_value(n.n)::INTEGER AS n_shingles, count(*)::DOUBLE / any_value(n.n) AS containment
FROM g d JOIN g i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n)
"""
