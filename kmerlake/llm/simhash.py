"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked within a Hamming radius by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import cut, documents, emit, plain_names, rows, sized
from kmerlake.llm.components import connected_components

RADIUS = 3
#: Rows of one bucket that are compared in one block; larger buckets are split into pairs of tiles.
TILE = 1024
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words. ASCII letters are lower-cased, ASCII white space separates words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    last = max(1, n - shingle + 1)
    norm = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin, stop = starts[:last].tolist(), ends[min(shingle, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        h = np.array([digest(norm[s:e], seed) for s, e in zip(begin[at : at + (1 << 16)], stop[at : at + (1 << 16)])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint's bits as a long. Null texts count as empty. The carried columns of docs, all long, follow."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *carried)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(schema, ((i, _signed(text_fingerprint(t)), *rest) for i, t, *rest in rows(batches, "doc_id", "text", *carried)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried).mapInArrow(work, ", ".join(f"{c} long" for c in schema.names))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: bit i of word w of plane b is bit b of fingerprint 64*w + i."""
    n = len(fps)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(planes: np.ndarray, queries: np.ndarray, skip: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(queries with a hit, their packed hits). skip: packed positions not to compare.

    Distances of a whole block are held in bitwise counters: each plane's differences are added with carry-save
    steps, and a position that passes the radius stays marked. Every 8 planes, queries whose block is all past it are abandoned.
    """
    levels = radius.bit_length()
    live = np.arange(len(queries))
    over = skip.copy()
    count = [np.zeros_like(over) for _ in range(levels)]
    for b in range(64):
        carry = planes[b][None, :] ^ np.where((queries[live] >> np.uint64(b)) & np.uint64(1), _FULL, np.uint64(0))[:, None]
        for c in count:
            c_new = c ^ carry
            carry &= c
            c[...] = c_new
        over |= carry
        if b % 8 == 7:
            keep = (over != _FULL).any(axis=1)
            if not keep.all():
                live, over, count = live[keep], over[keep], [c[keep] for c in count]
                if not len(live):
                    break
    if radius != (1 << levels) - 1 and len(live):
        # counters hold the exact distance where it did not overflow
        far = np.zeros_like(over)
        for value in range(radius + 1, 1 << levels):
            same = np.full_like(over, _FULL)
            for i, c in enumerate(count):
                same &= c if value >> i & 1 else ~c
            far |= same
        over = over | far
    return live, ~over


def block_links(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Index of the smallest member of each fingerprint's component within the block."""
    n = len(fps)
    label = np.arange(n)
    planes = bit_planes(fps)
    width = planes.shape[1]
    pad = np.zeros(width * 64, np.uint8)
    pad[n:] = 1
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, n, 256):
        q = np.arange(at, min(n, at + 256))
        skip = np.repeat(np.packbits(pad, bitorder="little").view(np.uint64)[None, :], len(q), axis=0)
        skip[np.arange(len(q)), q // 64] |= np.uint64(1) << (q % 64).astype(np.uint64)
        live, hit = near(planes, fps[q], skip, radius)
        if len(live):
            hits.append((q[live], hit))
    changed = bool(hits)
    while changed:
        changed = False
        for q, hit in hits:
            bits = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
            new = np.minimum(np.where(bits, label[None, :], n).min(axis=1), label[q])
            if (new < label[q]).any():
                np.minimum.at(label, label[q], new)
                label[q] = new
                changed = True
        label = label[label]
    return label


def table_masks(n_distinct: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that must agree, one for each table. Any two fingerprints within the radius agree on one mask at least.

    64 bits are cut into k blocks and k - radius of them kept; k grows with the number of fingerprints so that a
    bucket holds a few of them.
    """
    k = next((k for k in range(radius + 1, radius + 6) if 2 ** (64 * (k - radius) // k) * 16 >= n_distinct), radius + 5)
    edges = [round(64 * i / k) for i in range(k + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(k)]
    return [_signed(sum(c)) for c in combinations(blocks, k - radius)]


def near_edges(distinct: DataFrame, masks: list[int], radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct(fp) -> (a, b): links within the radius, as spanning stars of each compared block, never all its pairs.

    Buckets above `tile` rows are split into tiles, and each pair of tiles is a group of its own, so no task
    gathers a whole hot bucket.
    """
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > tile).select("t", "key", F.ceil(F.col("count") * 2 / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = (
        keyed.join(hot, ["t", "key"], "left")
        .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))))
        .select("t", "key", F.when(F.col("other") < 0, 0).otherwise(F.least(own, "other")).alias("i"), F.when(F.col("other") < 0, 0).otherwise(F.greatest(own, "other")).alias("j"), "fp")
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiled.repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(blocks).view(np.uint64) if blocks else np.empty(0, np.uint64)
            if len(fps) > 1:
                root = block_links(fps, radius)
                at = np.flatnonzero(root != np.arange(len(fps)))
                if len(at):
                    yield pa.record_batch([pa.array(fps[at].view(np.int64)), pa.array(fps[root[at]].view(np.int64))], schema=schema)

        held: list[np.ndarray] = []
        size, last = 0, None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            ids = np.stack([c.astype(np.int64) for c in cols[:4]])
            if not ids.shape[1]:
                continue
            new = np.concatenate(([last is None or (ids[:, 0] != last).any()], (ids[:, 1:] != ids[:, :-1]).any(axis=0)))
            cuts = np.flatnonzero(new).tolist()
            for s, e in zip([0, *[c for c in cuts if c]], [*[c for c in cuts if c], ids.shape[1]]):
                if new[s] and size + (e - s) > tile:
                    yield from flush(held)
                    held, size = [], 0
                held.append(cols[4][s:e].astype(np.int64))
                size += e - s
            last = ids[:, -1]
        yield from flush(held)

    return dealt.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id: the smallest id reachable over links of at most `radius` differing bits. Equal fingerprints are
    one node. Null or empty texts have fingerprint zero and are linked like any other; repeated rows are repeated in
    the result; a null id keeps its row and never becomes a component id unless no other id is reachable. Other columns of docs are not read.
    """
    found = cut(fingerprints(docs, id_col, text_col))
    return found.join(_classes(found, radius).drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(found: DataFrame, radius: int) -> DataFrame:
    """found(doc_id, fp) -> (root, fp, component_id) of each distinct fp; root names a component that has no id too."""
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    masks = table_masks(distinct.count(), radius)
    roots = connected_components(near_edges(distinct.select("fp"), masks, radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("root", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs, all columns, with one document of each component: that of the smallest id.

    Rows that share an id are one document, kept once (the row of the least text hash) if any of them has the
    smallest id of its component. Rows with a null id go where their component has a document with an
    id; of a component without ids the row of the least text hash is kept. Any other columns may have any names and types; an empty table
    gives an empty table.
    """
    inner, name = plain_names(docs)
    return _one_of_each(inner, name[id_col], name[text_col], radius).toDF(*docs.columns)


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    key, text_hash = F.col(id_col).cast("long"), F.xxhash64(text_col)

    def single(repeated: DataFrame, by: "F.Column") -> DataFrame:
        row = F.struct(*docs.columns)
        return repeated.groupBy(by.alias("_by")).agg(F.min_by(row, F.struct(text_hash, F.xxhash64(F.to_json(row)))).alias("_row")).select("_row.*")

    found = cut(fingerprints(docs.withColumn("_hash", F.when(key.isNull(), text_hash)), id_col, text_col, "_hash"))
    linked = cut(found.join(_classes(found, radius), "fp").select("doc_id", "component_id", "root", "_hash"))
    ids = cut(linked.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n")))
    gone = ids.where("not first").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(sized(gone, 32), key == F.col("_gone"), "left_anti")
    again = ids.where("first and n > 1").select(F.col("doc_id").alias("_again"))
    if again.limit(1).count():
        repeated = kept.join(again, key == F.col("_again"), "left_semi")
        kept = kept.join(again, key == F.col("_again"), "left_anti").unionByName(single(repeated, F.col(id_col)))
    beside = cut(linked.where("doc_id is null and component_id is not null").select(F.col("_hash").alias("_beside")).distinct())
    if beside.limit(1).count():
        kept = kept.join(sized(beside, 32), key.isNull() & (text_hash == F.col("_beside")), "left_anti")
    alone = cut(linked.where("doc_id is null and component_id is null").select("root", F.col("_hash").alias("_alone")).distinct())
    if alone.limit(1).count():
        least = alone.groupBy("root").agg(F.min("_alone").alias("_least"))
        first = single(docs.where(key.isNull()).join(sized(least, 32), text_hash == F.col("_least"), "left_semi"), text_hash)
        kept = kept.join(sized(alone, 32), key.isNull() & (text_hash == F.col("_alone")), "left_anti").unionByName(first)
    return kept


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
