"""Repeated substrings by sparse suffix sorting: suffixes at content-chosen anchors, sorted deep-shallow in both directions.

A window is `LENGTH` bytes. Its anchor is the start of its `GRAM`-byte sequence of least hash, so equal windows have
their anchor at the same place, and a repeat needs suffixes from two anchors with the same sequence only:

1. anchors whose sequence occurs once are dropped;
2. an anchor whose whole span (all windows it anchors) occurs again, by a 128-bit hash, is settled: all its windows repeat;
3. the rest, with one copy of each settled span beside them, are grouped by their sequence. Within a group the right
   suffixes and the reversed left ones are sorted: multikey quicksort to a shallow depth, blind tries beyond. The longest
   common prefixes of neighbours in the two orders tell which windows are equal.

Groups of more than `GROUP` members are not gathered: their windows' 128-bit hashes are counted instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import _powers, cut, documents, emit, mix64, rows

LENGTH = 400
GRAM = 128
#: Bytes of a passage, about 40 words, that `n_shared` never misses where it starts elsewhere too.
PASSAGE = 256
#: Depth in bytes at which multikey quicksort hands over to blind tries, and the bytes it compares at a step.
SHALLOW, STEP = 32, 8
GROUP = 1000
#: Window starts handled at a time.
PIECE = 1 << 19
_FIRST_ID = -(1 << 63)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    up, down = _powers()
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix64((prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` neighbouring hashes, the first of equal ones."""
    n = len(h)
    low = np.uint64((1 << 20) - 1)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - width + 1)
    return (np.minimum(behind[start], ahead[start + width - 1]) & low).astype(np.int64)


def anchors(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hashes, chosen places, anchors, first and last window start), a piece of the text at a time, places counted from the piece's start but for the window starts.

    Anchors are the places of the least sequence of some window of `LENGTH` bytes; chosen places those of the least
    of some string of `PASSAGE` bytes, among them all anchors. Both depend on the string's bytes alone.
    """
    data = np.frombuffer(raw, np.uint8)
    for base in range(0, max(0, len(data) - PASSAGE + 1), PIECE):
        h = _gram_hashes(data[base : base + PIECE + LENGTH - 1], GRAM)
        chosen = np.unique(_least(h, PASSAGE - GRAM + 1))
        width = LENGTH - GRAM + 1
        if len(h) < width:
            none = np.empty(0, np.int64)
            yield h, chosen, none, none, none
            continue
        least = _least(h, width)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        yield h, chosen, least[first], base + first, base + np.append(first[1:] - 1, len(least) - 1)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to agree."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Patricia trie over strings with a common prefix: inner nodes hold a depth and branch on its byte (-1: the string's end).

    Insertion follows branch bytes blindly to any leaf, compares once with that leaf, and hangs the string where they part.
    """

    def __init__(self, strings: list[bytes], known: int):
        self.strings, self.known, self.root = strings, known, None

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        depth = common(self.strings[node[0]], self.strings[i], self.known)
        if depth == len(self.strings[i]) == len(self.strings[node[0]]):
            node.append(i)
            return
        new, parent, branch = self._byte(i, depth), None, 0
        at = self.root
        while isinstance(at, tuple) and at[0] < depth:
            parent, branch = at, self._byte(i, at[0])
            at = at[1][branch]
        if isinstance(at, tuple) and at[0] == depth:
            at[1][new] = [i]
            return
        old = at
        while isinstance(old, tuple):
            old = next(iter(old[1].values()))
        inner = (depth, {self._byte(old[0], depth): at, new: [i]})
        if parent is None:
            self.root = inner
        else:
            parent[1][branch] = inner

    def order(self) -> Iterator[int]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            elif node is not None:
                yield from node


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW, step: int = STEP) -> tuple[list[int], list[int]]:
    """(order, lcp): indexes in lexicographic order, and each one's common prefix length with the one before it (0 for the first)."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) < 2:
            order.extend(part)
        elif depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in part:
                trie.insert(i)
            order.extend(trie.order())
        else:
            key = [strings[i][depth : depth + step] for i in part]
            pivot = key[len(part) // 2]
            less = [i for i, k in zip(part, key) if k < pivot]
            same = [i for i, k in zip(part, key) if k == pivot]
            more = [i for i, k in zip(part, key) if k > pivot]
            stack += [(more, depth), (same, depth + step if len(pivot) == step else max(shallow, depth)), (less, depth)]
    return order, [0, *(common(strings[i], strings[j]) for i, j in zip(order, order[1:]))][: len(order)]


def repeated_windows(left: list[bytes], right: list[bytes], most: np.ndarray, least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(depths, members) bool: whether the member's window that starts d bytes before its anchor occurs at another member too.

    left: reversed bytes before the anchor; right: bytes from it on; most and least: range of d that the member anchors.
    """
    m, top = len(left), int(most.max()) + 1
    d = np.arange(top)[:, None]
    classes = []
    for strings, need in ((right, length - d), (left, d)):
        order, lcp = deep_shallow(strings)
        new = np.cumsum(np.asarray(lcp)[None, :] < need, axis=1)
        own = np.empty((top, m), np.int64)
        own[:, order] = new
        classes.append(own)
    key = classes[0] * (m + 1) + classes[1]
    valid = (d >= least[None, :]) & (d <= most[None, :])
    key = np.where(valid, key, -1 - np.arange(m)[None, :])
    by = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, by, axis=1)
    same = ranked[:, 1:] == ranked[:, :-1]
    hit = np.zeros((top, m), bool)
    hit[:, 1:] |= same
    hit[:, :-1] |= same
    out = np.zeros((top, m), bool)
    np.put_along_axis(out, by, hit, axis=1)
    return out & valid


_CHOSEN = "gram long, s1 long, s2 long, doc long, h long, at int, lo int, hi int"


def _repeated_grams(docs: DataFrame) -> DataFrame:
    """(gram, other) of the sequences chosen at more than one place; other: in more than one row. Pre-aggregated within each row."""
    schema = pa.schema([("gram", pa.int64()), ("own", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in rows(batches, "text"):
            grams = [h[chosen] for h, chosen, *_ in anchors(text.encode("utf-8", "surrogatepass"))]
            if grams:
                found, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n > 1)], schema=schema)

    found = docs.select("text").mapInArrow(work, "gram long, own boolean").groupBy("gram").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    return found.where("n > 1 or own").select("gram", (F.col("n") > 1).alias("other"))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(gram, s1, s2, doc, h, at, lo, hi) of every anchor, s1 and s2 hashing its span; only gram, doc and h of the other chosen places."""
    schema = pa.schema([("gram", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for doc, h, text in rows(batches, "doc", "h", "text"):
            raw, base = text.encode("utf-8", "surrogatepass"), 0
            for grams, chosen, at, lo, hi in anchors(raw):
                span = np.frombuffer(b"".join(digest(raw[s : e + LENGTH]) for s, e in zip(lo.tolist(), hi.tolist())), np.int64).reshape(-1, 2)
                rest = np.setdiff1d(chosen, at)
                n = len(at) + len(rest)
                gram = np.concatenate((grams[at], grams[rest])).view(np.int64)
                parts = ((span[:, 0], pa.int64()), (span[:, 1], pa.int64()), (base + at, pa.int32()), (lo, pa.int32()), (hi, pa.int32()))
                whole = [pa.concat_arrays([pa.array(np.ascontiguousarray(x)).cast(t), pa.nulls(len(rest), t)]) for x, t in parts]
                yield pa.record_batch([pa.array(gram), *whole[:2], pa.array(np.full(n, doc)), pa.array(np.full(n, h)), *whole[2:]], schema=schema)
                base += PIECE

    return docs.mapInArrow(work, _CHOSEN)


def _contexts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members(gram, doc, h, at, lo, hi, open) with the bytes before (reversed) and from the anchor on."""
    lists = members.groupBy("doc", "h").agg(F.collect_list(F.struct("gram", "at", "lo", "hi", "open")).alias("own"))
    again = Window.partitionBy("doc", "h").orderBy("h")
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("open", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc, h, text, own in rows(batches, "doc", "h", "text", "own"):
                raw = text.encode("utf-8", "surrogatepass")
                for o in own:
                    at, lo, hi = o["at"], o["lo"], o["hi"]
                    yield o["gram"], doc, h, at, lo, hi, o["open"], raw[lo:at][::-1], raw[at : hi + LENGTH]

        yield from emit(schema, found(), 5000)

    once = docs.withColumn("before", F.lag("h").over(again)).where("before is null").drop("before")  # a row repeated in full gives its contexts once
    return once.join(lists, ["doc", "h"]).mapInArrow(work, "gram long, doc long, h long, at int, lo int, hi int, open boolean, left binary, right binary")


def _sorted_groups(members: DataFrame) -> DataFrame:
    """(doc, h, start, end) of the bytes of open members that a repeated window covers; groups are sorted whole, so they are bounded."""
    schema = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(group: list[tuple]) -> Iterator[tuple]:
        if len(group) < 2:
            return
        at = np.array([g[3] for g in group])
        hit = repeated_windows([g[7] for g in group], [g[8] for g in group], at - np.array([g[4] for g in group]), at - np.array([g[5] for g in group]))
        for k, g in enumerate(group):
            if g[6] and hit[:, k].any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[:, k].astype(np.int8), [0]))))
                for first, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    yield g[1], g[2], int(at[k]) - (stop - 1), int(at[k]) - first + LENGTH

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            group: list[tuple] = []
            for r in rows(batches, "gram", "doc", "h", "at", "lo", "hi", "open", "left", "right"):
                if group and group[0][0] != r[0]:
                    yield from runs(group)
                    group = []
                group.append(r)
            yield from runs(group)

        yield from emit(schema, found())

    return members.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(work, "doc long, h long, start int, end int")


def _counted_groups(members: DataFrame) -> DataFrame:
    """The same as _sorted_groups for groups of any size: 128-bit hashes of the members' windows are counted."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("open", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc, h, lo, hi, is_open, left, right in rows(batches, "doc", "h", "lo", "hi", "open", "left", "right"):
                raw = left[::-1] + right
                for s in range(hi - lo + 1):
                    w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(raw[s : s + LENGTH]), np.int64).tolist()
                    yield w1, w2, doc, h, lo + s, is_open

        yield from emit(schema, found())

    windows = members.mapInArrow(work, "w1 long, w2 long, doc long, h long, start int, open boolean")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return windows.where("open").join(again, ["w1", "w2"]).select("doc", "h", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(doc, h, text) -> (doc, h, start, end): byte ranges, with overlaps, of windows that also start elsewhere in any text; and (doc, h, n_shared).

    n_shared: how many of a text's chosen sequences are chosen in another row too, 0 left out. A string of `PASSAGE`
    bytes or more that two rows hold makes it 1 at least for both; one of fewer than `GRAM` never does.
    """
    grams = cut(_repeated_grams(docs))  # so that a hot gram's side of the join can be split
    found = cut(_anchor_rows(docs).join(grams, "gram"))
    shared = found.where("other").select("doc", "h", "gram").distinct().groupBy("doc", "h").agg(F.count("*").alias("n_shared"))
    chosen = found.where("at is not null").drop("other")
    spans = chosen.groupBy("gram", "s1", "s2").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "h", "at", "lo", "hi")).alias("one"))
    spans = cut(spans)
    settled = chosen.join(spans.where("copies > 1").select("gram", "s1", "s2"), ["gram", "s1", "s2"], "left_semi").select("doc", "h", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    groups = spans.groupBy("gram").agg(F.count("*").alias("members"), F.max(F.col("copies") == 1).alias("open")).where("open and members > 1").select("gram", "members")
    members = spans.join(groups, "gram").select("gram", "members", "one.*", (F.col("copies") == 1).alias("open"))
    small = _sorted_groups(_contexts(docs, members.where(F.col("members") <= GROUP)))
    large = cut(members.where(F.col("members") > GROUP))
    every = settled.unionByName(small).unionByName(shared, allowMissingColumns=True)
    return every.unionByName(_counted_groups(_contexts(docs, large)), allowMissingColumns=True) if large.limit(1).count() else every


def without_repeats(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    kept, place, removed, n = [], 0, 0, 0
    last = -1
    for start, end in sorted(spans):
        if start > last:
            kept.append(raw[place:start])
            n += 1
            removed += end - start
            place = last = end
        elif end > last:
            removed += end - last
            place = last = end
    kept.append(raw[place:])
    return b"".join(kept), removed, n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_shared): every row's text as UTF-8 bytes without those that a `LENGTH`-byte string covers which also starts anywhere else.

    Judged on the input, overlaps count, matches never cross texts. Null texts count as empty; texts shorter than
    `LENGTH` bytes are kept whole; a row repeated in full repeats its text and loses all of it if it is long enough.
    Null ids are returned as null and told apart by their texts; an empty table gives an empty table. Nothing is
    removed for n_shared, which reports passages shared with other rows that may be too short for that: repeated_spans().
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = base.select("doc", "h", "text")
    spans = repeated_spans(texts).groupBy("doc", "h").agg(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("spans"), F.max("n_shared").alias("n_shared"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_shared", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc_id, text, own, n_shared in rows(batches, "doc_id", "text", "spans", "n_shared"):
                raw = text.encode("utf-8", "surrogatepass")
                kept, removed, n = without_repeats(raw, [(o["start"], o["end"]) for o in own or ()])
                yield doc_id, len(raw), removed, n, kept, n_shared or 0

        yield from emit(schema, found(), 500)

    joined = base.join(spans, ["doc", "h"], "left")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
