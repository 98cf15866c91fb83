"""Line dedup by exact set-similarity join; later matches are removed. Texts are cut and prefix buckets compared in Arrow batches, the rest is DataFrame functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import BROADCAST_BYTES, PIECE, cut, documents, fresh_path, hashed_words, mix64, plain_names, sized
from kmerlake.llm.setjoin import SLOTS, needed, percent, shared, verified

LEAST = 0.8
#: Rows of a prefix token compared all against all; larger buckets are compared tile by tile first.
HOT = 1024
#: Rows of whole buckets compared at a time.
BLOCK = 1 << 17
#: A slot of prefix tokens with more than this share of all prefix rows is dealt over several tasks; there are at most 1 / SHARE of them.
SHARE = 1 / 1024
_TOKEN_SLOTS = 1 << 16
_FIRST_ID = -(1 << 63)
#: A line's number within all rows of its id: the row's number, then this many bits for the line's number in the row.
LINE_BITS = 28
_LOW = np.uint64((1 << 56) - 1)
#: Columns that equal word sets share.
KIND = ("k", "n", "bits", "more")
_WORDS = np.ones(256, bool)
_WORDS[[9, 10, 13, 32]] = False


def line_tokens(line: "F.Column") -> "F.Column":
    """Hashes of the distinct words of a line, in lower case; blanks, tabs and carriage returns end words."""
    spaced = F.replace(F.replace(F.lower(line), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.array_distinct(F.transform(F.array_remove(F.split(spaced, " "), ""), lambda w: F.xxhash64(w)))


def _needed(n: np.ndarray, pct: int) -> np.ndarray:
    """Least number of a set's tokens that a match shares with it."""
    return (n * pct + 99) // 100


def _shared(n: np.ndarray, m: np.ndarray, pct: int) -> np.ndarray:
    """Least number of tokens that matching sets of these sizes share."""
    return ((n + m) * pct + 99 + pct) // (100 + pct)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """(ids and numbers of rows, texts) of about PIECE bytes; a longer text comes alone."""
    ids: list[tuple[int, int]] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = t.as_py()
            if texts and held + len(raw) > PIECE:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append((i, row))
            texts.append(raw)
            held += len(raw)
    if texts:
        yield ids, texts


def _cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, line) of each word, lines numbered through all texts, and the first line of each text."""
    raw = b"\n".join(texts)
    hashes, start, _ = hashed_words(raw, _WORDS)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return hashes, np.searchsorted(ends, start), np.searchsorted(ends, begins)


def _rarity(base: DataFrame) -> np.ndarray:
    """SLOTS bytes: how common the tokens of a slot are, five steps to two doublings. Every word of every text counts; the table's size is fixed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for _, texts in _chunks(batches):
            hashes = _cut_words(texts)[0]
            n += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at])], names=["slot", "n"])

    table = np.zeros(SLOTS)
    for slot, n in base.mapInArrow(work, "slot int, n long").groupBy("slot").agg(F.sum("n")).toLocalIterator():
        table[slot] = n
    return np.floor(np.log2(table + 1) * 2.5).astype(np.uint64)


def _by_line(line: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (line, ranked) in order. One sort by as much of both as 64 bits hold; the rare ties in these are sorted by all of it."""
    bits = np.uint64(max(1, int(line[-1]).bit_length()))
    key = (line.astype(np.uint64) << (np.uint64(64) - bits)) | (ranked >> bits)
    order = np.argsort(key)
    key, r = key[order], ranked[order]
    if ((key[1:] == key[:-1]) & (r[1:] != r[:-1])).any():
        order = np.lexsort((ranked, line))
        r = ranked[order]
    line = line[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (line[1:] != line[:-1])
    return line[new], r[new]


def _line_table(base: DataFrame, pct: int) -> DataFrame:
    """(doc, no, k, n, bits, more, prefix) of every line that has a word, written in the shared folder.

    k, n, bits and more (128 parity bits) tell a word set from all others; prefix holds the rarest tokens, and is
    empty where only an equal set can match. The tokens themselves are not kept: those of the few lines that get as
    far as a comparison are cut out of the texts again.
    """
    base = base.where("text is not null").select("doc", "row", F.lower("text").cast("binary").alias("text"))
    level = _rarity(base)
    names = ["doc", "no", *KIND, "prefix"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            hashes, line, first = _cut_words(texts)
            if not len(hashes):
                continue
            line, r = _by_line(line, (level[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)] << np.uint64(56)) | (hashes & _LOW))
            start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            n = np.diff(np.concatenate((start, [len(line)])))
            line = line[start]
            text = np.searchsorted(first, line, "right") - 1
            bit = (r >> np.uint64(16)) & np.uint64(127)
            one = np.uint64(1) << (bit & np.uint64(63))
            halves = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == np.uint64(half), one, np.uint64(0)), start) for half in (0, 1)]
            size = np.where((_needed(n, pct) < n) | (n * 100 // pct > n), n - _needed(n, pct) + 1, 0)
            offset = np.concatenate(([0], np.cumsum(size)))
            taken = np.repeat(start - offset[:-1], size) + np.arange(offset[-1])
            prefix = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(mix64(r[taken]).astype(np.uint32).view(np.int32)))
            own = line - first[text]
            if int(own.max()) >> LINE_BITS:
                raise ValueError("a text has too many lines")
            rows = np.array(ids, np.int64).reshape(-1, 2)[text]
            columns = [rows[:, 0], (rows[:, 1] << LINE_BITS) | own, np.add.reduceat(mix64(r), start).view(np.int64), n.astype(np.int32), *[x.view(np.int64) for x in halves]]
            yield pa.record_batch([*map(pa.array, columns), prefix], names=names)

    path = fresh_path(base.sparkSession, "lines")
    base.mapInArrow(work, "doc long, no long, k long, n int, bits long, more long, prefix array<int>").write.parquet(path)
    return base.sparkSession.read.parquet(path)


def _classes(lines: DataFrame) -> DataFrame:
    """(k, n, bits, more, doc, no, prefix, lines) of each word set: its first line and how many it has, written in the shared folder."""
    path = fresh_path(lines.sparkSession, "line-classes")
    found = lines.groupBy(*KIND).agg(F.min(F.struct("doc", "no", "prefix")).alias("f"), F.count("*").alias("lines"))
    found.select(*KIND, "f.*", "lines").write.parquet(path)
    return lines.sparkSession.read.parquet(path)


def _prefix_rows(classes: DataFrame) -> DataFrame:
    return classes.where("size(prefix) > 0").select("doc", "no", "n", "bits", "more", F.posexplode("prefix").alias("i", "token"))


def _best(cols: list[np.ndarray], start: np.ndarray, split: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, others): for each row the earlier line likeliest to match it among those that may, -1 if none.

    Rows (doc, no, n, bits, more, i) are in tiles that begin at start, by n in each; every two of a tile pass the
    length, position and parity filters or cannot match. others: more than one may, or the tile is a part of a bucket.
    """
    doc, no, n, bits, more, i = cols
    rows = len(n)
    at = np.arange(rows)
    tile = np.repeat(np.arange(len(start)), np.diff(np.concatenate((start, [rows]))))
    place = (tile << 32) | n
    window = at - np.searchsorted(place, (tile << 32) | _needed(n, pct))
    short = i <= n - _shared(n, n, pct)
    by = np.argsort(-window, kind="stable")
    active = np.searchsorted(-window[by], -np.arange(1, int(window.max(initial=0)) + 1), "right")
    rank = np.empty(rows, np.int64)
    rank[np.lexsort((no, doc))] = at
    best = np.full(rows, np.iinfo(np.int64).max)
    many = np.zeros(rows, np.int64)
    for d, upto in enumerate(active, 1):
        x = by[:upto]
        y = x - d
        keep = short[y]
        x, y = x[keep], y[keep]
        differ = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) + np.bitwise_count(more[x] ^ more[y])
        both = _shared(n[x], n[y], pct)
        keep = differ <= n[x] + n[y] - 2 * both
        x, y, both, differ = x[keep], y[keep], both[keep], differ[keep]
        keep = np.minimum(n[x] - i[x], n[y] - i[y]) >= both
        x, y, differ = x[keep], y[keep], differ[keep]
        later = rank[x] > rank[y]
        a, b = np.where(later, x, y), np.where(later, y, x)
        np.minimum.at(best, a, (differ << 40) | rank[b])
        np.add.at(many, a, 1)
    of_rank = np.empty(rows, np.int64)
    of_rank[rank] = at
    found = many > 0
    partner = np.where(found, of_rank[np.where(found, best & ((1 << 40) - 1), 0)], -1)
    others = (many > 1) | split
    row = np.flatnonzero(found | others)
    return row, partner[row], others[row]


def _blocks(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, starts of tiles, which rows are of a bucket in parts) of rows sorted by (token, part, n); a tile has at most most rows."""
    held: list[np.ndarray] | None = None
    begun: list[tuple] = [()]  # the bucket of which tiles have gone

    def tiles(cols: list[np.ndarray], end: bool) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
        token, part = cols[0], cols[1]
        start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.concatenate((start, [len(token)])))
        if not end:  # the last bucket goes on, but whole tiles of it can go
            stay = size[-1] % most if size[-1] > 2 * most else size[-1]
            size = np.append(size[:-1], size[-1] - stay)
            start, size = start[size > 0], size[size > 0]
        upto = int(size.sum())
        going = [(int(token[s]), int(part[s])) == begun[0] for s in start[:1]] + [False] * (len(start) - 1)
        split = np.repeat((size > most) | (part[start] >= 0) | np.array(going, bool), size)
        begun[0] = (int(token[start[-1]]), int(part[start[-1]])) if len(start) else ()
        within = np.arange(upto) - np.repeat(start, size)
        return upto, [c[:upto] for c in cols[2:]], np.flatnonzero(within % most == 0), split

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols[5:7] = [c.view(np.uint64) for c in cols[5:7]]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if len(held[0]) >= block:
            upto, *found = tiles(held, False)
            if upto:
                yield tuple(found)
                held = [c[upto:] for c in held]
    if held is not None and len(held[0]):
        yield tuple(tiles(held, True)[1:])


def _candidates(classes: DataFrame, pct: int) -> DataFrame:
    """(a, b, others) for each line of a class that earlier ones may match: the likeliest of its bucket, and whether there may be others."""
    rows = _prefix_rows(classes)
    slot = F.pmod(F.col("token"), F.lit(_TOKEN_SLOTS))
    counts = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("rows"))
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    limit = max(HOT, total * SHARE)
    hot = counts.where(F.col("rows") > limit).select("slot", F.ceil(F.col("rows") / limit).alias("parts"))
    dealt = rows.join(F.broadcast(hot), slot == F.col("slot"), "left")  # at most 1 / SHARE rows
    part = F.coalesce(F.pmod(F.xxhash64("doc", "no"), F.col("parts")), F.lit(-1)).cast("int")
    dealt = dealt.select("token", part.alias("part"), "doc", "no", "n", "bits", "more", "i")
    dealt = dealt.repartition("token", "part").sortWithinPartitions("token", "part", "n")
    names = ["adoc", "ano", "bdoc", "bno", "others"]
    most, block = HOT, BLOCK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, start, split in _blocks(batches, most, block):
            doc, no, *rest = cols
            row, partner, others = _best([doc, no, rest[0].astype(np.int64), *rest[1:3], rest[3].astype(np.int64)], start, split, pct)
            none = partner < 0
            yield pa.record_batch([pa.array(doc[row]), pa.array(no[row]), pa.array(doc[partner], mask=none), pa.array(no[partner], mask=none), pa.array(others)], names=names)

    found = dealt.mapInArrow(work, "adoc long, ano long, bdoc long, bno long, others boolean")
    a, b = F.struct(F.col("adoc").alias("doc"), F.col("ano").alias("no")), F.struct(F.col("bdoc").alias("doc"), F.col("bno").alias("no"))
    return cut(found.select(a.alias("a"), F.when(F.col("bdoc").isNotNull(), b).alias("b"), "others").distinct())


def _later(x: str, y: str) -> "F.Column":
    return (F.col(f"{x}.doc") > F.col(f"{y}.doc")) | ((F.col(f"{x}.doc") == F.col(f"{y}.doc")) & (F.col(f"{x}.no") > F.col(f"{y}.no")))


def _tokens_of(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, tokens) of the lines in pairs, ids being structs of doc and no, read again from the texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    row = F.shiftright("id.no", LINE_BITS)
    wanted = cut(ids.groupBy(F.col("id.doc").alias("want"), row.alias("want_row")).agg(F.collect_list("id.no").alias("nos")))
    n_bytes = wanted.agg(F.sum(F.size("nos") * 8 + 56)).first()[0] or 0
    wanted = F.broadcast(wanted) if n_bytes <= BROADCAST_BYTES else wanted  # so that few lines are found without a shuffle of the texts
    chosen = base.join(wanted, (F.col("doc") == F.col("want")) & (F.col("row") == F.col("want_row")))
    lines = chosen.select("doc", "row", "nos", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("doc", (F.shiftleft("row", LINE_BITS) + F.col("at")).alias("no"), "nos", "line").where(F.array_contains("nos", F.col("no")))
    return lines.select(F.struct("doc", "no").alias("id"), line_tokens(F.col("line")).alias("tokens"))


def _may_match(pct: int) -> "F.Column":
    """Length, position and parity filters of prefix rows aliased x and y. Never false for a match."""
    nx, ny, ix, iy = (F.col(f"{a}.{c}") for c in ("n", "i") for a in ("x", "y"))
    both = shared(nx, ny, pct)
    differ = sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in ("bits", "more"))
    return (F.least(nx, ny) >= needed(F.greatest(nx, ny), pct)) & (F.least(nx - ix, ny - iy) >= both) & (differ <= nx + ny - 2 * both)


def _rest(classes: DataFrame, left: DataFrame, pct: int) -> DataFrame:
    """(a, b): every earlier line b that may match a line a of left."""
    rows = _prefix_rows(classes).withColumn("level", F.floor(F.log("n") / math.log(100 / pct)).cast("int"))
    own = left.select(F.col("a.doc").alias("_doc"), F.col("a.no").alias("_no"))
    x = rows.join(own, (F.col("doc") == F.col("_doc")) & (F.col("no") == F.col("_no"))).drop("_doc", "_no")
    x = cut(x.withColumn("level", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))))
    x, y = sized(x, 64).alias("x"), rows.alias("y")
    pairs = y.join(x, (F.col("x.token") == F.col("y.token")) & (F.col("x.level") == F.col("y.level")) & _later("x", "y") & _may_match(pct))
    return cut(pairs.select(F.struct("x.doc", "x.no").alias("a"), F.struct("y.doc", "y.no").alias("b")).distinct())


def _matched(base: DataFrame, pairs: DataFrame, pct: int) -> DataFrame:
    """(a) that match a b of theirs."""
    return cut(verified(pairs, cut(_tokens_of(base, pairs)), pct).select("a").distinct())


def numbered(docs: DataFrame, id_: "F.Column", text: "F.Column") -> DataFrame:
    """docs with _doc, the id or, where it is null, the least one, and _row, the row's number from 0 among those of its id.

    Rows that share an id are numbered in the order of a hash of their texts, equal ones in any. They are sorted in
    ranges that may split an id, written in the shared folder and counted there; only the counts of the ranges reach the
    driver. Where all ids differ, which takes a count of the ids alone, nothing is written.
    """
    rows = docs.withColumn("_doc", F.coalesce(id_.cast("long"), F.lit(_FIRST_ID)))
    many = cut(rows.groupBy("_doc").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_doc").alias("_many")))
    if not many.limit(1).count():
        return rows.withColumn("_row", F.lit(0).cast("long"))
    many = sized(many, 16)
    alone = rows.join(many, F.col("_doc") == F.col("_many"), "left_anti").withColumn("_row", F.lit(0).cast("long"))
    own = rows.join(many, F.col("_doc") == F.col("_many"), "left_semi").withColumn("_hash", F.xxhash64(text)).withColumn("_salt", F.rand(1))
    own = cut(own.repartitionByRange("_doc", "_hash", "_salt").sortWithinPartitions("_doc", "_hash").drop("_salt"))
    own = own.withColumn("_at", F.monotonically_increasing_id())  # range << 33, then the place in the range
    counts = {r["p"]: r["n"] for r in own.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    spark = docs.sparkSession
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "_p long, _before long"))  # a row a range
    own = own.join(starts, F.shiftright("_at", 33) == F.col("_p")).withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    first = sized(own.groupBy(F.col("_doc").alias("_many")).agg(F.min("_at").alias("_first")), 24)
    own = own.join(first, F.col("_doc") == F.col("_many")).withColumn("_row", F.col("_at") - F.col("_first"))
    return alone.unionByName(own.select(*alone.columns))


def _removed(rows: DataFrame, text: "F.Column", least: float) -> DataFrame:
    """(_d, _r, no) of the lines of numbered() rows that repeat an earlier one."""
    pct = percent(least)
    base = rows.select(F.col("_doc").alias("doc"), F.col("_row").alias("row"), text.cast("string").alias("text"))
    lines = _line_table(base, pct)
    classes = _classes(lines)
    found = _candidates(classes, pct)
    pairs = found.where("b is not null").select("a", "b")
    lost = _matched(base, pairs, pct)
    left = cut(found.where("others").select("a").distinct().join(lost, "a", "left_anti"))
    if left.limit(1).count():
        others = cut(_rest(classes, left, pct).join(pairs, ["a", "b"], "left_anti"))
        lost = lost.unionByName(_matched(base, others, pct))
    lost = lost.select("a.doc", "a.no", F.lit(True).alias("lost"))
    gone = classes.select(*KIND, "doc", "no", "lines").join(lost, ["doc", "no"], "left").where("lines > 1 or lost")
    firsts = gone.select(*KIND, F.struct("doc", "no").alias("first"), F.coalesce("lost", F.lit(False)).alias("lost"))
    every = lines.select(*KIND, "doc", "no").join(firsts, list(KIND))
    every = every.where(F.col("lost") | (F.struct("doc", "no") != F.col("first")))  # a line, a class and a lost class have one row each
    return every.select(F.col("doc").alias("_d"), F.shiftright("no", LINE_BITS).alias("_r"), F.col("no").bitwiseAND((1 << LINE_BITS) - 1).cast("int").alias("no"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, row, no) of every line, numbered from 0, that repeats an earlier one: the Jaccard index of their word sets is at least `least`.

    Earlier is by document id, then row, then line number, judged on the input; a null id counts as the least id and is
    returned as such. Rows that share an id, null included, stay documents of their own: `row` numbers them from 0 in
    the order of a hash of their texts, and 0 is the only row of an id that no other has. Of rows repeated in full the
    first keeps its lines. Lines without words are never removed; null texts have no lines, and an empty table gives
    none. A very long text is cut as a whole in one task.
    Lines of equal word sets are one class, represented by its first line. In each bucket of a prefix token a class is
    held against the likeliest of the earlier ones that pass the filters, which settles groups of near copies without
    their pairs; only classes left over that have other candidates meet all of these.
    """
    rows = numbered(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), F.col("i"), F.col("t"))
    return _removed(rows, F.col("t"), least).select(F.col("_d").alias("doc_id"), F.col("_r").alias("row"), "no")


def _with_removed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Columns of numbered() rows with _gone, the numbers of their lines that go, null if none does."""
    gone = gone.groupBy("_d", "_r").agg(F.array_sort(F.collect_list("no")).alias("_gone"))
    return rows.join(gone, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")), "left")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every row: its lines, and the numbers of those that go, joined by commas.

    A null text has 0 lines; a very long one is cut as a whole. Rows that share an id, null or not, have a report each.
    """
    rows = numbered(docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")), F.col("i"), F.col("t"))
    n_lines = F.greatest(F.coalesce(F.size(F.split("t", "\n")), F.lit(0)), F.lit(0))
    counted = rows.select("i", "_doc", "_row", n_lines.alias("n_lines"))  # before the join, which then shuffles no text
    joined = _with_removed(counted, _removed(rows, F.col("t"), least))
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    return joined.select(F.col("i").alias("doc_id"), "n_lines", F.size(removed).alias("n_removed"), F.array_join(removed, ",").alias("removed"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs, all columns, with the later matches taken out of its texts. Other columns may have any names; rows that share an id, null or not, are documents of their own."""
    inner, name = plain_names(docs)
    text = F.col(name[text_col])
    rows = numbered(inner, F.col(name[id_col]), text)
    joined = _with_removed(rows, _removed(rows, text, least))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False))), "\n")
    return joined.withColumn(name[text_col], F.when(F.col("_gone").isNull(), text).otherwise(kept)).select(*inner.columns).toDF(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS no, list_filter(list_distinct(string_split(replace(replace(lower(ls[i]), chr(9), ' '), chr(13), ' '), ' ')), lambda w: w <> '') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
k AS (SELECT doc_id, no, list_sort(w) AS s, len(w) AS n FROM l WHERE len(w) > 0),
c AS (SELECT s, n, min({'d': doc_id, 'n': no}) AS p FROM k GROUP BY s, n),
f AS (SELECT t, count(*) AS freq FROM (SELECT unnest(s) AS t FROM c) GROUP BY t),
r AS (SELECT p, n, t, row_number() OVER (PARTITION BY p ORDER BY freq, t) AS rn FROM (SELECT p, n, unnest(s) AS t FROM c WHERE n >= 4) JOIN f USING (t)),
x AS (SELECT * FROM r WHERE rn <= n - (n * 80 + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.p AS pa, b.p AS pb FROM x a JOIN x b ON a.t = b.t AND a.p > b.p AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
lost AS (
  SELECT DISTINCT pa FROM cand JOIN c a ON a.p = pa JOIN c b ON b.p = pb
  WHERE len(list_intersect(a.s, b.s)) * 100 >= (a.n + b.n - len(list_intersect(a.s, b.s))) * 80),
gone AS (
  SELECT k.doc_id, k.no FROM k JOIN c USING (s, n) LEFT JOIN lost ON lost.pa = c.p
  WHERE {'d': k.doc_id, 'n': k.no} <> c.p OR lost.pa IS NOT NULL)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::INTEGER AS n_lines, count(gone.no)::INTEGER AS n_removed,
  coalesce(array_to_string(list_sort(list(gone.no::INTEGER) FILTER (WHERE gone.no IS NOT NULL)), ','), '') AS removed
FROM documents d LEFT JOIN gone USING (doc_id) GROUP BY d.doc_id, d.text
"""
