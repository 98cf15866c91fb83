"""Token-id shards: raw id payloads with a minimal perfect hash index from document keys to offsets.

Shard file, little-endian: ids (unsigned 16 bits where the vocabulary allows, else 32) of the shard's documents in
order; then the index arrays; then a JSON footer that places each array; its length in 8 bytes; the magic.
Index arrays: `key`, `nth` and `null` give the document id and the occurrence number of each document in order;
`bits` and `rank` are the perfect hash, `seat_offset`, `seat_count` and `seat_print` the payload place and the stored
fingerprint of each of its seats.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import cut, documents, emit, fresh_path, mix64

MAGIC = b"KLTOKEN1"
END_ID = 2
#: Rows of a shard, about.
SHARD_ROWS = 50_000
#: Distinct words whose ids a Python worker remembers; beyond it the later half goes, as common words come early.
CACHE_WORDS = 300_000
_SPACE = re.compile(r"[ \t-\r]+")
#: str.split() splits here, the tokenizers do not.
_ODD = re.compile("[\x1c-\x1f]")
_SMALL = re.compile("[a-zß-öø-ÿ]+")
#: Signs that end a word in a piece of their own: all of ASCII but the apostrophe.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words encoded as one text.
_ASKED = 2000
_GOLD = 0x9E3779B97F4A7C15


#: Steps that leave a word of small letters of ASCII and Latin-1 as it is and in one piece, but for the mapping of bytes; fixed values of the format.
_HARMLESS = {"Sequence", "NFC", "NFKC", "Lowercase", "Replace", "Split", "ByteLevel"}
_LETTER_RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _bare(config: dict):
    """(tokenizer, last, mapped): the file's model on words between blanks without the steps before it; None unless these steps leave words of _SMALL alone.

    last: which ids end a word, by the model's suffix; None without one. mapped: the steps write bytes as letters.
    """

    def steps(part: dict | None) -> list[dict]:
        own = (part or {}).get("normalizers") or (part or {}).get("pretokenizers") or []
        return [part, *(x for sub in own for x in steps(sub))] if part else []

    found = steps(config.get("normalizer")) + steps(config.get("pre_tokenizer"))
    alone = all(
        x["type"] in _HARMLESS
        and (x["type"] != "Replace" or x["pattern"] == {"Regex": "\\s+"})
        and (x["type"] != "Split" or x["pattern"] == {"Regex": _LETTER_RUNS} and x["invert"] and x["behavior"] == "Removed")
        and (x["type"] != "ByteLevel" or not x["add_prefix_space"] and not x.get("use_regex", True))
        for x in found
    )
    if not alone or not any(x["type"] == "Split" for x in found) or config["model"]["type"] != "BPE":
        return None
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json.dumps({**config, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
    suffix, last = config["model"].get("end_of_word_suffix"), None
    if suffix:
        last = np.zeros(max(config["model"]["vocab"].values()) + 1, bool)
        last[[i for t, i in config["model"]["vocab"].items() if t.endswith(suffix)]] = True
    return tokenizer, last, any(x["type"] == "ByteLevel" for x in found)


class WordEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokens never cross white space; ids of each distinct word are made once and remembered.

    White space ends words. Letters are lower-cased first only where the file's normaliser does so anyway
    and no special token can be made or lost by it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kinds = json.dumps(config.get("normalizer") or {})
        self.bare, self.last, mapped = _bare(config) or (None, None, False)
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        odd = [b for b in range(256) if b not in shown]
        self.letters = [(chr(b), chr(256 + i)) for i, b in enumerate(odd) if b >= 0x80] if mapped else []
        self.lower = '"Lowercase"' in kinds
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        if self.lower and "<" not in text and "Σ" not in text and "İ" not in text:
            text = text.lower()
        return _SPACE.split(text) if _ODD.search(text) else text.split()

    def _one_by_one(self, tokenizer, words: list[str]) -> Iterator[bytes]:
        for e in tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, self.kind).tobytes()

    def _small(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of _SMALL: many go as one text, and the suffix tells where each ends; one by one if it does not."""
        text = " ".join(words)
        if self.letters and not text.isascii():
            text = text.encode().decode("latin-1")
            for b, letter in self.letters:
                text = text.replace(b, letter)
        if self.last is not None:
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(words) and ends[-1] == len(ids):
                raw, w = ids.tobytes(), ids.itemsize
                return (raw[a * w : b * w] for a, b in zip([0, *ends], ends))
        return self._one_by_one(self.bare, text.split(" "))

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))
        known = self.known
        split: list[tuple[str, str, str]] = []
        ask: set[str] = set()
        for w in new:
            stem = w.rstrip(_SIGNS)
            if len(stem) < len(w) and stem.isalpha() and "<" not in w:
                signs = w[len(stem) :]
                split.append((w, stem, signs))
                if stem not in known:
                    ask.add(stem)
                if signs not in known:
                    ask.add(signs)
            else:
                ask.add(w)
        small = [w for w in ask if _SMALL.fullmatch(w)] if self.bare else []
        for at in range(0, len(small), _ASKED):
            part = small[at : at + _ASKED]
            known.update(zip(part, self._small(part)))
        asked = list(ask.difference(small))
        for at in range(0, len(asked), 20_000):
            part = asked[at : at + 20_000]
            known.update(zip(part, self._one_by_one(self.tokenizer, part)))
        for w, stem, signs in split:
            known[w] = known[stem] + known[signs]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        lists = [self._words(t or "") for t in texts]
        words = set().union(*lists)
        ids = dict(zip(words, map(self.known.get, words)))  # small beside all that is known, so quick to look up in
        new = [w for w, b in ids.items() if b is None]
        if new:
            self._learn(new)
            ids.update(zip(new, map(self.known.__getitem__, new)))
        get = ids.__getitem__
        return [b"".join(map(get, words)) for words in lists]


def _step(level: int) -> np.uint64:
    return np.uint64((level + 1) * _GOLD % (1 << 64))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays in which a key sits where it collides with none; a seat is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rank: np.ndarray):
        self.sizes, self.bits, self.rank = sizes, bits, rank

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> "PerfectHash":
        sizes, parts, left = [], [], keys
        while len(left):
            if len(sizes) > 60:
                raise ValueError("keys are not distinct")
            size = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = (mix64(left + _step(len(sizes))) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return cls(sizes, bits, np.concatenate(([0], np.cumsum(np.bitwise_count(bits)))).astype(np.uint32))

    def seats(self, keys: np.ndarray) -> np.ndarray:
        """Seat of each key, -1 where no level has its bit. A key that was not built in may get any seat."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mix64(keys[todo] + _step(level)) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.rank[at >> 6] + below)[hit]
            todo = todo[~hit]
            base += size
        return out


def _key(doc_id: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix64(mix64(doc_id.astype(np.int64).view(np.uint64) + null.astype(np.uint64) * np.uint64(_GOLD)) + nth.astype(np.uint64))


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    def __init__(self, sink, kind: np.dtype):
        self.sink, self.kind, self.n = sink, kind, 0
        self.id, self.null, self.count = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.sink.write(ids)
        self.id.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.count.append(len(ids) // self.kind.itemsize)
        self.n += self.count[-1]

    def close(self) -> None:
        """Write the index. Rows of one id follow each other and are numbered from 0."""
        ids, null, count = np.array(self.id, np.int64), np.array(self.null, bool), np.array(self.count, np.int64)
        n = len(ids)
        new = np.ones(n, bool)
        new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
        at = np.arange(n)
        nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint32) if n else at.astype(np.uint32)
        keys = _key(ids, null, nth)
        mph = PerfectHash.build(keys)
        seat = mph.seats(keys)
        arrays = {"key": ids, "nth": nth, "null": null.astype(np.uint8), "bits": mph.bits, "rank": mph.rank}
        for name, value in (("seat_offset", np.cumsum(count) - count), ("seat_count", count.astype(np.uint32)), ("seat_print", _print(keys)), ("seat_row", at.astype(np.uint32))):
            arrays[name] = np.empty_like(value)
            arrays[name][seat] = value
        places, place = {}, self.n * self.kind.itemsize
        for name, value in arrays.items():
            raw = value.tobytes()
            self.sink.write(raw)
            places[name] = [place, len(raw), value.dtype.str]
            place += len(raw)
        footer = json.dumps({"kind": self.kind.str, "ids": self.n, "docs": n, "sizes": mph.sizes, "arrays": places}).encode()
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Shard:
    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        n = int.from_bytes(tail[:8], "little")
        self.about = json.loads(source.read_at(n, size - 16 - n))
        self.kind = np.dtype(self.about["kind"])
        a = {k: np.frombuffer(source.read_at(length, place), dtype) for k, (place, length, dtype) in self.about["arrays"].items()}
        self.arrays, self.mph = a, PerfectHash(self.about["sizes"], a["bits"], a["rank"])

    def find(self, doc_id: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, count) of each key in ids; offset -1 where the shard lacks it: the stored fingerprint differs, or, where that agrees by chance, the key of the seat's row."""
        a = self.arrays
        if not self.about["docs"]:
            return np.full(len(doc_id), -1, np.int64), np.zeros(len(doc_id), np.uint32)
        keys = _key(doc_id, null, nth)
        seat = self.mph.seats(keys)
        row = a["seat_row"][seat]
        ok = (seat >= 0) & (a["seat_print"][seat] == _print(keys)) & (a["key"][row] == doc_id) & (a["null"][row] == null) & (a["nth"][row] == nth)
        return np.where(ok, a["seat_offset"][seat], -1), np.where(ok, a["seat_count"][seat], 0)

    def rows_of(self, doc_id: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The row in the shard of each key that find() finds; any row for others."""
        if not self.about["docs"]:
            return np.zeros(len(doc_id), np.int64)
        return self.arrays["seat_row"][self.mph.seats(_key(doc_id, null, nth))].astype(np.int64)

    def ids(self, offset: int, count: int) -> np.ndarray:
        w = self.kind.itemsize
        return np.frombuffer(self.source.read_at(count * w, offset * w), self.kind)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file, kept for its later tasks. A task's function carries copies of the globals it names, so it must not name the table itself."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write every row's ids, end_id appended, as shards under path, in ascending order of the id (null first; rows of one id by their text's hash).

    Returns the manifest (shard, file, docs, ids, first, last, nulls, tail, start, row, carry): first and last are a
    shard's least and greatest id, null without any; nulls and tail count its rows of null id and of its last one; start
    and row count the ids and the rows of all shards before, carry those of them that have the shard's first id, null
    or not. A shard numbers the rows of an id from 0, so with carry they are numbered through all shards. An empty table gives shards without documents. Null texts count
    as empty. Each shard is written to a name of its own attempt, then renamed, so a repeated task leaves one whole file.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // shard_rows))
    dealt = base.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("nulls", pa.int64()), ("tail", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        encoder = _encoder(tokenizer_file)
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        name = f"shard-{shard:07d}.ids"
        draft = f"{root}/.{name}.{task.taskAttemptId()}"
        end = np.array([end_id], encoder.kind).tobytes()
        with fs.open_output_stream(draft) as sink:
            writer = ShardWriter(sink, encoder.kind)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for at in range(0, len(ids), 256):
                    for i, got in zip(ids[at : at + 256], encoder.encode(texts.slice(at, 256).to_pylist())):
                        writer.add(i, got + end)
            writer.close()
        if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
            fs.move(draft, f"{root}/{name}")
        else:
            fs.delete_file(draft)
        nulls = sum(writer.null)
        own = writer.id[nulls:]
        first, last = (own[0], own[-1]) if own else (None, None)
        tail = own.count(last) if own else nulls
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((shard, f"{path}/{name}", len(writer.id), writer.n, first, last, nulls, tail), schema)], schema=schema)

    written = cut(dealt.mapInArrow(work, "shard int, file string, docs long, ids long, first long, last long, nulls long, tail long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    count = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    manifest = written.withColumn("start", count("ids")).withColumn("row", count("docs"))
    # The row at which the run of a shard's last id begins; the earliest of them is where the id begins.
    begins = manifest.where("docs > 0").groupBy(F.col("last").alias("_last")).agg(F.min(F.col("row") + F.col("docs") - F.col("tail")).alias("_begin"))
    begun = F.when(F.col("nulls") > 0, F.lit(None).cast("long")).otherwise(F.col("first")).eqNullSafe(F.col("_last")) & (F.col("docs") > 0)
    return manifest.join(F.broadcast(begins), begun, "left").withColumn("carry", F.greatest(F.lit(0), F.coalesce(F.col("row") - F.col("_begin"), F.lit(0)))).drop("_last", "_begin")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, nth, start, n_tokens, ids_crc32) of every document in the files, each found through its shard's index. nth numbers the documents of an id, null included, from 0 through all shards."""
    schema = pa.schema([("doc_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for uri, start, carry in zip(*(c.to_pylist() for c in batch.columns)):
                    fs, place = _open(uri)
                    with fs.open_input_file(place) as source:
                        shard = Shard(source)
                        a = shard.arrays
                        offset, count = shard.find(a["key"], a["null"], a["nth"])
                        first = (a["null"] == a["null"][:1]) & (a["key"] == a["key"][:1])
                        nth = a["nth"].astype(np.int64) + np.where(first, carry, 0)
                        for k in range(len(offset)):
                            ids = shard.ids(int(offset[k]), int(count[k]))
                            yield None if a["null"][k] else int(a["key"][k]), int(nth[k]), start + int(offset[k]), int(count[k]), zlib.crc32(ids.astype("<u4").tobytes())

        yield from emit(schema, found())

    return manifest.select("file", "start", "carry").repartition(n, "file").mapInArrow(work, "doc_id long, nth long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id", nth_col: str | None = None) -> DataFrame:
    """(doc_id, ids) of the first document of each key's id, or with nth_col (doc_id, nth, ids) of the one that it numbers. Keys that no shard holds are left out; a null id is a key like any other, a null number none.

    One index probe in the shard where the id begins finds the first; a later one is that many rows further on, in that
    shard or in one that its row number tells. Keys are dealt by range, so a task opens only the shards of its range.
    """
    shards = manifest.where("docs > 0").select("file", "last", "row").orderBy("shard").collect()  # one row for each shard
    files, rows = [r["file"] for r in shards], np.array([r["row"] for r in shards], np.int64)
    dated = np.array([i for i, r in enumerate(shards) if r["last"] is not None] + [len(shards)], np.int64)
    lasts = np.array([r["last"] for r in shards if r["last"] is not None], np.int64)
    nth = F.col(nth_col).cast("long") if nth_col else F.lit(0).cast("long")
    wanted = keys.select(F.col(id_col).cast("long").alias("doc_id"), nth.alias("nth")).where("nth >= 0").distinct()
    wanted = wanted.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    schema = pa.schema([("doc_id", pa.int64()), ("nth", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def probe(file: int, key: np.ndarray, null: np.ndarray, nth: np.ndarray):
            fs, name = _open(files[file])
            with fs.open_input_file(name) as source:
                shard = Shard(source)
                offset, count = shard.find(key, null, nth)
                place = shard.rows_of(key, null, nth)
                return np.where(offset >= 0, rows[file] + place, -1), [shard.ids(int(o), int(c)).tolist() if o >= 0 else None for o, c in zip(offset, count)]

        def found():
            for batch in batches:
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                nth = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                file = np.where(null == 1, 0, dated[np.searchsorted(lasts, ids)])  # an id over several shards begins in the first
                later = []
                for at in np.unique(file[file < len(files)]):
                    here = np.flatnonzero(file == at)
                    zero = np.zeros(len(here), np.int64)
                    row, texts = probe(at, ids[here], null[here], zero)
                    for k, r, t in zip(here, row, texts):
                        if r >= 0 and nth[k] == 0:
                            yield None if null[k] else int(ids[k]), 0, t
                        elif r >= 0:
                            later.append((int(np.searchsorted(rows, r + nth[k], "right")) - 1, int(at), int(r), k))
                for at in sorted({x[0] for x in later}):
                    own = [x for x in later if x[0] == at]
                    here = np.array([x[3] for x in own])
                    local = np.array([nth[k] if start == at else r + nth[k] - rows[at] for _, start, r, k in own])
                    row, texts = probe(at, ids[here], null[here], local)
                    for k, r, t in zip(here, row, texts):
                        if r >= 0:
                            yield None if null[k] else int(ids[k]), int(nth[k]), t

        yield from emit(schema, found(), 500)

    out = wanted.mapInArrow(work, "doc_id long, nth long, ids array<long>")
    return out if nth_col else out.drop("nth")


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    manifest = write_shards(docs, tokenizer_file or word_bpe_file(), fresh_path(docs.sparkSession, "token-shards"))
    return read_shards(manifest)


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")
