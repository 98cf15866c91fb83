"""Byte-level BPE through a sentencepiece model that is written straight from a file of byte ranks.

Each byte is written as one printable character, a piece of the vocabulary as the characters of its bytes with minus
its rank as score, under an identity normaliser. Sentencepiece then merges, in each pre-token, the neighbours whose
union has the highest score, the leftmost of equals first: the merges of the ranks. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import documents, plain_names

#: Bytes of a text that are cut into pre-tokens at a time.
PIECE_CHARS = 1 << 20
#: Distinct pre-tokens whose ids a Python worker remembers, of at most so many characters each; beyond it the later half goes.
CACHE_WORDS, CACHE_CHARS = 200_000, 64


def byte_letters() -> str:
    """A printable character for each byte: its own code point where that is visible in Latin-1, else the next free one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    visible = set(seen)
    return "".join(chr(b) if b in visible else chr(next(hidden)) for b in range(256))


LETTERS = byte_letters()
#: For str.translate of a text read as Latin-1.
TO_LETTERS = dict(enumerate(LETTERS))
FROM_LETTERS = {ord(c): b for b, c in enumerate(LETTERS)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece of a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: a varint, a 32-bit float or a length-delimited value."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def bpe_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model with the rank of each piece as its id, and an unknown piece after them.

    Ranks must be 0, 1, ... without a gap and hold every single byte, else ValueError. They stay below 2**24, so
    that a 32-bit score tells them apart.
    """
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without a gap and hold every byte")
    if len(pieces) >= 1 << 24:
        raise ValueError("too many ranks for 32-bit scores")
    # Field numbers and codes of the public model format, fixed values.
    PIECES, TRAINER, NORMALIZER = 1, 2, 3
    TEXT, SCORE, KIND, UNKNOWN = 1, 2, 3, 2
    MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 3, 2, 4, 40, 41, 42, 43, 45
    NAME, ADD_PREFIX, TRIM, ESCAPE = 1, 3, 4, 5
    none = (1 << 64) - 1  # -1
    unknown = "<unk>"
    out = [_field(PIECES, _field(TEXT, p.decode("latin-1").translate(TO_LETTERS).encode()) + _field(SCORE, -float(r))) for r, p in enumerate(pieces)]
    out.append(_field(PIECES, _field(TEXT, unknown.encode()) + _field(SCORE, 0.0) + _field(KIND, UNKNOWN)))
    trainer = _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(pieces) + 1) + _field(UNK_ID, len(pieces))
    trainer += b"".join(_field(n, none) for n in (BOS_ID, EOS_ID, PAD_ID)) + _field(UNK_PIECE, unknown.encode())
    normalizer = _field(NAME, b"identity") + b"".join(_field(n, 0) for n in (ADD_PREFIX, TRIM, ESCAPE))
    return b"".join([*out, _field(TRAINER, trainer), _field(NORMALIZER, normalizer)])


def _plane_pattern(pattern: str) -> re.Pattern | None:
    """`pattern` for texts of the Basic Multilingual Plane in the faster `re`, its classes \\p{L}, \\p{N}, \\s and \\S spelt out as `regex` knows them; None if it has other classes."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def members(kind: str) -> str:
        runs = (m.span() for m in regex.finditer(f"{kind}+", plane))
        return "".join(f"{re.escape(plane[a])}-{re.escape(plane[b - 1])}" for a, b in runs)

    known = {kind: members(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    parts = regex.findall(r"\[\^?(?:\\.(?:\{\w+\})?|[^\]\\])*\]|\\[pP]\{\w+\}|\\.|[^\\\[]+", pattern)
    if "".join(parts) != pattern:
        return None
    out = []
    for part in parts:
        if part.startswith("["):
            part = regex.sub(r"\\p\{[LN]\}|\\s", lambda m: known[m[0]], part)
        elif part in known:
            part = f"[{known[part]}]"
        elif part == r"\S":
            part = f"[^{known[chr(92) + 's']}]"
        out.append(part)
    spelt = "".join(out)
    return None if regex.search(r"\\[a-zA-Z]", regex.sub(r"\\[nrtfvx]", "", spelt)) else re.compile(spelt)


class ByteBPE:
    """Encoder of one vocabulary. Ids of each distinct short pre-token are made once and remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=bpe_model(ranks))
        self.pattern, self.plane = regex.compile(pattern), _plane_pattern(pattern)
        self.whole = {p.decode("latin-1").translate(TO_LETTERS): np.array([r], "<i4").tobytes() for p, r in ranks.items()}
        self.known: dict[str, bytes] = {}

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens. One that is a piece itself is that piece, whether or not merges lead to it."""
        letters = [w.encode().decode("latin-1").translate(TO_LETTERS) for w in words]
        out = [self.whole.get(x) for x in letters]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            lists = self.processor.encode([letters[i] for i in rest], num_threads=1)
            flat = np.fromiter(chain.from_iterable(lists), "<i4").tobytes()
            at = 0
            for i, ids in zip(rest, lists):
                end = at + 4 * len(ids)
                out[i] = flat[at:end]
                at = end
        return out

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text in lists of bounded size; matches run on over the whole text."""
        pattern = self.plane if self.plane and (text.isascii() or max(text) < "\U00010000") else self.pattern
        if len(text) <= PIECE_CHARS:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while part := [m[0] for m in islice(found, PIECE_CHARS // 4)]:
            yield part

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Remembers the ids of new short pre-tokens; the ids of long ones, which are not remembered."""
        new = words.difference(self.known)
        short = [w for w in new if len(w) <= CACHE_CHARS]
        if len(self.known) + len(short) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))
            new = words.difference(self.known)
            short = [w for w in new if len(w) <= CACHE_CHARS]
        self.known.update(zip(short, self._pieces(short)))
        long = [w for w in new if len(w) > CACHE_CHARS]
        return dict(zip(long, self._pieces(long)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Meant for lists of bounded size: their new pre-tokens are encoded together."""
        if any(len(t) > PIECE_CHARS for t in texts):
            return [b"".join(self._joined([words])[0] for words in self._pretokens(t)) for t in texts]
        return self._joined([next(self._pretokens(t)) for t in texts])

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        once = self._learn(set().union(*lists))
        known = self.known
        get = (lambda w: known[w] if w in known else once[w]) if once else known.__getitem__
        return [b"".join(map(get, words)) for words in lists]


class ByteDecoder:
    """The bytes of each id of a model: its piece's characters mapped back."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = {r: p.decode("latin-1").translate(TO_LETTERS) for p, r in ranks.items()}
        self.bytes = [bytes(map(FROM_LETTERS.__getitem__, map(ord, pieces[r]))) for r in range(len(pieces))]

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes of ids; None if an id has no piece."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes)):
            return None
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_LOADED: dict[tuple, ByteBPE | ByteDecoder] = {}


def _loaded(kind: type, path: str, *rest: str) -> ByteBPE | ByteDecoder:
    """The encoder or decoder of a worker, made once for all its tasks."""
    if (kind, path, *rest) not in _LOADED:
        if len(_LOADED) >= 2:
            _LOADED.clear()
        _LOADED[kind, path, *rest] = kind(read_ranks(path), *rest)
    return _LOADED[kind, path, *rest]


def _defaults(vocab_file: str | None, pattern: str | None) -> tuple[str, str]:
    if vocab_file is None or pattern is None:
        import public_tokenizers

        return vocab_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return vocab_file, pattern


#: Characters of text, or ids, after which a task hands on what it has.
HELD = 1 << 20


def _list_column(parts: list[bytes]) -> pa.Array:
    """Byte strings of 32-bit ids as lists."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends), values)


def encoded(docs: DataFrame, vocab_file: str | None = None, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """docs with a column ids_col: the byte-level BPE ids of each whole text, no special tokens; a column of that name is replaced.

    With bytes_col, the bytes that the ids decode to are added too, in the same pass; decoded() makes them of stored ids.

    Texts are read as strings of code points and split by `pattern`; each match is encoded on its own, and text that no
    match covers has no ids. Null and empty texts have an empty list. Repeated rows are repeated; other columns, with
    any names, stay. One very long text is cut into pre-tokens a piece at a time; one very long pre-token is merged in
    n log n steps. An empty table stays empty. Nothing is shuffled.
    """
    vocab_file, pattern = _defaults(vocab_file, pattern)
    inner, named = plain_names(docs)
    lost = {c.lower() for c in (ids_col, bytes_col) if c}
    kept = [c for old, c in zip(docs.columns, inner.columns) if old.lower() not in lost]
    names = [*kept, "ids", *(["b"] if bytes_col else [])]
    table = inner.select(*kept, F.col(named[text_col]).cast("string").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _loaded(ByteBPE, vocab_file, pattern)
        back = _loaded(ByteDecoder, vocab_file) if bytes_col else None
        for batch in batches:
            texts, held, chars, at = batch.column(len(kept)), [], 0, 0
            for i in range(batch.num_rows):
                held.append(texts[i].as_py() or "")
                chars += len(held[-1])
                if chars >= HELD or i + 1 == batch.num_rows:
                    parts = codec.encode(held)
                    own = [pa.array([back.decode(np.frombuffer(x, "<i4")) for x in parts], pa.binary())] if back else []
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns[: len(kept)], _list_column(parts), *own], names=names)
                    held, chars, at = [], 0, i + 1

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*kept).schema), "ids array<int>", *(["b binary"] if bytes_col else [])])
    out = table.mapInArrow(work, schema)
    added = [F.col("ids").alias(ids_col), *([F.col("b").alias(bytes_col)] if bytes_col else [])]
    return out.select(*[F.col(c).alias(old) for old, c in zip(docs.columns, inner.columns) if c in kept], *added)


def decoded(df: DataFrame, vocab_file: str | None = None, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with a binary column bytes_col: the bytes of each list of ids; a column of that name is replaced.

    Null where the list is null, holds a null, or holds an id without a piece; empty lists give no bytes. Repeated rows
    are repeated, other columns stay, an empty table stays empty.
    """
    vocab_file, _ = _defaults(vocab_file, None)
    inner, named = plain_names(df)
    kept = [c for old, c in zip(df.columns, inner.columns) if old.lower() != bytes_col.lower()]
    table = inner.select(*kept, F.col(named[ids_col]).cast("array<int>").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _loaded(ByteDecoder, vocab_file)
        for batch in batches:
            lists, parts, at, held = batch.column(len(kept)), [], 0, 0
            for i in range(batch.num_rows):
                ids = lists[i].values if lists[i].is_valid else None
                parts.append(None if ids is None or ids.null_count else codec.decode(ids.to_numpy(zero_copy_only=False)))
                held += 0 if ids is None else len(ids)
                if held >= HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(parts)).columns[: len(kept)], pa.array(parts, pa.binary())], names=[*kept, "b"])
                    parts, at, held = [], i + 1, 0

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*kept).schema), "b binary"])
    out = table.mapInArrow(work, schema)
    return out.select(*[F.col(c).alias(old) for old, c in zip(df.columns, inner.columns) if c in kept], F.col("b").alias(bytes_col))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole document: encoded, then decoded from the ids."""
    both = encoded(documents(spark, sf_dir).select("doc_id", "text"), bytes_col="decoded").drop("text")
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
