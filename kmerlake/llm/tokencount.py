"""Unigram token counts: distinct pre-tokens share a trie in which each prefix's forward score is computed once."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import documents, emit

#: A trie is dropped and begun anew beyond this number of nodes; bounds a worker's memory.
MAX_NODES = 600_000
MARK = "▁"


class Unigram:
    """Pieces and log scores. The file's pieces are in order of rank; a piece of rank r scores -log(r + 2), a byte of a character without a piece `byte_score`."""

    def __init__(self, pieces: Iterable[str], byte_score: float | None = None):
        self.score: dict[str, float] = {}
        for rank, p in enumerate(pieces):
            self.score.setdefault(p, -math.log(rank + 2))
        self.longest = max(map(len, self.score), default=1)
        self.byte_score = byte_score if byte_score is not None else -2 * math.log(len(self.score) + 2)

    @classmethod
    def from_file(cls, path: str) -> "Unigram":
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        return cls(p.id_to_piece(i) for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)))


class ScoreTrie:
    """Trie of pre-tokens. A node holds the best (score, tokens) over segmentations of its prefix: the forward step looks back at the ancestors only, so it is made once however many pre-tokens share the prefix."""

    def __init__(self, model: Unigram):
        self.model = model
        self.child: dict[int, int] = {}  # node * 2**21 + code point -> node
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of the marked word; of equal scores the one with fewer tokens."""
        pieces, longest, child, score, tokens = self.model.score, self.model.longest, self.child, self.score, self.tokens
        text = MARK + word
        path, node = [0], 0
        for i, c in enumerate(text):
            down = child.get(node << 21 | ord(c))
            if down is None:
                n_bytes = len(c.encode("utf-8", "surrogatepass"))
                top, least = score[node] + n_bytes * self.model.byte_score, tokens[node] + n_bytes
                for start in range(max(0, i + 1 - longest), i + 1):
                    piece = pieces.get(text[start : i + 1])
                    if piece is not None:
                        s, n = score[path[start]] + piece, tokens[path[start]] + 1
                        if s > top or s == top and n < least:
                            top, least = s, n
                down = child[node << 21 | ord(c)] = len(score)
                score.append(top)
                tokens.append(least)
            node = down
            path.append(node)
        self.terminal[word] = tokens[node]
        return tokens[node]


def token_counts(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_words) for every row. A pre-token is a run without white space, with a word mark before it.

    Null and empty texts, or white space alone, count 0. Repeated rows are repeated. A task counts its texts in
    groups and looks each distinct pre-token up once; nothing is shuffled or gathered.
    """
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.from_file(model_file)

        def found():
            trie = ScoreTrie(model)
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                    words = (text or "").split()
                    if len(trie.score) > MAX_NODES:
                        trie = ScoreTrie(model)
                    known = trie.terminal
                    n = 0
                    for w in words:
                        k = known.get(w)
                        n += k if k is not None else trie.count(w)
                    yield i, n, len(words)

        yield from emit(schema, found())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, n_tokens long, n_words long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
