"""Language identification by nearest centroid: normalised TF-IDF character n-grams, several clustered centroids per language, cosine distance with rejection."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import documents, emit, mix64, rows, uniform

#: Bound on labelled rows that the fit gathers, shared evenly by the languages.
MAX_FIT_ROWS = 2400
DIMS = 4096
CENTROIDS = 4
#: A text is rejected if its distance from the nearest centroid is above this quantile of the fit rows' distances there.
REJECT_QUANTILE = 0.999
_CHUNK = 1 << 18
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def ngram_counts(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Hashed counts of 1- to 3-letter sequences within words, word ends marked. None if the text has no letter."""
    if not text:
        return None
    total = np.zeros(dims, np.float32)
    some = False
    for at in range(0, len(text), _CHUNK):
        part = text[max(0, at - 2) : at + _CHUNK].lower()
        a = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        a = np.concatenate(([0], np.where(_letters()[a], a, 0), [0])).astype(np.uint64)
        a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]
        if not a.any():
            continue
        some = True
        two = a[:-1] * np.uint64(0x110001) + a[1:]
        three = two[:-1] * np.uint64(0x110001) + a[2:]
        for n, codes in ((1, a[a != 0]), (2, two), (3, three)):
            if len(codes):
                slot = (codes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(40)
                total += np.bincount((slot % np.uint64(dims)).astype(np.int64), minlength=dims)
    return total if some else None


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (k, dims), unit length
    owner: np.ndarray  # language of each centroid
    radius: np.ndarray  # greatest accepted cosine distance of each centroid

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / (np.linalg.norm(v) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine with its nearest centroid, rejected). 'und', 0, True for a text without letters or an empty model."""
        counts = ngram_counts(text, len(self.idf))
        if counts is None or not self.langs:
            return "und", 0.0, True
        cos = self.centroids @ self.vector(counts)
        best = int(cos.argmax())
        return self.langs[self.owner[best]], float(min(1.0, max(0.0, cos[best]))), bool(1.0 - cos[best] > self.radius[best])


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means with farthest-first starts; at most k unit centroids."""
    centre = x.mean(axis=0)
    start = [x[int((x @ centre).argmax())]]
    while len(start) < min(k, len(x)):
        start.append(x[int((x @ np.array(start).T).max(axis=1).argmin())])
    c = np.array(start)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS, dims: int = DIMS, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on at most max_rows labelled rows (a hash sample of each language), whole texts. Rows without a label, or whose text has no letter, are left out."""
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), uniform(F.col(order_col), F.lit("langid")).alias("u"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(max_rows).collect()}
    if not sizes:
        return LanguageModel([], np.ones(dims, np.float32), np.empty((0, dims), np.float32), np.empty(0, int), np.empty(0))
    quota = max(1, max_rows // len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, quota / n))])
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for text, lang in rows(batches, "text", "lang"):
                counts = ngram_counts(text, dims)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    yield lang, at.astype(np.int32), counts[at]

        yield from emit(schema, found(), 500)

    got = known.where(F.col("u") < F.element_at(share, F.col("lang"))).select("text", "lang").mapInArrow(work, "lang string, at array<int>, n array<float>").limit(2 * max_rows).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    x = np.zeros((got.num_rows, dims), np.float32)
    for i, (at, n) in enumerate(zip(got.column("at"), got.column("n"))):
        x[i, np.asarray(at.values)] = np.asarray(n.values)
    y = np.array([langs.index(v) for v in got.column("lang").to_pylist()], int)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = np.log1p(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    cents, owner, radius = [], [], []
    for j in range(len(langs)):
        own = x[y == j]
        found = _cluster(own, centroids)
        near = (own @ found.T).argmax(axis=1)
        for i, c in enumerate(found):
            members = own[near == i] if (near == i).any() else own
            cents.append(c)
            owner.append(j)
            radius.append(float(np.quantile(1 - members @ c, REJECT_QUANTILE)))
    return LanguageModel(langs, idf, np.array(cents, np.float32).reshape(-1, dims), np.array(owner, int), np.array(radius))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, from its whole text alone.

    Null texts and texts without letters: 'und', 0, rejected. Ties go to the language first by name. Repeated rows
    are repeated. The model is of fixed size (centroids times hashed dimensions).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        yield from emit(schema, ((i, *m.predict(t)) for i, t in rows(batches, "doc_id", "text")))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str, parts: int, part: int) -> "F.Column":
    """Whether crc32(id as text) mod parts is part; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    return predict(docs, model).withColumn("held_out", held_out("doc_id", 3, 1)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
