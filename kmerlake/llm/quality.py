"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import documents, emit, hashed_words, rows, uniform
from kmerlake.llm.langid import held_out

#: Bound on labelled rows that the fit gathers.
MAX_FIT_ROWS = 6000
WORD_SLOTS = 1 << 14
FACTORS = 6
CUTOFF = 0.3
_KINDS = np.zeros((256, 5), np.float64)  # upper case, lower case, digit, space, other ASCII
_KINDS[65:91, 0] = _KINDS[97:123, 1] = _KINDS[48:58, 2] = 1
_KINDS[[9, 10, 11, 12, 13, 32], 3] = 1
_KINDS[:128, 4] = 1 - _KINDS[:128, :4].sum(axis=1)
STATS = 14


def features(text: str | None, slots: int = WORD_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): log-scaled hashed word counts of unit length, then structure statistics and the length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / n
    words, start, end = hashed_words(raw.lower())
    at, count = np.unique((words % np.uint64(slots)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    value = value / (np.linalg.norm(value) or 1.0)
    lines = raw.split(b"\n")
    w = max(1, len(words))
    distinct = len(np.unique(words)) / w
    grams = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7) if len(words) > 2 else words
    length = end - start
    first = np.frombuffer(raw, np.uint8)[start] if len(start) else np.empty(0, np.uint8)
    stats = [
        *kinds,
        distinct,
        len(np.unique(grams)) / max(1, len(grams)),
        len(set(lines)) / len(lines),
        (length.mean() if len(length) else 0) / 10,
        (length.std() if len(length) else 0) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(n / len(lines)) / 10,
        ((first >= 65) & (first <= 90)).mean() if len(first) else 0.0,
        float((length <= 1).mean()) if len(length) else 0.0,
    ]
    return np.concatenate((at, slots + np.arange(STATS))), np.concatenate((value, stats))


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray  # (features,)
    factor: np.ndarray  # (features, k)
    mean: np.ndarray
    scale: np.ndarray
    slots: int

    def standard(self, value: np.ndarray) -> np.ndarray:
        out = value.copy()
        out[-STATS:] = np.clip((out[-STATS:] - self.mean) / self.scale, -4, 4)
        return out

    def score(self, text: str | None) -> float:
        """Probability of label 1. Pairwise terms in linear time: half of the squared sums less the summed squares, for each factor."""
        at, value = features(text, self.slots)
        x = self.standard(value)
        vx = self.factor[at] * x[:, None]
        z = self.bias + self.weight[at] @ x + 0.5 * float((vx.sum(axis=0) ** 2 - (vx * vx).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _learn(rows_: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, slots: int, factors: int, epochs: int = 12, rate: float = 0.08, decay: float = 2e-5, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the log loss, in mini-batches."""
    rng = np.random.default_rng(seed)
    stats = np.array([v[-STATS:] for _, v in rows_])
    m = FactorisationMachine(0.0, np.zeros(slots + STATS), rng.normal(0, 0.02, (slots + STATS, factors)), stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3), slots)
    x = [(at, m.standard(v)) for at, v in rows_]
    m.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    gw, gv, gb = np.full(slots + STATS, 1e-6), np.full((slots + STATS, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            cols = np.concatenate([x[i][0] for i in own])
            vals = np.concatenate([x[i][1] for i in own])
            first = np.concatenate(([0], np.cumsum([len(x[i][0]) for i in own])[:-1]))
            row = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(cols))))
            vx = m.factor[cols] * vals[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            z = m.bias + np.add.reduceat(m.weight[cols] * vals, first) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, first, axis=0)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            used, where = np.unique(cols, return_inverse=True)
            e = err[row] * vals
            dw = np.bincount(where, e, len(used)) + decay * m.weight[used]
            dv = np.stack([np.bincount(where, e * (sums[row, f] - vx[:, f]), len(used)) for f in range(factors)], axis=1) + decay * m.factor[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += err.sum() ** 2
            m.weight[used] -= rate * dw / np.sqrt(gw[used])
            m.factor[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            m.bias -= rate * err.sum() / np.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_FIT_ROWS, slots: int = WORD_SLOTS, factors: int = FACTORS) -> FactorisationMachine:
    """Fit on a hash sample of about max_rows labels at most, joined with their whole texts; both labels are sampled evenly where there are enough.

    Rows with a null label or id are left out; of several labels of an id the least counts. Without labelled rows
    every text scores 0.5. Sampling is undone in the bias, so that the score keeps the labels' odds. The sample is
    limited to 2 * max_rows rows before it is broadcast.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    size = {int(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, max_rows / 2 / max(1, size.get(k, 0))) for k in (0, 1)}
    sample = known.where(uniform(F.col("label_id"), F.lit("quality")) < F.when(F.col("y") > 0, share[1]).otherwise(share[0])).limit(2 * max_rows)
    chosen = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "label_id")
    schema = pa.schema([("y", pa.int32()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for text, y in rows(batches, "text", "y"):
                at, v = features(text, slots)
                yield int(y > 0), at.astype(np.int32), v.astype(np.float32)

        yield from emit(schema, found(), 500)

    got = chosen.select("text", "y").mapInArrow(work, "y int, at array<int>, v array<float>").limit(2 * max_rows).toArrow()
    if not got.num_rows:
        return FactorisationMachine(0.0, np.zeros(slots + STATS), np.zeros((slots + STATS, factors)), np.zeros(STATS), np.ones(STATS), slots)
    data = sorted(((int(y.as_py()), np.asarray(at.values), np.asarray(v.values, np.float64)) for y, at, v in zip(got.column("y"), got.column("at"), got.column("v"))), key=lambda r: (r[0], len(r[1]), r[2].sum()))
    m = _learn([r[1:] for r in data], np.array([r[0] for r in data], float), slots, factors)
    m.bias += float(np.log(share[0]) - np.log(share[1]))
    return m


def scores(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text alone. Null texts count as empty; empty texts are scored by their statistics. Repeated rows are repeated."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        yield from emit(schema, ((i, m.score(t)) for i, t in rows(batches, "doc_id", "text")))

    return base.mapInArrow(work, "doc_id long, score double")


def accepted(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is at least cutoff."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) >= cutoff for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def fit_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> FactorisationMachine:
    """The model of labels.quality from rows that are not held out."""
    return fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0)))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = scores(docs, fit_documents(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
