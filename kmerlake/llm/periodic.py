"""Periodic runs of words: texts that repeat a stretch of words at once, four times or more.

The word numbers of a text are stored as bit planes in big integers. For a lag q, each plane is XORed with itself
shifted by q and the results are ORed: zeros are words equal to the word q further on. Shift-doubling AND keeps the
starts of zero stretches that are long enough.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm.common import documents, plain_names

#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Least words of a run, and least repeats of its period.
LEAST, REPEATS = 6, 4
#: Pairs next to a place that are compared before its lag is looked at whole.
CLOSE = 24
#: Texts of up to so many words find their places by one table.
TABLE = 1 << 15
#: Bytes of texts after which a task hands on what it has.
HELD = 1 << 23
_WHITE = b" \t\n\v\f\r"


def word_numbers(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, by first occurrence, and the distinct words. Words are runs without ASCII white space."""
    known: dict[bytes, int] = {}
    numbers = array("i")
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in _WHITE:  # to the end of a word
            step = min((p for p in (raw.find(w, end, end + PIECE) for w in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r")) if p >= 0), default=min(len(raw), end + PIECE))
            end = step
        words = raw[at:end].split()
        for w in set(words).difference(known):
            known[w] = len(known)
        numbers.extend(map(known.__getitem__, words))
        at = end
    return np.frombuffer(numbers, np.int32) if numbers else np.empty(0, np.int32), list(known)


def bit_planes(numbers: np.ndarray) -> list[int]:
    """Plane b has bit i set where bit b of word i's number is."""
    if not len(numbers):
        return []
    return [int.from_bytes(np.packbits((numbers >> b) & 1 == 1, bitorder="little").tobytes(), "little") for b in range(int(numbers.max()).bit_length())]


def long_zeros(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(first, length) of maximal stretches of `least` or more words that equal the word `lag` further on."""
    differ = 0
    for p in planes:
        differ |= p ^ (p >> lag)
    size = n - lag
    keep = ~differ & ((1 << size) - 1)
    have = 1
    while have < least and keep:  # a bit stays if `have` words from it on are equal
        step = min(have, least - have)
        keep &= keep >> step
        have += step
    if not keep:
        return []
    bits = np.unpackbits(np.frombuffer(keep.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")
    edge = np.diff(np.concatenate(([0], bits, [0])).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return list(zip(first.tolist(), (end - first + least - 1).tolist()))


class _Found:
    """Runs found so far, with their starts and furthest ends by period."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.planes: list[int] | None = None
        self.runs: list[tuple[int, int, int]] = []
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, lags: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places from which three pairs in steps of their lag are equal, those that may lie in a run not found yet."""
        numbers = self.numbers
        for p, (starts, ends) in self.by.items():
            at = np.searchsorted(starts, anchors, "right") - 1
            keep = (lags % p != 0) | (at < 0) | (ends[at] <= anchors + 3 * lags)
            lags, anchors = lags[keep], anchors[keep]
        for t in range(1, CLOSE + 1):  # all pairs up to two lags on lie in the run too
            keep = (t > 2 * lags) | (numbers[np.minimum(anchors + t, len(numbers) - 1)] == numbers[np.minimum(anchors + t + lags, len(numbers) - 1)])
            lags, anchors = lags[keep], anchors[keep]
            if not len(lags):
                return lags, anchors
        return lags, anchors

    def add(self, lag: int, least: int, repeats: int) -> None:
        if self.planes is None:
            self.planes = bit_planes(self.numbers)
        known = {(s, length) for s, length, p in self.runs if lag % p == 0}
        zeros = long_zeros(self.planes, len(self.numbers), lag, max(least - lag, (repeats - 1) * lag))
        new = [(s, z + lag, lag) for s, z in zeros if (s, z + lag) not in known]
        if new:
            self.runs += new
            self.by[lag] = np.array([s for s, _, _ in new]), np.maximum.accumulate([s + length for s, length, _ in new])


_TABLE: list[np.ndarray] = []


def _places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lags and their multiples at which three pairs in steps of the lag are equal, of a text of up to TABLE words."""
    if not _TABLE:  # all lags and multiples in the order of the last word that they compare
        lag = np.concatenate([np.full((TABLE - 1) // q - 2, q, np.int32) for q in range(1, (TABLE - 1) // 3 + 1)])
        place = np.concatenate([np.arange((TABLE - 1) // q - 2, dtype=np.int32) * q for q in range(1, (TABLE - 1) // 3 + 1)])
        last = place + 3 * lag
        order = np.argsort(last, kind="stable")
        _TABLE.extend((lag[order], place[order], np.cumsum(np.bincount(last, minlength=TABLE))))
    size = _TABLE[2][len(numbers) - 1] if len(numbers) else 0
    lags, anchors = _TABLE[0][:size], _TABLE[1][:size]
    for step in range(3):
        at = anchors + step * lags
        keep = np.flatnonzero(numbers[at] == numbers[at + lags])
        lags, anchors = lags[keep], anchors[keep]
    return lags, anchors


def _places_of_many(found: _Found, repeats: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of a longer text: runs of short lags are found at once, a lag at a time; places of long lags are returned, found a multiple at a time over all lags and held against those runs."""
    numbers, n = found.numbers, len(found.numbers)
    low = int(n**0.5) + 1
    for q in range(1, low):
        step = numbers[::q]
        same = step[1:] == step[:-1]
        places = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        if len(places) and len(found.open(np.full(len(places), q), places)[0]):
            found.add(q, least, repeats)
    lags, anchors = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for j in range(n // low + 1):
        high = min(n // repeats, (n - 1) // (j + 3))
        if high < low:
            break
        at = [numbers[m * low : m * high + 1 : m] if m else numbers[:1] for m in range(j, j + 4)]
        q = low + np.flatnonzero((at[0] == at[1]) & (at[1] == at[2]) & (at[2] == at[3]))
        q, where = found.open(q, j * q)
        lags.append(q)
        anchors.append(where)
    return np.concatenate(lags), np.concatenate(anchors)


def runs_of(numbers: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    A run of period q has at least `repeats` x q words, three periods of equal pairs or more, and so holds a multiple
    of q at which three pairs in steps of q are equal. Such places are found by n/q comparisons a lag; lags without one
    have no run and are passed over. So are places inside a run whose period divides q, as a run of smallest period q cannot share more than q
    words and that period with it.
    """
    if repeats < 4:
        raise ValueError("lags are passed over by a rule that holds from four repeats on")
    n = len(numbers)
    found = _Found(numbers)
    lags, anchors = _places(numbers) if n <= TABLE else _places_of_many(found, repeats, least)
    order = np.argsort(lags, kind="stable")
    lags, anchors = lags[order], anchors[order]
    values, first = np.unique(lags, return_index=True)
    for q, a, b in zip(values.tolist(), first, [*first[1:], len(lags)]):
        if len(found.open(lags[a:b], anchors[a:b])[0]):
            found.add(q, least, repeats)
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def collapsed(numbers: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    depth = np.zeros(len(numbers) + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(map(words.__getitem__, numbers[np.cumsum(depth[:-1]) == 0].tolist()))


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """docs with the runs of each whole text, by start, then period, and the text without repeats; columns of those names are replaced.

    A run is a maximal stretch of words with smallest period q that has at least max(6, 4 q) words. Runs may overlap;
    a word goes if any run holds it after that run's first q words. Null texts, empty ones and white space alone have no
    runs and collapse to the empty text. Repeated rows are repeated, other columns stay under any names, an empty
    table stays empty. Words are compared as bytes; a very long text takes memory for its distinct words, a number for
    each word and its planes. Nothing is shuffled.
    """
    inner, named = plain_names(docs)
    lost = {runs_col.lower(), collapsed_col.lower()}
    kept = [c for old, c in zip(docs.columns, inner.columns) if old.lower() not in lost]
    table = inner.select(*kept, F.col(named[text_col]).cast("string").cast("binary").alias("t"))
    number = pa.int64()
    kind = pa.list_(pa.struct([("start", number), ("length", number), ("period", number)]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, rest, at, held = batch.column(len(kept)), [], [], 0, 0
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                numbers, words = word_numbers(raw)
                found = runs_of(numbers)
                runs.append([dict(start=s, length=n, period=p) for s, n, p in found])
                rest.append(collapsed(numbers, words, found))
                held += len(raw)
                if held >= HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(runs)).columns[: len(kept)], pa.array(runs, kind), pa.array(rest, pa.binary())], names=[*kept, "runs", "rest"])
                    runs, rest, at, held = [], [], i + 1, 0

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*kept).schema), f"runs {RUNS}", "rest binary"])
    out = table.mapInArrow(work, schema)
    back = [F.col(c).alias(old) for old, c in zip(docs.columns, inner.columns) if c in kept]
    return out.select(*back, F.col("runs").alias(runs_col), F.col("rest").cast("string").alias(collapsed_col))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents in which each tenth, by the hash of its id, ends in repeats of its own words. A null id has no hash and plants none."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    table = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    table = table.select("doc_id", "text", "g", "w", F.size("w").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    table = table.select("*", period.alias("p"))
    # Copies of the whole period and one part of it, rather than a function of each word.
    tail = F.col("n") - F.col("a")
    cycle = F.slice("w", F.col("a") + 1, F.col("p"))
    copies = F.flatten(F.array_repeat(cycle, F.ceil(tail / F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), tail)), " ")
    return table.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every whole document with its planted runs; start to exponent_milli describe the longest run."""
    out = periodic_runs(with_planted_runs(documents(spark, sf_dir)).select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select("doc_id", "runs", "collapsed", best.alias("b")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.s")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.p")).alias("period"),
        F.floor(1000 * F.col("b.length") / -F.col("b.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
