"""Position-specific affinity matrices (PSAMs): small driver-side objects, their text form and their tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.tokens import kmer_domain

# The nucleotides of each consensus code, in order of preference.
CONSENSUS = {
    "A": "A", "C": "C", "G": "G", "U": "U", "T": "U", "-": "", "N": "ACGU", "M": "AC", "R": "AG", "W": "AU",
    "S": "CG", "Y": "CU", "K": "GU", "V": "ACG", "H": "ACU", "D": "AGU", "B": "CGU",
}
LEAST = 1e-6


def consensus_letter(column: np.ndarray) -> str:
    """The code whose even distribution has the greatest overlap with the column; lower case below 0.9."""
    p = np.asarray(column, float)
    p = p / (np.abs(p).sum() or 1.0)
    best, letter = -1.0, "N"
    for code, letters in CONSENSUS.items():
        score = sum(p["ACGU".index(x)] for x in letters) / (len(letters) or 1)
        if score > best + 1e-12:
            best, letter = score, code
    return letter if best >= 0.9 else letter.lower()


@dataclass(frozen=True)
class Motif:
    """Relative affinities (positions x ACGU), each position's best at 1, and the affinity A0 = 1 / Kd of the best sequence."""

    matrix: np.ndarray
    a0: float = 1.0
    acc_k: int = 0
    acc_shift: int = 0
    acc_scale: float = 1.0
    name: str = ""
    extra: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, matrix, a0: float = 1.0, **kw) -> "Motif":
        """Raise each position by its distance from the greatest element, then divide by that."""
        m = np.asarray(matrix, float)
        top = m.max()
        return cls((m + (top - m.max(axis=1, keepdims=True))) / top, a0, **kw)

    @classmethod
    def from_kmer(cls, kmer: str, a0: float = 1.0, least: float = 0.0) -> "Motif":
        return cls(np.array([[1.0 if x == nt else least for nt in sq.NUCLEOTIDES] for x in kmer.upper().replace("T", "U")]), a0)

    @classmethod
    def from_variants(cls, affinities: dict[str, float], least: float = 1e-3) -> "Motif":
        """From the affinities of k-mers: the best one, and its single substitutions relative to it."""
        best = min(affinities, key=lambda x: (-affinities[x], x))
        m = np.full((len(best), 4), least)
        for i in range(len(best)):
            for j, nt in enumerate(sq.NUCLEOTIDES):
                m[i, j] = affinities.get(best[:i] + nt + best[i + 1 :], affinities[best] * least) / affinities[best]
        return cls(np.clip(m, LEAST, 1), affinities[best])

    @property
    def width(self) -> int:
        return len(self.matrix)

    @property
    def kd(self) -> float:
        return 1 / self.a0

    @property
    def consensus(self) -> str:
        return "".join(map(consensus_letter, self.matrix))

    @property
    def discrimination(self) -> np.ndarray:
        return (self.matrix.max(axis=1) / self.matrix.sum(axis=1) - 0.25) / 0.75

    @property
    def gc_fraction(self) -> float:
        return float(self.matrix[:, 1:3].sum() / self.matrix.sum())

    @property
    def information(self) -> np.ndarray:
        p = self.matrix / self.matrix.sum(axis=1, keepdims=True)
        return 2 + np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=1)

    def dinucleotide(self) -> np.ndarray:
        """(width - 1, 16) products of neighbouring positions."""
        return (self.matrix[:-1, :, None] * self.matrix[1:, None, :]).reshape(self.width - 1, 16)

    def shrunk(self, width: int) -> "Motif":
        """The window of most total discrimination."""
        d = np.convolve(self.discrimination, np.ones(width), "valid")
        i = int(d.argmax())
        return replace(self, matrix=self.matrix[i : i + width])

    def padded(self, width: int) -> "Motif":
        """Indifferent positions added on the side of the more discriminating end; where both are equal, every second one on the left."""
        m = self.matrix
        for i in range(width - self.width):
            d = (m.max(axis=1) / m.sum(axis=1) - 0.25) / 0.75
            left = d[0] > d[-1] or (d[0] == d[-1] and i % 2 == 1)
            m = np.vstack([np.ones(4), m] if left else [m, np.ones(4)])
        return replace(self, matrix=m)

    def legacy_text(self, seed: str = "", kmers: list[str] | None = None) -> str:
        """The older form: affinity and width in the head, a discrimination behind each row, and where the motif came from; parse_motifs() reads it."""
        rows = ["\t".join([*(f"{x:.6e}" for x in row), consensus_letter(row), str(d)]) for row, d in zip(self.matrix, self.discrimination)]
        tail = [f"seeded from '{seed}'"] if seed else []
        if kmers:
            tail.append(f"built from {len(kmers)} kmers '{','.join(sorted(kmers))}'")
        return "\n".join([f"PSAM A0={self.a0} n={self.width}", *rows, *tail])

    def text(self) -> str:
        extra = "".join(f" {k}={v}" for k, v in self.extra.items())
        head = f"PSAM {self.name} A0={self.a0} n={self.width} acc_k={self.acc_k} acc_shift={self.acc_shift} acc_scale={self.acc_scale}{extra}"
        rows = ["\t".join([*(f"{x:>10.5f}" for x in row), consensus_letter(row)]) for row in self.matrix]
        return "\n".join([head, "#\tA\tC\tG\tU\tconsensus", *rows])


def parse_motifs(text: str, most: int | None = None, by_affinity: bool = False) -> list[Motif]:
    """Motifs of a text file; elements that are not positive become 1e-6."""
    out: list[Motif] = []
    attrs: dict[str, float] = {}
    name, rows = "", []

    def close() -> None:
        if rows:
            m = np.array(rows, float)
            known = {"A0", "n", "acc_k", "acc_shift", "acc_scale"}
            out.append(Motif(np.where(m > 0, m, LEAST), attrs.get("A0", 1.0), int(attrs.get("acc_k", len(m))), int(attrs.get("acc_shift", 0)), attrs.get("acc_scale", 1.0), name, {k: v for k, v in attrs.items() if k not in known}))

    for line in text.splitlines():
        if line.startswith("PSAM"):
            close()
            rows, attrs = [], {}
            for word in line.split()[1:]:
                key, eq, value = word.partition("=")
                if eq:
                    attrs[key] = float(value)
                else:
                    name = key
        elif line.strip() and not line.startswith(("#", "seeded", "built")):
            rows.append([float(x) for x in line.split("\t")[:4]])
    close()
    if by_affinity:
        out.sort(key=lambda m: -m.a0)
    return out[:most] if most else out


def format_motifs(motifs: list[Motif], comment: str = "") -> str:
    return "\n\n".join([*([f"# {comment}"] if comment else []), *(m.text() for m in motifs)]) + "\n"


def to_tables(spark: SparkSession, motifs: list[Motif]) -> tuple[DataFrame, DataFrame]:
    """(psam, psam_cell)."""
    psam = spark.createDataFrame([(i, float(m.a0), m.width, m.acc_k, m.acc_shift, float(m.acc_scale)) for i, m in enumerate(motifs)], "motif_id int, a0 double, width int, acc_k int, acc_shift int, acc_scale double")
    cell = spark.createDataFrame([(i, p, nt, float(m.matrix[p, j])) for i, m in enumerate(motifs) for p in range(m.width) for j, nt in enumerate(sq.NUCLEOTIDES)], "motif_id int, pos int, nt string, aff double")
    return psam, cell


def cell_statistics(cell: DataFrame) -> DataFrame:
    """(motif_id, pos, discrimination, information, best) of a motif's cells."""
    total = F.sum("aff")
    by = cell.groupBy("motif_id", "pos").agg(((F.max("aff") / total - 0.25) / 0.75).alias("discrimination"), F.max_by("nt", "aff").alias("best"), total.alias("_t"))
    ic = cell.join(F.broadcast(by), ["motif_id", "pos"]).groupBy("motif_id", "pos").agg((2 + F.sum(F.when(F.col("aff") > 0, F.col("aff") / F.col("_t") * F.log2(F.col("aff") / F.col("_t"))).otherwise(0.0))).alias("information"))
    return by.join(ic, ["motif_id", "pos"]).select("motif_id", "pos", "discrimination", "information", "best")


def alignment_scores(cell: DataFrame, k: int = 8) -> DataFrame:
    """(motif_id, score, best_window, total, effective_width) of cell(motif_id, pos, nt, aff): mean of the letters' greatest values, greatest sum of k neighbouring positions' greatest values, their sum over all positions, and that sum over the greatest. best_window is null for a motif of fewer positions."""
    position = cell.groupBy("motif_id", "pos").agg(F.max("aff").alias("m"))
    w = Window.partitionBy("motif_id").orderBy("pos").rowsBetween(0, k - 1)
    position = position.withColumn("_s", F.when(F.count("*").over(w) == k, F.sum("m").over(w)))
    by_position = position.groupBy("motif_id").agg(F.max("_s").alias("best_window"), F.sum("m").alias("total"), (F.sum("m") / F.max("m")).alias("effective_width"))
    letters = cell.groupBy("motif_id", "nt").agg(F.max("aff").alias("m")).groupBy("motif_id").agg(F.avg("m").alias("score"))
    return letters.join(by_position, "motif_id").select("motif_id", "score", "best_window", "total", "effective_width")


def masked_affinities(affinity: DataFrame, cut: float, value: str = "affinity", floor: float = LEAST) -> DataFrame:
    """affinity with values whose deviate from the mean, in population deviations, is below the cut set to the floor; equal values are all kept."""
    s = affinity.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_d"))
    low = (F.col("_d") > 0) & ((F.col(value) - F.col("_m")) / F.col("_d") < cut)
    return affinity.crossJoin(F.broadcast(s)).withColumn(value, F.when(low, F.lit(floor)).otherwise(F.col(value))).drop("_m", "_d")  # one row


def site_weights(seq: Column, motif: Motif, acc: Column | None = None, offset: int = 0) -> Column:
    """Array with a value for each window: the product of the motif's cells, times the accessibility at the window's place plus offset (0 where there is none).

    A sequence shorter than the motif has no window; a letter other than ACGU counts 0.
    """
    cells = [F.array(*[F.lit(float(v)) for v in row]) for row in motif.matrix]

    def product(window: Column) -> Column:
        out = None
        for d, row in enumerate(cells):
            x = F.coalesce(F.get(row, F.instr(F.lit("ACGU"), F.substring(window, d + 1, 1)) - 1), F.lit(0.0))
            out = x if out is None else out * x
        return out

    windows = sq.kmers(seq, motif.width)
    if acc is None:
        return F.transform(windows, product)
    return sq.bound(acc, lambda own: F.transform(windows, lambda x, i: product(x) * F.coalesce(F.get(own, i + offset), F.lit(0.0))))


def kmer_affinities(spark: SparkSession, motif: Motif, floor: float = 0.0) -> DataFrame:
    """(kmer, affinity) of every k-mer of the motif's width."""
    z = site_weights(F.col("kmer"), motif)
    return kmer_domain(spark, motif.width).select("kmer", F.greatest(z[0] * motif.a0, F.lit(floor)).alias("affinity"))


def partial_affinities(sequences: DataFrame, motifs: list[Motif], min_overlap: int = 2) -> DataFrame:
    """(seq, affinity): sum over all offsets of at least min_overlap bases and over the motifs; positions beyond the sequence count d * min + (1 - d), d their discrimination."""
    return sequences.select("seq", sum((_overhanging(m, min_overlap) for m in motifs), F.lit(0.0)).alias("affinity"))


def _overhanging(m: Motif, min_overlap: int) -> Column:
    d, least, n = m.discrimination, m.matrix.min(axis=1), F.length("seq")
    missing = d * least + (1 - d)
    flat = F.array(*[F.lit(float(x)) for row in m.matrix for x in row])
    head = F.array(*[F.lit(float(x)) for x in np.cumprod([1.0, *missing])])
    tail = F.array(*[F.lit(float(x)) for x in np.cumprod([1.0, *missing[::-1]])[::-1]])

    def at_offset(o: Column) -> Column:
        start, end = F.greatest(F.lit(0), o), F.least(F.lit(m.width), o + n)

        def step(score: Column, i: Column) -> Column:
            nt = F.instr(F.lit("ACGU"), F.substring("seq", i - o + 1, F.lit(1)))
            return score * F.when(nt > 0, F.get(flat, i * 4 + nt - 1)).otherwise(1.0)

        return F.aggregate(F.sequence(start, end - 1), F.get(head, start) * F.get(tail, end), step)

    offsets = F.sequence(-n + min_overlap, F.lit(m.width - min_overlap))
    return F.aggregate(F.transform(offsets, at_offset), F.lit(0.0), lambda a, x: a + x) * m.a0


def gapless_score(seq: Column, motif: Motif, multiply: bool = False) -> Column:
    """Greatest score of the sequence over the offsets at which it lies wholly within the motif, positions outside counting their least."""
    flat = motif.matrix
    least = flat.min(axis=1)
    n = F.length(seq)
    cells = F.array(*[F.lit(float(x)) for row in flat for x in row])
    lows = [float(x) for x in (np.cumprod([1.0, *least]) if multiply else np.cumsum([0.0, *least]))]
    heads = F.array(*map(F.lit, lows))
    back = [float(x) for x in (np.cumprod([1.0, *least[::-1]]) if multiply else np.cumsum([0.0, *least[::-1]]))]
    tails = F.array(*map(F.lit, back))

    def score(o: Column) -> Column:
        start = F.get(heads, o) * F.get(tails, motif.width - o - n) if multiply else F.get(heads, o) + F.get(tails, motif.width - o - n)

        def step(s: Column, i: Column) -> Column:
            x = F.get(cells, (o + i) * 4 + F.instr(F.lit("ACGU"), F.substring(seq, i + 1, F.lit(1))) - 1)
            return s * x if multiply else s + x

        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)

    return F.when(n <= motif.width, F.array_max(F.transform(F.sequence(F.lit(0), motif.width - n), score)))
