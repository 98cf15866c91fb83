"""Operators that have no SQL of their own, and the smaller ones, against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import comparison as cp
from kmerlake.operators import footprint as fp
from kmerlake.operators import model as md
from kmerlake.operators import motifs as mo
from kmerlake.operators import sampling as sm
from kmerlake.sources import reads as rd
from kmerlake.sources import tables as tb

MOTIF = mo.Motif.of(np.random.default_rng(1).random((3, 4)), 0.3)


def product(window):
    return math.prod(MOTIF.matrix[d]["ACGU".index(c)] if c in "ACGU" else 0.0 for d, c in enumerate(window))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for c in (0.0, 0.0, 5.0, 20.0):
        for _ in range(15):
            seq = "".join(r.choice("ACGU") for _ in range(r.choice([8, 11])))
            out.append((c, len(out), seq, [r.random() for _ in range(len(seq) - r.choice([2, 4]))]))
    return [*out, (0.0, 900, "ACGNNACGU", [0.5] * 7), (5.0, 901, "AC", []), (5.0, 902, "ACGUACGU", None), (5.0, 903, None, [0.1]), (20.0, 904, "ACGUACGU", [0.5, None, 0.25, 0.5, 1.0, 1.0])]


@pytest.fixture(scope="module")
def reads(spark, rows):
    return spark.createDataFrame(rows, "conc double, read_id long, seq string, acc array<double>").repartition(5).persist()


def test_partition_function(reads, rows):
    other = mo.Motif.of(np.random.default_rng(2).random((2, 4)), 0.6)

    def z(m, seq):
        s = sq.ADAPTER_5[len(sq.ADAPTER_5) - m.width + 1 :] + seq + sq.ADAPTER_3[: m.width - 1]
        return sum(math.prod(m.matrix[d]["ACGU".index(c)] if c in "ACGU" else 0.0 for d, c in enumerate(s[i : i + m.width])) for i in range(len(s) - m.width + 1))

    got = {r.read_id: r.z for r in md.partition_function(reads, [MOTIF, other], clip=1.5).collect()}
    assert len(got) == len(rows)
    for _, i, seq, _ in rows:
        assert got[i] is None if seq is None else math.isclose(got[i], min(1.5, z(MOTIF, seq) + 2 * z(other, seq)), abs_tol=1e-12)


def brute_footprint(rows, pad, weigh):
    top, low = {}, {}
    for c, _, seq, acc in rows:
        w = weigh(seq, acc) if seq is not None and acc is not None else 0
        for i in range(len(seq or "") - 2):
            for rel in range(-pad, 3 + pad):
                if acc is not None and 0 <= i + rel < len(acc) and acc[i + rel] is not None:
                    top[c, rel] = top.get((c, rel), 0) + w * product(seq[i : i + 3]) * acc[i + rel]
                    low[c, rel] = low.get((c, rel), 0) + w * product(seq[i : i + 3])
    return {k: top[k] / low[k] for k in top if low[k] > 0}


def test_footprint(reads, rows):
    got = {(r.conc, r.rel): r.acc for r in fp.footprint(reads, MOTIF, pad=4).collect()}
    want = brute_footprint(rows, 4, lambda s, a: 1.0)
    assert set(got) == set(want)
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-9)
    got = {(r.conc, r.rel): r.acc for r in fp.footprint(reads, MOTIF, F.length("seq").cast("double"), 2).collect()}
    want = brute_footprint(rows, 2, lambda s, a: len(s))
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_footprint_calibration(reads, rows):
    seen = {}
    for (_, rel), v in brute_footprint([x for x in rows if x[0] != 0], 5, lambda s, a: 1.0).items():
        seen.setdefault(rel, []).append(v)
    got = {(r["shift"], r["scale"]): r["error"] for r in fp.calibrate(reads, MOTIF, range(-1, 2), 7.0, (0.0, 0.5, 1.0)).collect()}
    assert len(got) == 9
    for (shift, scale), error in got.items():

        def psi(s, a, shift=shift, scale=scale):
            y = 7.0 * MOTIF.a0 * sum(product(s[i : i + 3]) * ((a[i + shift] or 0.0) if 0 <= i + shift < len(a) else 0.0) ** scale for i in range(len(s) - 2))
            return y / (y + 1)

        own = brute_footprint([x for x in rows if x[0] == 0], 5, psi)
        assert math.isclose(error, sum((v - np.mean(seen[rel])) ** 2 for (_, rel), v in own.items() if rel in seen), rel_tol=1e-8)


@pytest.mark.parametrize("multiply", [False, True])
def test_gapless_score(spark, multiply):
    m = mo.Motif.of(np.random.default_rng(3).random((6, 4)))
    r = random.Random(5)
    seqs = ["".join(r.choice("ACGU") for _ in range(n)) for n in (1, 3, 4, 6, 7)]
    got = {x.s: x.v for x in spark.createDataFrame([(s,) for s in seqs], "s string").select("s", mo.gapless_score(F.col("s"), m, multiply).alias("v")).collect()}
    least = m.matrix.min(axis=1)
    for s in seqs:
        scores = []
        for o in range(6 - len(s) + 1):
            cells = [m.matrix[p]["ACGU".index(s[p - o])] if o <= p < o + len(s) else least[p] for p in range(6)]
            scores.append(math.prod(cells) if multiply else sum(cells))
        assert got[s] is None if not scores else math.isclose(got[s], max(scores), rel_tol=1e-12)


def test_ska_weights(spark):
    r = random.Random(6)
    rows = [(c, i, "".join(r.choice(p) for _ in range(9))) for c, p in ((0.0, "ACGU"), (5.0, "AACGU")) for i in range(40)]
    got = {x.kmer: x.weight for x in md.ska_weights(spark.createDataFrame(rows, "conc double, read_id long, seq string"), 2, 3).collect()}
    kmers = [a + b for a in "ACGU" for b in "ACGU"]
    n = dict.fromkeys(kmers, 10.0)
    for c, _, s in rows:
        s = sq.ADAPTER_5[-1:] + s + sq.ADAPTER_3[:1] if c == 0 else ""
        for i in range(len(s) - 1):
            n[s[i : i + 2]] += 1
    b = {k: v / sum(n.values()) * 16 for k, v in n.items()}
    w = dict.fromkeys(kmers, 1.0)
    for _ in range(3):
        add = dict.fromkeys(kmers, 0.0)
        for c, _, s in rows:
            if c:
                own = [s[i : i + 2] for i in range(8)]
                total = sum(w[k] / b[k] for k in own)
                for k in own:
                    add[k] += w[k] / b[k] / total
        w = {k: w[k] + add[k] for k in kmers}
        w = {k: v / sum(w.values()) * 16 for k, v in w.items()}
    assert all(math.isclose(got[k], w[k], rel_tol=1e-9) for k in kmers)


def test_reads_by_affinity(spark):
    z = [(i, 10 ** (-5 + 6 * i / 200)) for i in range(200)] + [(500, 0.0)]
    got = sm.by_affinity(spark.createDataFrame(z, "read_id long, z double"), "z", 4, bins=8).collect()
    step = 4 / 7
    want = {}
    for i, v in z:
        if v > 0:
            want.setdefault(max(0, min(7, math.floor((math.log10(v) + 4) / step) + 1)), []).append(i)
    assert {(r.bin, r.read_id) for r in got} == {(b, i) for b, own in want.items() for i in sorted(own)[:4]}


def test_accepted_reads_and_drawn_constants(spark):
    reads = spark.range(20_000).select(F.col("id").alias("read_id"), (F.col("id") % 2 * 1e9).alias("z"))
    n = {r.z: r.n for r in sm.bound_reads(reads, "z", 0.1).groupBy("z").agg(F.count("*").alias("n")).collect()}
    assert n[1e9] == 10_000 and abs(n[0.0] - 1000) < 150
    drawn = sm.lognormal_kds(spark.range(20_000).select(F.col("id").cast("string").alias("kmer")), -10.0, 1.5, 22.0).toPandas()
    assert abs(drawn.energy.mean() + 10) < 0.05 and abs(drawn.energy.std() - 1.5) < 0.05
    np.testing.assert_allclose(drawn.kd, np.exp(drawn.energy / ((22 + 273.15) * 8.314459848 / 4184)) * 1e9, rtol=1e-9)


def test_background_shares(spark):
    kind = "sample int, kmer string, "
    got = md.beta_estimates(spark.createDataFrame([(0, "A", 2.0), (0, "C", 6.0)], kind + "q double"), spark.createDataFrame([(0, "A", 0.5), (0, "C", 1.0)], kind + "r double"), spark.createDataFrame([("A", 0.4, 40.0), ("C", 0.6, 60.0)], "kmer string, f double, n0 double")).collect()
    assert [(r.kmer, round(r.beta, 12)) for r in got] == [("A", round((0.5 * 0.4 * 8 - 2) / (40 * 0.5), 12))]
    bound, free = md.concentrations(30.0, 50.0, 100, 40, 6)
    assert math.isclose(bound, 30 * 1000 / (100 * 45)) and math.isclose(free, 20 * 1000 / (100 * 45))
    b, g = np.array([1.0, 2.0, 3.0]), np.array([3.0, 2.0, 1.0])
    assert math.isclose(cp.background_share(b, g, (b + 0.4 * g) * 7), 0.4, rel_tol=0.02)


def test_runs_and_their_histories(spark):
    kind = "run string, t long, error double"
    out = cp.joined_histories(spark.createDataFrame([("a", 0, 3.0), ("a", 1, 2.0), ("b", 0, 9.0)], kind), spark.createDataFrame([("a", 0, 1.0), ("c", 0, 5.0)], kind)).collect()
    assert sorted((r.run, r.t, r.error) for r in out) == [("a", 0, 3.0), ("a", 1, 2.0), ("a", 2, 1.0), ("b", 0, 9.0), ("c", 0, 5.0)]
    rows = cp.labelled_runs(x=spark.createDataFrame([(1,)], "v int"), y=spark.createDataFrame([(2, 3)], "v int, w int")).collect()
    assert sorted((r.run, r.v, r.w) for r in rows) == [("x", 1, None), ("y", 2, 3)]
    (r,) = cp.constant_ranges(spark.createDataFrame([("a", 0, 2.0, 4.0)], "run string, idx int, q25 double, q75 double")).collect()
    assert (r.kd_low, r.kd_high) == (0.25, 0.5)
    got = cp.constants_agreement(spark.createDataFrame([("P", "A", 1.0), ("P", "C", 10.0), ("P", "G", 100.0), ("P", "U", 0.0)], "protein string, seq string, kd double"), spark.createDataFrame([("A", 5.0), ("C", 0.5), ("G", 0.05), ("U", 1.0)], "seq string, affinity double")).first()
    assert math.isclose(got.pearson, 1.0) and math.isclose(got.spearman, 1.0) and got.n == 3


def test_energies_that_are_there_and_those_that_are_not(spark):
    reads = spark.createDataFrame([(0.0, 1), (0.0, 2), (5.0, 1)], "conc double, read_id long")
    energies = spark.createDataFrame([(0.0, 1, 3, [1.0]), (0.0, 1, 4, [2.0]), (0.0, 2, 3, [3.0])], "conc double, read_id long, k int, e array<double>")
    got = {(r.conc, r.read_id): (r.e, r.missing) for r in fp.joined_energies(reads, energies.where("k = 3").drop("k"), 2).collect()}
    assert got == {(0.0, 1): ([1.0], False), (0.0, 2): ([3.0], False), (5.0, 1): ([0.0, 0.0], True)}
    assert [(r.conc, r.records) for r in fp.complete_records(energies).collect()] == [(0.0, 1)]
    assert [(r.conc, r.read_id) for r in fp.unfolded(reads, energies).collect()] == [(5.0, 1)]


def test_files_of_reads_and_tables(spark, tmp_path):
    reads = spark.createDataFrame([(0.0, 1, "ACGUA"), (0.0, 2, "ACGGG"), (5.0, 3, "GGGUA"), (5.0, 4, "AAAAA")], "conc double, read_id long, seq string")
    rd.write_sequences(reads, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == sorted(["ACGUA", "ACGGG", "GGGUA", "AAAAA"])
    got = {(r.kmer, r.ordinal): r.record for r in rd.pure_read_records(reads, ["ACG", "GGG"], 5).collect()}
    assert got == {("ACG", 1): ">ACG r=1 n=1\nACGUA", ("GGG", 1): ">GGG r=3 n=1\nGGGUA"}
    (tmp_path / "k.txt").write_text("acgt\n\n uuu \n")
    assert [r.kmer for r in tb.kmer_list(spark, str(tmp_path / "k.txt")).collect()] == ["ACGU", "UUU"]
    values = spark.createDataFrame([("UU", 1.5, 1), ("AA", 2.5, 2)], "kmer string, r double, x int")
    tb.to_json(values, str(tmp_path / "j"), "x")
    assert sorted(json.loads(r.value)["r"] for r in spark.read.text(str(tmp_path / "j")).collect()) == [1.5, 2.5]
    tb.write_kmer_values(values, str(tmp_path / "v"), "r")
    (part,) = (tmp_path / "v").glob("part-*")
    assert part.read_text() == "kmer\tr\nAA\t2.5\nUU\t1.5\n"
    for t in (1, 2):
        tb.append_rows(spark.createDataFrame([("a", t)], "run string, t int"), str(tmp_path / "h"), "run")
    assert sorted((r.run, r.t) for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [("a", 1), ("a", 2)]
    made = []
    for _ in range(2):
        assert tb.cached_table(spark, str(tmp_path / "c"), lambda: made.append(1) or values).count() == 2
    assert len(made) == 1
    assert [r.ref for r in tb.reference_counts(spark.createDataFrame([("a", 5), ("a", 50), ("b", 50)], "ref string, pos int"), 0, 10).collect()] == ["a"]
    kept = tb.oligo_counts(spark.createDataFrame([("a", 500), ("b", 500), ("c", 5)], "id string, n_input int"), spark.createDataFrame([("b",)], "query string")).collect()
    assert [r.id for r in kept] == ["a"]
    wide = spark.createDataFrame([("AA", "1.5", "CC", None), (None, None, "GG", "2")], "P_kmer string, P_value string, Q_kmer string, Q_value string")
    assert sorted((r.protein, r.kmer, r.value) for r in tb.unpivoted_motifs(wide, ["P", "Q"]).where("value is not null").collect()) == [("P", "AA", 1.5), ("Q", "GG", 2.0)]
    best = tb.significant_in_best(spark.createDataFrame([("P", 5.0, f"k{i}", 1.0) for i in range(30)] + [("P", 5.0, "top", 9.0), ("P", 20.0, "other", 2.0)], "protein string, conc double, kmer string, r double")).collect()
    assert [r.kmer for r in best] == ["top"]
    grid = spark.createDataFrame([("a", 0, 0.5, 3.0), ("a", 1, 1.0, 2.0)], "run string, shift int, scale double, error double")
    assert tuple(tb.best_footprint(grid).first()) == ("a", 1, 1.0, 2.0)
