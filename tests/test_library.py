"""Sources, sampling, motifs, fitting and streaming against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import counts as kc
from kmerlake.operators import fit as ft
from kmerlake.operators import model as md
from kmerlake.operators import motifs as mo
from kmerlake.operators import peaks as pk
from kmerlake.operators import sampling as sm
from kmerlake.operators import seeding as sd
from kmerlake.operators import statistics as ss
from kmerlake.sources import reads as rd
from kmerlake.sources import tables as tb
from kmerlake.streaming import counts as stc

SEQS = ["ACGUACGUAC", "UUUUUUUUUU", "GCAUGCAUGC", "GGGGCCCCAA", "UUUUUUUUUU", "AUAUAUAUAU"]


def test_read_formats(spark, tmp_path):
    (tmp_path / "x_input.reads").write_text("\nacgtacgtac\nACGTNCGTAC\nACG\nACGTACGTACGG\n")
    got = rd.read_library(spark, str(tmp_path / "x_input.reads"), 0.0, length=10).orderBy("read_id").collect()
    assert [r["seq"] for r in got] == ["ACGUACGUAC"] * 2
    (tmp_path / "a.fa").write_text(">one\nACGT\n#note\nACGT\n>two x\nGGG\n")
    assert {(r["name"], r["seq"]) for r in rd.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("one", "ACGTACGT"), ("two x", "GGG")}
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGGTT\n+\n@III\n")
    assert ("r1", "ACGT") in {(r["name"], r["seq"]) for r in rd.fastq(spark, str(tmp_path / "a.fq")).collect()}


def test_first_valid_reads(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["ACGU", "NNNN", "acgt", "GGGG"])], "read_id long, seq string")
    assert [r["seq"] for r in rd.valid_reads(rows, most=2).collect()] == ["ACGU", "ACGU"]


def test_discovery(spark, tmp_path):
    for name in ("P_input.reads", "P_5.reads", "P_20nM.reads", "Q_input.reads", "notes.md"):
        (tmp_path / name).write_text("ACGT\n")
    got = rd.discover(spark, str(tmp_path)).collect()
    assert [(r["name"], r["conc"]) for r in got] == [("P", 0.0), ("P", 5.0), ("P", 20.0)]


def test_known_constants(spark, tmp_path):
    (tmp_path / "k.csv").write_text("# alias ABC DEF\n# comment\nABC\t1\tGCATG\t12.5\t1\t25\nDEF\t2\tGCNTG\t3\t1\t25\nDEF\t3\tUUU\t7\t2\t4\nshort\tline\n")
    got = {(r["protein"], r["seq"], r["kd"]) for r in tb.known_constants(spark, str(tmp_path / "k.csv")).collect()}
    assert got == {("DEF", "GCAUG", 12.5), ("DEF", "UUU", 7.0)}


def test_matrix_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(5.0, "AAA", 1.5, 0.1), (20.0, "AAA", 2.0, 0.5), (5.0, "AAC", 0.3, 0.1), (20.0, "AAC", 0.4, 0.1)], "conc double, kmer string, value double, err double")
    tb.write_kmer_matrix(rows, str(tmp_path / "m"))
    got = {(r["conc"], r["kmer"]): r["value"] for r in tb.read_kmer_matrix(spark, str(tmp_path / "m")).collect()}
    assert got == {(5.0, "AAA"): 1.5, (20.0, "AAA"): 2.0, (5.0, "AAC"): 0.3, (20.0, "AAC"): 0.4}


def test_motif_text_round_trip(spark, tmp_path):
    m = mo.Motif(np.array([[1, 0.2, 0.1, 0.5], [0.3, 1, 0.1, 0.1]]), 0.25, 2, 1, 0.5, "P")
    tb.write_motifs(spark, [m, m], str(tmp_path / "m"))
    got = tb.read_motifs(spark, str(tmp_path / "m"))
    assert len(got) == 2 and got[0].a0 == 0.25 and got[0].acc_shift == 1 and np.allclose(got[0].matrix, m.matrix)


def test_consensus_letters():
    assert [mo.consensus_letter(np.array(c)) for c in ([1, 0, 0, 0], [0, 0.5, 0, 0.5], [1, 0.4, 0.2, 0.2])] == ["A", "c", "a"]


def test_random_reads_repeat(spark):
    a = sm.random_reads(spark, 50, 20, 3).collect()
    assert a == sm.random_reads(spark, 50, 20, 3).collect() and all(set(r["seq"]) <= set("ACGU") and len(r["seq"]) == 20 for r in a)
    t = {"A": [0, 1, 0, 0], "C": [0, 0, 1, 0], "G": [0, 0, 0, 1], "U": [1, 0, 0, 0]}
    assert all(x in "ACGU" * 10 for x in (r["seq"] for r in sm.random_reads(spark, 10, 12, 1, t).collect()))


def test_counts_by_brute_force(spark):
    reads = rd.from_sequences(spark, SEQS)
    want: dict[str, int] = {}
    for s in SEQS:
        s = sq.ADAPTER_5[-2:] + s + sq.ADAPTER_3[:2]
        for i in range(len(s) - 2):
            want[s[i : i + 3]] = want.get(s[i : i + 3], 0) + 1
    assert {r["kmer"]: r["n"] for r in kc.kmer_counts(reads, 3).collect()} == want


def test_peaks():
    assert list(pk.peaks(np.array([0.1, 0.9, 0.8, 0.2, 0.7]), 1, 0.3)) == [(1, 0.9), (4, 0.7)]
    assert list(pk.peaks(np.array([]), 1, 0.3)) == []


def test_partial_affinity_by_brute_force(spark):
    m = mo.Motif(np.array([[1, 0.2, 0.1, 0.5], [0.3, 1, 0.1, 0.1], [0.2, 0.2, 1, 0.4]]), 0.5)
    d = m.discrimination
    missing = d * m.matrix.min(axis=1) + 1 - d

    def brute(s):
        total = 0.0
        for o in range(-len(s) + 2, m.width - 1):
            x = 1.0
            for i in range(m.width):
                x *= m.matrix[i, "ACGU".index(s[i - o])] if 0 <= i - o < len(s) else missing[i]
            total += x
        return total * m.a0

    seqs = ["AC", "ACG", "UUUUU", "GACGU"]
    got = {r["seq"]: r["affinity"] for r in mo.partial_affinities(spark.createDataFrame([(s,) for s in seqs], "seq string"), [m]).collect()}
    assert all(math.isclose(got[s], brute(s), rel_tol=1e-9) for s in seqs)


def test_gradient_against_differences(spark):
    reads = rd.from_sequences(spark, ["".join("ACGU"[(i * 7 + j * j) % 4] for j in range(12)) for i in range(30)]).persist()
    motif = mo.Motif(np.array([[0.9, 0.3, 0.2, 1.0], [0.4, 1.0, 0.2, 0.3]]), 0.1)
    model = ft.Model(reads, 2, np.ones((2, 16)), [5.0, 20.0])
    p = ft.Parameters([motif], np.array([0.05, 0.02]))
    free = np.array([4.0, 15.0])

    def error(x):
        q = ft.Parameters([mo.Motif(x[1:9].reshape(2, 4), x[0])], x[9:])
        return model.state(q, free).error

    g = model.gradient(model.state(p, free))
    x = p.vector()
    for i in (0, 1, 4, 6, 9, 10):
        h = np.zeros(len(x))
        h[i] = 1e-4 * max(x[i], 0.1)
        assert math.isclose(g[i], (error(x + h) - error(x - h)) / (2 * h[i]), rel_tol=1e-3, abs_tol=1e-9)


def test_descent_lowers_the_error(spark):
    reads = rd.from_sequences(spark, ["".join("ACGU"[(i * 5 + j * i + j * j) % 4] for j in range(14)) for i in range(40)]).persist()
    truth = mo.Motif(np.array([[0.1, 0.1, 0.1, 1.0], [0.1, 1.0, 0.1, 0.1]]), 0.2)
    blank = ft.Model(reads, 2, np.ones((1, 16)), [20.0])
    seen = blank.state(ft.Parameters([truth], np.array([0.01]))).r
    out = ft.descend(ft.Model(reads, 2, seen, [20.0]), ft.Parameters([mo.Motif(np.array([[0.5, 0.5, 0.5, 1.0], [0.5, 1.0, 0.5, 0.5]]), 0.1)], np.array([0.05])), steps=4)
    assert out.history[-1]["error"] < out.history[0]["error"]


def test_free_protein(spark):
    hist = md.AffinityHistogram(np.array([1.0]), np.array([10.0]))
    f = hist.free_protein(10.0, 5.0)
    assert math.isclose(f + 5 * f / (f + 1), 10.0, rel_tol=1e-9)
    assert md.AffinityHistogram(np.empty(0), np.empty(0)).free_protein(7.0, 5.0) == 7.0


def test_seeding_finds_two_families():
    kmers = [("UGCAUG", 9.0), ("GCAUGU", 8.0), ("AUGCAU", 7.0), ("CCCCCC", 5.0), ("CCCCCA", 4.0), ("ACCCCC", 3.0)]
    found = sd.seed_motifs(kmers, n_min=2)
    assert len(found) == 2 and found[0].width == found[1].width and found[0].a0 == 9.0 and "GCAU" in found[0].consensus.upper()
    assert sd.seed_motifs([]) == []


def test_p_values():
    assert math.isclose(ss.normal_p(1.959964), 0.05, abs_tol=1e-6)
    assert math.isclose(ss.t_p(2.228139, 10), 0.05, abs_tol=1e-5)
    assert math.isclose(ss.sign_test(9, 1), 22 / 1024)


def test_ridge(spark):
    rows = spark.createDataFrame([(float(i), float((i * 37) % 11), 3.0 * i - 2.0 * ((i * 37) % 11) + 1) for i in range(40)], "a double, b double, y double")
    got = ss.ridge(rows, ["a", "b"], "y", 0.5)
    x = np.array([[i, (i * 37) % 11] for i in range(40)], float)
    y = 3 * x[:, 0] - 2 * x[:, 1] + 1
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 0.5 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose([got["a"], got["b"]], want, rtol=2e-2) and got["r2"] > 0.99


def test_streamed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "P_input.reads").write_text("ACGTACGT\nTTTTTTTT\n")
    for n in range(2):
        (tmp_path / "in" / f"P_{5 * (n + 1)}.reads").write_text("GGGGGGGG\n")
        q = stc.start_counts(spark, str(tmp_path / "in"), str(tmp_path / "cp" / str(n)), f"counts{n}", 3)
        q.awaitTermination(120)
    got = {(r["conc"], r["kmer"]): r["n"] for r in spark.table("counts1").collect()}
    assert got[(5.0, "GGG")] == 6 and got[(10.0, "GGG")] == 6 and got[(0.0, "UUU")] == 7


def test_bootstrap_weights(spark):
    rows = spark.range(20000).select(F.col("id").alias("read_id"), F.lit(1.0).alias("conc"))
    got = sm.bootstrap(rows, 2).groupBy("replicate").agg(F.sum("copies").alias("n")).collect()
    assert all(abs(r["n"] - 20000) < 600 for r in got)


@pytest.mark.parametrize("seq,want", [("ACGU", "ACGU"), ("AACC", "GGUU"), ("", "")])
def test_reverse_complement(spark, seq, want):
    assert spark.createDataFrame([(seq,)], "s string").select(sq.reverse_complement("s")).first()[0] == want


def test_kmers_of_long_and_awkward_sequences(spark):
    long = "acgtN" * 20_000
    got = spark.createDataFrame([("ACGU",), ("AC",), ("",), (None,), ("A\nCG",)], "s string").select(sq.kmers("s", 3).alias("k")).collect()
    assert [r["k"] for r in got] == [["ACG", "CGU"], [], [], None, ["A\nC", "\nCG"]]
    got = {r["kmer"]: r["n"] for r in kc.valid_kmer_counts(spark.createDataFrame([(long,)], "seq string"), 3).collect()}
    assert got == {"ACG": 20_000, "CGU": 20_000}


def test_chunks_are_contiguous_and_whole(spark):
    df = spark.range(103).select((F.col("id") * 7 + 5).alias("read_id"))
    parts = [[r[0] for r in sm.chunk(df, i, 4).collect()] for i in range(4)]
    assert sorted(x for p in parts for x in p) == [i * 7 + 5 for i in range(103)] and all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
    assert sm.chunk(df.where("read_id < 0"), 0, 4).count() == 0
