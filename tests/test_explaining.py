"""Background fits, spliced sequences and the smaller operators against brute force."""

import math
import random

import numpy as np

from kmerlake.operators import background as bg
from kmerlake.operators import binning as bn
from kmerlake.operators import comparison as cp
from kmerlake.operators import counts as kc
from kmerlake.operators import motifs as mo
from kmerlake.operators import sampling as sm
from kmerlake.sources import genome as gn
from kmerlake.sources import reads as rd


def test_binding_fit_recovers_planted_parameters(spark):
    r = np.random.default_rng(1)
    rows = []
    for g, conc, beta, noise in (("a", 8.0, 0.03, 0.0), ("b", 0.4, 0.5, 0.0), ("c", 3.0, 0.1, 0.05)):
        z = np.exp(r.normal(-2, 1.5, 400))
        f0 = r.dirichlet(np.ones(400))
        p = conc * z / (conc * z + 1) + beta
        y = np.log2(p / (f0 * p).sum()) + noise * r.normal(size=400)
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(z, f0, y)]
    rows += [("a", None, 0.1, 0.0), ("a", 1.0, 0.0, 0.0), ("b", 1.0, 0.1, math.inf), ("d", 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, z double, f0 double, y double").persist()
    fits = bg.binding_fit(df, "z", "f0", "y", "g").persist()
    got = {x.g: x for x in fits.collect()}
    assert set(got) == {"a", "b", "c"} and all(x.n == 400 for x in got.values())
    for g, conc, beta, tol in (("a", 8.0, 0.03, 1e-5), ("b", 0.4, 0.5, 1e-4), ("c", 3.0, 0.1, 0.15)):
        assert abs(got[g].conc / conc - 1) < tol and abs(got[g].beta / beta - 1) < tol
    assert got["a"].error < 1e-12 and 0.001 < got["c"].error < 0.004
    # No nearby parameters do better, by differences.
    own = np.array([x[1:] for x in rows if x[0] == "c"], float)

    def error(c, b):
        p = c * own[:, 0] / (c * own[:, 0] + 1) + b
        return ((np.log2(p / ((own[:, 1] * p).sum() / own[:, 1].sum())) - own[:, 2]) ** 2).mean()

    c, b = got["c"].conc, got["c"].beta
    assert math.isclose(error(c, b), got["c"].error, rel_tol=1e-9)
    for h in (1e-3, -1e-3):
        assert error(c * (1 + h), b) >= error(c, b) and error(c, b * (1 + h)) >= error(c, b)
    whole = bg.predicted_log_ratio(df.where("g = 'a' and z is not null and f0 > 0"), "z", "f0", fits, "g").collect()
    assert max(abs(x.log_ratio - x.y) for x in whole) < 1e-5
    assert bg.binding_fit(df.limit(0), "z", "f0", "y", "g").count() == 0 and bg.binding_fit(df.where("g = 'b'"), "z", "f0", "y").first().n == 400


def test_models_are_compared_as_dense_ridge_fits(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 100, 3]
    y = x @ [1.0, -0.3, 4.0] + r.normal(size=300)
    g = ["ab"[i % 2] for i in range(300)]
    rows = [(k, *map(float, v), float(w), 1.0) for k, v, w in zip(g, x, y)] + [("a", None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, y double, same double")
    models = {"one": ["x0"], "all": ["x0", "x1", "x2"], "same": ["same"]}
    table, fits = bg.compared_models(df, models, "y", "g", alpha=7.0)
    got = {(t.g, t.model): t for t in table.collect()}
    assert len(got) == 6
    for k in "ab":
        at = np.array([v == k for v in g])
        for name, cols in (("one", [0]), ("all", [0, 1, 2])):
            own = x[at][:, cols]
            s = (own - own.mean(0)) / own.std(0)
            w = np.linalg.solve(s.T @ s + 7.0 * np.eye(len(cols)), s.T @ (y[at] - y[at].mean()))
            p = s @ w + y[at].mean()
            assert got[k, name].n == at.sum()
            np.testing.assert_allclose([got[k, name].r2, got[k, name].pearson], [1 - ((y[at] - p) ** 2).sum() / ((y[at] - y[at].mean()) ** 2).sum(), np.corrcoef(p, y[at])[0, 1]], rtol=1e-7)
            np.testing.assert_allclose(fits[k,][name].coefficients, w, rtol=1e-6)
        assert abs(got[k, "same"].r2) < 1e-12 and got[k, "same"].pearson is None
    left = bg.residuals(df.where("x0 is not null"), fits, "all", "y", "g").collect()
    assert len(left) == 300 and abs(sum(v.residual for v in left)) < 1e-6
    assert bg.compared_models(df.limit(0), models, "y", "g")[0].count() == 0


def test_spliced_sequences_over_tile_borders(spark, tmp_path):
    r = random.Random(3)
    genome = {c: "".join(r.choice("ACGTacgtN") for _ in range(n)) for c, n in (("chr1", 1000), ("chr2", 64), ("chrX", 257))}
    (tmp_path / "g.fa").write_text("".join(f">{c}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in genome.items()))
    lines, want = ["# comment", "track name=x", "browser y", "chr1\tx\t5"], []
    swap = str.maketrans("ACGTN", "TGCAN")
    for i in range(120):
        c = r.choice([*genome, "chr9"])
        n = len(genome.get(c, "x" * 100))
        start = r.randint(0, n - 1)
        strand = r.choice("+-.")
        if i % 3 == 0:
            sizes = [r.randint(1, 40) for _ in range(r.randint(1, 4))]
            offs = np.cumsum([0, *[s + r.randint(1, 90) for s in sizes[:-1]]]).tolist()
            end = start + offs[-1] + sizes[-1]
            lines.append("\t".join(map(str, [c, start, end, f"r{i}", 5, strand, start, end, 0, len(sizes), ",".join(map(str, sizes)) + ",", ",".join(map(str, offs)) + ","])))
            parts = [(start + o, s) for o, s in zip(offs, sizes)]
        else:
            end = start + r.randint(1, 200)
            lines.append("\t".join(map(str, [c, start, end, f"r{i}", 5, strand])))
            parts = [(start, end - start)]
        places = [p for a, s in parts for p in range(a, a + s)]
        seq = "".join(genome[c][p : p + 1] for p in places).upper() if c in genome else None
        seq = seq[::-1].translate(swap) if seq is not None and strand == "-" else seq
        want.append((f"r{i}", None if seq is None else seq.replace("T", "U"), places[::-1] if strand == "-" else places))
    lines.append("chr1\t3\t8")
    (tmp_path / "b.bed").write_text("\n".join(lines) + "\n")
    tiles = gn.genome_tiles(rd.fasta(spark, str(tmp_path / "g.fa")).withColumnRenamed("name", "chrom"), 32)
    records = gn.bed_records(spark, str(tmp_path / "b.bed"))
    got = gn.spliced(records, tiles, 32).collect()
    assert len(got) == 121
    found = {x.name: x for x in got}
    for name, seq, _ in want:
        assert found[name].seq == seq
    assert found[None].seq == genome["chr1"][3:8].upper().replace("T", "U")
    place = {x.name: x for x in gn.spliced(records, tiles, 32).select("name", gn.genomic_place(gn.F.lit(0)).alias("a"), gn.genomic_place(gn.F.lit(3)).alias("b")).collect()}
    for name, _, places in want:
        assert place[name].a == places[0] and place[name].b == (places[3] if len(places) > 3 else None)
    m = mo.Motif.of(np.random.default_rng(4).random((3, 4)))
    hits = {x.name: x for x in gn.best_hits(gn.spliced(records, tiles, 32).where("name is not null"), (lambda s: mo.site_weights(s, m), 3)).collect()}
    for name, seq, places in want:
        n = len(seq or "") - 2
        if n < 1:
            assert name not in hits
            continue
        z = [math.prod(m.matrix[d]["ACGU".index(x)] if x in "ACGU" else 0.0 for d, x in enumerate(seq[i : i + 3])) for i in range(n)]
        if len(places) != len(seq):  # cut at the chromosome's end
            continue
        i = z.index(max(z))
        assert math.isclose(hits[name].best, max(z), abs_tol=1e-12) and hits[name].start == min(places[i], places[i + 2]) and hits[name].end == max(places[i], places[i + 2]) + 1


def test_motif_scores_masks_and_forms(spark):
    m = np.random.default_rng(5).random((9, 4))
    cell = spark.createDataFrame([(i, p, nt, float(v[p, j])) for i, v in enumerate((m, m[:3])) for p in range(len(v)) for j, nt in enumerate("ACGU")], "motif_id int, pos int, nt string, aff double")
    got = {x.motif_id: x for x in mo.alignment_scores(cell, 4).collect()}
    top = m.max(axis=1)
    np.testing.assert_allclose([got[0].score, got[0].best_window, got[0].total, got[0].effective_width], [m.max(axis=0).mean(), max(top[i : i + 4].sum() for i in range(6)), top.sum(), (top / m.max()).sum()])
    assert got[1].best_window is None and math.isclose(got[1].total, top[:3].sum())
    rows = mo.masked_affinities(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.0)], "kmer string, affinity double"), 0.5).collect()
    assert {x.kmer: x.affinity for x in rows} == {"a": 1e-6, "b": 1e-6, "c": 9.0}
    assert [x.affinity for x in mo.masked_affinities(spark.createDataFrame([("a", 1.0)] * 2, "kmer string, affinity double"), 0.5).collect()] == [1.0, 1.0]
    motif = mo.Motif.of(m, 0.25)
    back = mo.parse_motifs(motif.legacy_text("AAAA", ["AAAC", "AAAA"]))
    assert len(back) == 1 and back[0].a0 == 0.25
    np.testing.assert_allclose(back[0].matrix, motif.matrix, rtol=1e-5)


def test_padding_of_equal_ends_starts_on_the_right():
    even = mo.Motif(np.array([[1.0, 0.5, 0.5, 0.5]]))
    assert [int(x[0] == 1 and x[1] == 0.5) for x in even.padded(2).matrix] == [1, 0]
    # A blank end is less discriminating, so the next one goes to the other side.
    assert [int(x[1] == 0.5) for x in even.padded(3).matrix] == [0, 1, 0] or [int(x[1] == 0.5) for x in even.padded(3).matrix] == [0, 0, 1]
    two = mo.Motif(np.array([[1.0, 0.2, 0.2, 0.2], [1.0, 0.5, 0.5, 0.5]]))
    assert [float(x[1]) for x in two.padded(3).matrix] == [1.0, 0.2, 0.5]
    same = mo.Motif(np.array([[1.0, 0.5, 0.5, 0.5], [1.0, 0.5, 0.5, 0.5]]))
    assert [float(x[1]) for x in same.padded(3).matrix] == [0.5, 0.5, 1.0]


def test_bound_histogram(spark):
    z = [1e-3, 2e-3, 0.5, 30.0, 1e-20, 0.0, 5e4]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    back = spark.createDataFrame([(12, 0.5), (3, 0.5)], "bin int, share double")
    got = {x.bin: x for x in bn.bound_histogram(df, "z", 10.0, 0.3, back).collect()}
    psi = np.zeros(18)
    for v in z:
        if v > 0 and -15 <= math.log10(v) < 3:
            psi[math.floor(math.log10(v) + 15)] += 10 * v / (10 * v + 1)
    psi /= psi.sum()
    share = psi.copy()
    share[[12, 3]] += 0.15
    np.testing.assert_allclose([[got[i].bound, got[i].share] for i in range(18)], np.stack([psi, share / share.sum()], axis=1), atol=1e-12)


def test_subsets_and_energies_of_best(spark):
    reads = spark.createDataFrame([(0.0, 1, "ACGUACG", [0.5, 1.0, 1.5, 2.0, 2.5]), (0.0, 2, "ACG", None), (5.0, 3, "GGG", [3.0]), (5.0, None, "GGG", [4.0])], "conc double, read_id long, seq string, e array<double>")
    assert [x.read_id for x in sm.subset(reads, spark.createDataFrame([(1,), (1,), (9,), (None,)], "read_id long")).collect()] == [1]
    got = {(x.kmer, x.rank, x.read_id, x.pos, x.e) for x in kc.energies_of_best(reads, ["GGG", "ACG"]).collect()}
    assert got == {("ACG", 2, 1, 0, 0.5), ("ACG", 2, 1, 4, 2.5), ("GGG", 1, 3, 0, 3.0), ("GGG", 1, None, 0, 4.0)}


def test_structure_effect(spark):
    r = np.random.default_rng(6)
    gc, a, b = r.random(30), r.random(30) + 0.1, r.random(30) + 0.1
    got = cp.structure_effect(spark.createDataFrame([*zip(a.tolist(), b.tolist(), gc.tolist()), (0.0, 1.0, 0.5)], "kd_plain double, kd_structure double, gc double")).first()
    np.testing.assert_allclose([got.slope, got.intercept], np.polyfit(gc, np.log2(b / a), 1))
    assert got.n == 30 and math.isclose(got.r2, np.corrcoef(gc, np.log2(b / a))[0, 1] ** 2)
