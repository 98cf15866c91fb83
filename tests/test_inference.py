"""Model operators against enumeration, dense solvers, finite differences and planted data."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import cooperative as co
from kmerlake.operators import fit as ft
from kmerlake.operators import metrics as mt
from kmerlake.operators import overlap as ov
from kmerlake.operators import resampling as rs
from kmerlake.operators.motifs import Motif
from kmerlake.operators.sampling import replicate_uniform


def placements(weights, widths, length, coop, reach):
    """(weight, sites) of every placement of sites that do not overlap."""

    def after(i, last, value, held):
        if i >= length:
            yield value, held
            return
        yield from after(i + 1, last, value, held)
        for a, w in enumerate(widths):
            if i + w <= length:
                x = weights[a][i]
                if last is not None and i - last[1] <= reach:
                    x *= coop[last[0], a]
                yield from after(i + w, (a, i + w), value * x, [*held, (a, i)])

    yield from after(0, None, 1.0, [])


@pytest.mark.parametrize("reach", [0, 1, 3])
def test_transfer_matrix_equals_enumeration(spark, reach):
    r = np.random.default_rng(reach)
    motifs = [Motif.of(r.random((3, 4)), 0.4), Motif.of(r.random((2, 4)), 1.5), Motif.of(r.random((4, 4)), 3.0)]
    coop = np.array([[5.0, 0.2, 1.0], [3.0, 1.0, 0.0], [0.5, 20.0, 1.0]])
    binding = co.Binding(motifs, [2.0, 0.5, 1.0], coop, reach)
    seqs = ["".join(r.choice(list("ACGU"), n)) for n in (0, 1, 2, 5, 9, 12, 12, 12)] + ["ACGNUACGU", None, "ACGUACGUAC", "ACGUACGUAC"]
    reads = spark.createDataFrame([(1.0, i, s, "x") for i, s in enumerate(seqs)], "conc double, read_id long, seq string, log_z_ string")
    got = co.cooperative_binding(reads, binding, pad=False, profile=True).collect()
    assert len(got) == len(seqs)
    for row in got:
        seq = row.seq or ""
        weights = [[c * m.a0 * math.prod(m.matrix[d]["ACGU".index(x)] if x in "ACGU" else 0.0 for d, x in enumerate(seq[i : i + m.width])) for i in range(len(seq) - m.width + 1)] for m, c in zip(motifs, binding.free)]
        every = list(placements(weights, [3, 2, 4], len(seq), coop, reach))
        z = sum(v for v, _ in every)
        np.testing.assert_allclose([row.log_z, row.p_bound], [math.log(z), 1 - 1 / z], atol=1e-12)
        for a, w in enumerate((3, 2, 4)):
            np.testing.assert_allclose(row.n_bound[a], sum(v * sum(b == a for b, _ in held) for v, held in every) / z, atol=1e-12)
            bases = [sum(v for v, held in every if any(b == a and s <= i < s + w for b, s in held)) / z for i in range(len(seq))]
            np.testing.assert_allclose(row.occupancy[a], bases, atol=1e-12)


def test_transfer_matrix_of_strong_sites_on_long_reads_stays_finite(spark):
    binding = co.Binding([Motif.from_kmer("AA", 1e12)], [1e6])
    row = co.cooperative_binding(spark.createDataFrame([(1, "A" * 400)], "read_id long, seq string"), binding, pad=False).first()
    assert abs(row.log_z - (200 * math.log(1e18))) < 1e-6 and row.p_bound == 1.0 and abs(row.n_bound[0] - 200) < 1e-6


def test_accessibility_and_adapters_weigh_sites(spark):
    m = Motif.of(np.random.default_rng(4).random((3, 4)), 0.7)
    seq = "ACGUACGUUA"
    full = sq.ADAPTER_5[-2:] + seq + sq.ADAPTER_3[:2]
    acc = [0.1 * i for i in range(11)]
    row = co.cooperative_binding(spark.createDataFrame([(seq, acc)], "seq string, acc array<double>"), co.Binding([m], [1.0]), acc="acc").first()
    x = [[m.a0 * math.prod(m.matrix[d]["ACGU".index(c)] for d, c in enumerate(full[i : i + 3])) * (acc[i] if i < 11 else 0) for i in range(12)]]
    assert abs(math.log(sum(v for v, _ in placements(x, [3], 14, np.ones((1, 1)), 0))) - row.log_z) < 1e-12


def test_approximation_is_exact_for_a_single_site(spark):
    m = Motif.from_kmer("GGG", 0.25)
    rows = {r.seq: r for r in co.approximation_error(spark.createDataFrame([("AAGGGAA",), ("GGGAGGG",), ("AAAAAA",), (None,)], "seq string"), m, pad=False).collect()}
    assert rows["AAGGGAA"].rmse < 1e-12 and abs(rows["AAGGGAA"].kd - 4) < 1e-9 and abs(rows["AAGGGAA"].p_at_kd - 0.5) < 1e-12
    assert abs(rows["GGGAGGG"].p_at_kd - (1 - 1 / 2.25)) < 1e-12 and rows["GGGAGGG"].rmse > 0.01
    assert rows["AAAAAA"].rmse is None and rows[None].kd is None


# occupancies behind enrichments


def nnls(a, b):
    """Non-negative least squares by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    w = a.T @ (b - a @ x)
    while not free.all() and (w[~free] > 1e-11).any():
        free[np.flatnonzero(~free)[w[~free].argmax()]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 0).all():
                break
            bad = free & (s <= 0)
            step = (x[bad] / (x[bad] - s[bad])).min()
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
        x = s
        w = a.T @ (b - a @ x)
    return x


def shifted(k, length, letters):
    """The overlap matrix, entry by entry."""
    kmers = ["".join(t) for t in itertools.product("ACGU", repeat=k)]
    at = {x: i for i, x in enumerate(kmers)}
    m = np.eye(4**k)
    for i, kmer in enumerate(kmers):
        for x in range(1, k):
            w = (length - k + 1 - 2 * x) / (length - k + 1)
            for j, new in enumerate("".join(t) for t in itertools.product("ACGU", repeat=x)):
                m[i, at[kmer[x:] + new]] += w * letters[x - 1][j]
                m[i, at[new + kmer[: k - x]]] += w * letters[x - 1][j]
    return m


def test_overlaps_and_occupancies_equal_the_dense_matrix():
    r = np.random.default_rng(0)
    for k in (2, 3, 4):
        letters = [r.dirichlet(np.full(4**x, 3.0)) for x in range(1, k)]
        m = ov.Overlap(k, 40, letters)
        dense = shifted(k, 40, letters)
        np.testing.assert_allclose(m.dense(), dense, atol=1e-12)
        v = r.random(4**k)
        np.testing.assert_allclose(m.transposed(v), dense.T @ v, atol=1e-12)
        for seen in (np.exp(r.normal(size=4**k)), dense @ np.maximum(r.normal(size=4**k), 0), np.ones(4**k), np.zeros(4**k)):
            want = nnls(dense, seen)
            got = m.fitted(seen)
            assert got.min() >= 0 and abs(np.linalg.norm(dense @ got - seen) - np.linalg.norm(dense @ want - seen)) < 1e-6
            np.testing.assert_allclose(got, want, atol=1e-4)


def test_occupancies_run_at_eight_letters():
    r = np.random.default_rng(1)
    m = ov.Overlap(8, 40, [np.full(4**x, 0.25**x) for x in range(1, 8)])
    o = np.zeros(4**8)
    o[r.integers(0, 4**8, 30)] = r.random(30) * 20
    got = m.fitted(m.times(o), 1e-7)
    assert np.linalg.norm(m.times(got) - m.times(o)) < 1e-3 * np.linalg.norm(m.times(o))


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(2)
    rows = [(float(c), i, "".join(r.choice("AACGU" if c == 0 else "ACGUU") for _ in range(20))) for c in (0, 5, 20) for i in range(150)]
    return spark.createDataFrame([*rows, rows[-1]], "conc double, read_id long, seq string").persist()


def poisson(u):
    p = total = math.exp(-1)
    for n in range(8):
        if u < total:
            return n
        p /= n + 1
        total += p
    return 8


def draw(read_id, i):
    v = (read_id * 1103515245 + 12345 + 610839777 * i) % 2**31
    return poisson((v * v // 2**16) % 2**31 / 2**31)


def test_replicates_differ(spark):
    u = spark.range(1, 4001).select(*[replicate_uniform("id", i).alias(f"u{i}") for i in range(10)]).toPandas().to_numpy()
    assert np.abs(np.corrcoef(u.T) - np.eye(10)).max() < 0.07 and abs(u.mean() - 0.5) < 0.01 and u.min() >= 0 and u.max() < 1


def test_bootstrap_errors_equal_replicates_drawn_one_by_one(spark, library):
    rows = library.collect()
    k, times = 2, 6
    kmers = ["".join(t) for t in itertools.product("ACGU", repeat=k)]

    def count(conc, weigh, distinct=False):
        n = dict.fromkeys(kmers, 0)
        for row in rows:
            if row.conc == conc:
                s = sq.ADAPTER_5[-1:] + row.seq + sq.ADAPTER_3[:1]
                found = [s[i : i + k] for i in range(len(s) - 1)]
                for x in set(found) if distinct else found:
                    n[x] += weigh(row.read_id)
        return np.array([n[x] for x in kmers], float)

    def share(n):
        return (n + 10) / (n + 10).sum()

    got = {(r.conc, r.kmer): (r.r, r.err) for r in rs.r_values_with_error(library, k, times).collect()}
    for conc in (5.0, 20.0):
        base = share(count(0.0, lambda i: 1))
        want = share(count(conc, lambda i: 1)) / base
        err = np.std([share(count(conc, lambda i, b=b: draw(i, b))) / base for b in range(times)], axis=0)
        np.testing.assert_allclose([got[conc, x] for x in kmers], np.stack([want, err], axis=1), rtol=1e-9)
    got = {(r.conc, r.kmer): (r.fraction, r.err) for r in rs.explained_with_error(library, k, times).collect()}
    for conc in (0.0, 20.0):
        n = sum(r.conc == conc for r in rows)
        want = (count(conc, lambda i: 1, True) + 10) / (n + 10)
        drawn = [(count(conc, lambda i, b=b: draw(i, b), True) + 10) / (sum(draw(r.read_id, b) for r in rows if r.conc == conc) + 10) for b in range(times)]
        np.testing.assert_allclose([got[conc, x] for x in kmers], np.stack([want, np.sqrt(np.mean((np.array(drawn) - want) ** 2, axis=0) / times)], axis=1), rtol=1e-9)
    hit = {r.conc: r for r in rs.subset_explained_with_error(library, ["AA", "GG"], times).collect()}
    own = [(r.read_id, any(x in sq.ADAPTER_5[-1:] + r.seq + sq.ADAPTER_3[:1] for x in ("AA", "GG"))) for r in rows if r.conc == 5]
    part = np.mean([h for _, h in own])
    drawn = [sum(draw(i, b) * h for i, h in own) / sum(draw(i, b) for i, _ in own) for b in range(times)]
    np.testing.assert_allclose([hit[5.0].fraction, hit[5.0].err], [part, np.sqrt(np.mean((np.array(drawn) - part) ** 2) / times)], rtol=1e-9)


def test_o_values_by_name_with_their_errors(spark, library):
    k = 3
    kmers = ["".join(t) for t in itertools.product("ACGU", repeat=k)]
    m = ov.of_input(library, k)
    assert m.length == 20 and all(abs(f.sum() - 1) < 1e-12 for f in m.letters)
    dense = shifted(k, 20, m.letters)
    r = {(x.conc, x.kmer): (x.r, x.err) for x in rs.r_values_with_error(library, k).collect()}
    got = {(x.conc, x.kmer): (x.value, x.err) for x in mt.metric_with_error("O_value", library, k).collect()}
    for conc in (5.0, 20.0):
        seen = np.array([r[conc, x] for x in kmers])
        fits = [nnls(dense, v) for v in (seen[:, 0], seen[:, 0] - seen[:, 1], seen[:, 0] + seen[:, 1])]
        want = np.stack([fits[0], np.maximum(abs(fits[0] - fits[1]), abs(fits[0] - fits[2]))], axis=1)
        np.testing.assert_allclose([got[conc, x] for x in kmers], want, atol=2e-4)
    kappa = spark.createDataFrame([(x, 1 / 64) for x in kmers], "kmer string, share double")
    occupied = spark.createDataFrame([(5.0, x, float(i % 7)) for i, x in enumerate(kmers)], "conc double, kmer string, o double")
    o = np.array([float(i % 7) for i in range(64)])
    vec = np.arcsinh(1.5 * (dense @ o + o.mean() * (20 - 3 * k + 2)))
    found = {x.kmer: x.r for x in ov.predicted_enrichment(occupied, m, kappa).collect()}
    np.testing.assert_allclose([found[x] for x in kmers], vec / vec.mean(), rtol=1e-9)


def test_every_registered_metric_has_values(spark, library):
    opened = library.withColumn("acc", F.array_repeat(F.lit(0.5), 18))
    for name in mt.METRICS:
        rows = mt.metric_with_error(name, opened, 3).collect()
        assert {r.conc for r in rows} == {5.0, 20.0} and {r.metric for r in rows} == {name}
        assert any(r.value is not None and r.value > 0 for r in rows)
        assert (name in mt.WITH_ERROR) == any(r.err is not None for r in rows)


# gradient


@pytest.mark.parametrize("linear", [False, True])
def test_adjoint_gradient_of_two_motifs_against_differences(spark, linear):
    r = np.random.default_rng(5)
    reads = spark.createDataFrame([(i, "".join(r.choice(list("ACGU"), 10 + i % 3))) for i in range(60)], "read_id long, seq string").persist()
    motifs = [Motif.of(r.random((3, 4)) * 0.8 + 0.1, 0.2), Motif.of(r.random((2, 4)) * 0.8 + 0.1, 0.05)]
    weights = r.random(16) + 0.5
    model = ft.Model(reads, 2, 1 + 0.2 * r.random((2, 16)), [5.0, 20.0], linear=linear, kmer_weights=weights)
    p, free = ft.Parameters(motifs, np.array([0.05, 0.02])), np.array([2.0, 7.0])
    s = model.state(p, free)

    def error(x):
        cells = [x[1:13].reshape(3, 4), x[14:22].reshape(2, 4)]
        return model.state(ft.Parameters([Motif(cells[0], x[0]), Motif(cells[1], x[13])], x[22:]), free).error

    g, x = model.gradient(s), p.vector()
    for i in (0, 2, 7, 12, 13, 15, 21, 22, 23):
        h = np.zeros(len(x))
        h[i] = 1e-4 * max(x[i], 0.1)
        assert math.isclose(g[i], (error(x + h) - error(x - h)) / (2 * h[i]), rel_tol=1e-3, abs_tol=1e-9)
    np.testing.assert_array_equal(model.gradient(s, 0.0), g)
    sums = {row.read_id: sum(z.sum() for _, z in ft._sites(ft._CODE[np.frombuffer(row.seq.encode(), np.uint8)][None, :], motifs)) for row in reads.collect()}
    top = max(sums.values())
    assert math.isclose(model.greatest_sum(motifs), top)
    cut = sorted(sums.values())[20] / top * (1 - 1e-12)
    kept = [i for i, v in sums.items() if v >= cut * top]
    assert 0 < len(kept) < 60
    part = ft.Model(reads.where(F.col("read_id").isin(kept)), 2, model.observed, [5.0, 20.0], linear=linear, kmer_weights=weights)
    part.adjoint = model.adjoint
    np.testing.assert_allclose(model.gradient(s, cut), part.gradient(s), rtol=1e-12)
    assert abs(model.gradient(s, cut) - g).max() > 0
    reads.unpersist()
