"""Results that only larger tables or longer keys reach, and sums made in Arrow batches against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import counts as kc
from kmerlake.operators import metrics as mt
from kmerlake.operators import model as md
from kmerlake.operators import motifs as mo
from kmerlake.operators import pairs as pr
from kmerlake.operators import sampling as sm
from kmerlake.operators import statistics as ss
from kmerlake.plans import base, counting  # noqa: F401  registers the queries


def test_mann_whitney_of_millions_of_rows(spark):
    n = 4_400_000
    rows = spark.range(n).select((F.col("id") % 2 == 1).alias("f"), (F.col("id") % 4).cast("double").alias("x"))
    got = ss.mann_whitney(rows, "x", "f").first()
    assert (got.n1, got.n0) == (n // 2, n // 2) and n**3 // 4 > 2**63
    u = 3 * (n / 4) ** 2  # 1 above 0, 3 above 0 and 2
    assert got.u == u
    assert math.isclose(got.z, (u - n * n / 8) / math.sqrt(n * n * (n + 1) / 48), rel_tol=1e-12)


def test_simulated_pulldown_of_large_read_ids(spark):
    ids = [0, 5, 83_588 * 100_000, 600_000 * 100_000 + 7, 2**62 + 11]
    rows = spark.createDataFrame([(i, "ACGU", [p, p]) for i in ids for p in (0.2, 0.7)], "read_id long, seq string, psi array<double>")
    got = sorted((x.conc, x.read_id) for x in sm.simulated_pulldown(rows, {5.0: 0.0, 20.0: 0.1}).collect())
    u = {i: (i * 1103515245 + 12345) % 2**31 / 2**31 for i in ids}
    assert got == sorted((c, i) for i in ids for p in (0.2, 0.7) for c, b in ((5.0, 0.0), (20.0, 0.1)) if u[i] <= 1 - (1 - p) * (1 - b))


def test_weighted_counts_of_large_read_ids(spark):
    ids = [3, 256_409 * 100_000 + 1, 2**61 + 5]
    rows = spark.createDataFrame([(5.0, i, "GAUU") for i in ids], "conc double, read_id long, seq string")
    got = {x.kmer: x.w for x in kc.weighted_counts(rows, 3, sm.lcg_uniform("read_id"), pad=False).collect()}
    w = sum((i * 1103515245 + 12345) % 2**31 / 2**31 for i in ids)
    assert got.keys() == {"GAU", "AUU"} and all(math.isclose(x, w, rel_tol=1e-12) for x in got.values())


def _pairs(rows, k1, k2, least=-99, most=99, core=None):
    n = Counter()
    for c, _, s in rows:
        for p in range(len(s or "") - k1 + 1):
            for q in range(len(s) - k2 + 1):
                if least <= q - p <= most and core in (None, s[p : p + k1]):
                    n[c, s[p : p + k1], s[q : q + k2], q - p] += 1
    return n


def _mixed_reads():
    r = random.Random(3)
    own = [(r.choice([0.0, 5.0, None]), i, "".join(r.choice("ACGU") for _ in range(r.choice([0, 1, 2, 5, 12, 12])))) for i in range(90)]
    return [*own, (5.0, 90, None), (5.0, 91, "ACNUAUUNN"), (5.0, 92, "AUUAUé"), (0.0, None, "AUUAUU"), (0.0, 7, "AUUAUU")]


@pytest.mark.parametrize(("dense", "held"), [(1 << 22, 1 << 23), (1 << 22, 1), (1, 1)])
def test_pairs_against_plain_loops(spark, monkeypatch, dense, held):
    monkeypatch.setattr(pr, "DENSE", dense)
    monkeypatch.setattr(pr, "HELD", held)
    rows = _mixed_reads()
    df = spark.createDataFrame(rows, "conc double, read_id long, seq string").coalesce(2)
    for a in ((2, 1), (3, 2, -1, 2), (2, 2, 2), (3, 2, None, None, "AUU"), (1, 3, -2, None, "N")):
        k1, k2, least, most, core = [*a, None, None, None][:5]
        got = {(x.conc, x.kmer_1, x.kmer_2, x.rel): x.n for x in pr.pair_counts(df, k1, k2, least, most, core=core).collect()}
        assert got == _pairs(rows, k1, k2, -99 if least is None else least, 99 if most is None else most, core), a


def test_numbers_of_long_kmers_stay_within_a_long():
    r = random.Random(4)
    codes, alphabet = pr.letters(["".join(r.choice("ACGU") for _ in range(60)) for _ in range(5)])
    out, size = pr.numbered(codes, len(alphabet), 40)
    assert alphabet == "ACGU" and out.shape == (21, 5) and len(set(out.ravel().tolist())) == 105 and out.max() < size < 1 << 31


def test_core_flank_profile_makes_no_row_for_each_pair(spark):
    rows = _mixed_reads()
    df = spark.createDataFrame(rows, "conc double, read_id long, seq string")
    made = kc.core_flank_profile(df, 2, 1)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    want = _pairs(rows, 2, 1)
    assert {(x.conc, x.core, x.flank, x.rel): x.n for x in made.collect()} == {k: n + 1.0 for k, n in want.items()}


def test_ska_weights_take_rows_as_reads(spark):
    r = random.Random(8)
    rows = [(c, i, "".join(r.choice("AACGU") for _ in range(9))) for c in (0.0, 5.0) for i in range(30)]
    rows += [(5.0, 31, "ACNGUU"), (5.0, 32, "A"), (5.0, 33, None)]
    own = lambda ids: {x.kmer: x.weight for x in md.ska_weights(spark.createDataFrame([(c, ids(i), s) for c, i, s in rows], "conc double, read_id long, seq string"), 2).collect()}
    want, without, shared = own(lambda i: i), own(lambda i: None), own(lambda i: i // 2)
    assert len(want) == 16 and math.isclose(sum(want.values()), 16)
    for got in (without, shared):
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_site_correlation_makes_no_row_for_each_pair(spark):
    r = random.Random(9)
    a, b = (mo.Motif(np.array([[r.random() for _ in range(4)] for _ in range(w)])) for w in (3, 2))
    rows = ["".join(r.choice("ACGU") for _ in range(r.choice([1, 2, 3, 9, 9]))) for _ in range(50)] + ["ACNUGGA", "ACéUGGA", "", None]
    z = lambda m, s, p: math.prod(m.matrix[d]["ACGU".index(x)] if x in "ACGU" else 0.0 for d, x in enumerate(s[p : p + m.width]))
    want = Counter()
    for s in rows:
        for p in range(len(s or "") - 2):
            for q in range(len(s) - 1):
                want[q - p] += z(a, s, p) * z(b, s, q)
    made = md.site_correlation(spark.createDataFrame([(s,) for s in rows], "seq string"), a, b)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    got = {x.dist: x.s for x in made.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-9, abs_tol=1e-12) for d in want)


def test_crosstalk_makes_no_row_for_each_pair(spark):
    rows = _mixed_reads()
    made = kc.crosstalk(spark.createDataFrame(rows, "conc double, read_id long, seq string"), 3, 2)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for (c, a, b, _), n in _pairs(rows, 3, 2, -1, 2).items():
        want[c, a, b] += n
    assert {(x.conc, x.kmer_1, x.kmer_2): x.n for x in made.collect()} == want


def test_mutual_information_makes_no_row_for_each_pair(spark):
    rows = [(c, i, s) for c, i, s in _mixed_reads() if c is not None and s and "é" not in s]
    made = mt.mutual_information(spark.createDataFrame(rows, "conc double, read_id long, seq string"), 1)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    n = _pairs(rows, 1, 1, 1)
    whole, fa, fb, want = Counter(), Counter(), Counter(), Counter()
    for (c, a, b, d), x in n.items():
        whole[c, d] += x
        fa[c, d, a] += x
        fb[c, d, b] += x
    for (c, a, b, d), x in n.items():
        w = whole[c, d]
        want[c, d] += x / w * math.log2(x * w / (fa[c, d, a] * fb[c, d, b]))
    got = {(x.conc, x.dist): x.mi for x in made.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_flank_divergence_goes_through_the_reads_once(spark):
    rows = [(c, i, s) for c, i, s in _mixed_reads() if c is not None]
    made = mt.flank_divergence(spark.createDataFrame(rows, "conc double, read_id long, seq string"), "AU", 1)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" not in plan
    f = Counter({(c, q, b): n for (c, _, b, q), n in _pairs(rows, 2, 1, core="AU").items()})
    rels = {q for _, q, _ in f}
    share = lambda c, q, b: (f[c, q, b] + 10) / sum(f[c, q, x] + 10 for x in "ACGU")
    for x in made.collect():
        want = 0.0 if -1 < x.rel < 2 else math.log2(share(x.conc, x.rel, x.flank) / share(0.0, x.rel, x.flank))
        assert x.rel in rels and math.isclose(x.log_ratio, want, rel_tol=1e-9, abs_tol=1e-12)


def test_weighted_kmer_count_of_large_doc_ids(spark, tmp_path):
    text = "ACGUUAGCAU" * 9
    ids = [0, 83_588, 1_024_617, 80_000_000_000]
    spark.createDataFrame([(i, text, "src5") for i in ids], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want: dict = {}
    for read_id, seq in [(i * 100_000 + j, s) for i in ids for j, s in enumerate((text[:40], text[40:80], text[-40:]))]:
        padded = sq.ADAPTER_5[-4:] + seq + sq.ADAPTER_3[:4]
        for p in range(len(padded) - 4):
            want[padded[p : p + 5]] = want.get(padded[p : p + 5], 0.0) + (read_id * 1103515245 + 12345) % 2**31 / 2**31
    got = {x.kmer: x.w for x in base.QUERIES["weighted_kmer_count"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_top_interactors_from_one_pass(spark):
    rows = [(c, i, s) for c, i, s in _mixed_reads() if c is not None]
    divergence = mt.flank_divergence(spark.createDataFrame(rows, "conc double, read_id long, seq string"), "AU", 1)
    made = mt.top_interactors(divergence, 2)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    best = {}
    for x in divergence.collect():
        best[x.flank] = max(best.get(x.flank, -math.inf), x.kl_term)
    assert [x.flank for x in made.collect()] == sorted(best, key=lambda k: (-best[k], k))[:2]


def test_accessibilities_are_made_once_a_read(spark):
    m = mo.Motif(np.array([[0.1, 0.2, 0.05, 1.0], [0.3, 1.0, 0.02, 0.3]]))
    rows = spark.createDataFrame([(1, "ACGUU"), (2, "A")], "read_id long, seq string")
    acc = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.exp(-(F.col("read_id") + i) / 7.0))
    z = rows.select("read_id", acc.alias("acc"), "seq").select("read_id", mo.site_weights(F.col("seq"), m, F.col("acc"), 1).alias("z"))
    plan = z._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.index("transform(") :].splitlines()[0]
    assert inner.startswith("transform(array(transform("), inner  # bound outside the lambda of the windows
    got = {x.read_id: x.z for x in z.collect()}
    cell = lambda s: math.prod(m.matrix[d]["ACGU".index(x)] for d, x in enumerate(s))
    want = [cell("ACGUU"[p : p + 2]) * (math.exp(-(2 + p) / 7) if p < 3 else 0.0) for p in range(4)]
    assert got[2] == [] and np.allclose(got[1], want, rtol=1e-12)
