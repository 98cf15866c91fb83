"""Ranks, running sums, quantiles and tests by ranges against brute force, and plans without a task for a whole table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.operators import ordering as od
from kmerlake.operators import ranking as rk
from kmerlake.operators import statistics as ss


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    values = [r.choice([1.0, 2.0, 2.0, r.gauss(0, 3)]) for _ in range(400)]
    return [(i, "abc"[i % 3] if i % 7 else None, v if i % 50 else None, r.random()) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "i int, g string, x double, w double").repartition(6).persist()


def test_below_and_ranks(df, rows):
    got = {r.i: r.rank for r in od.ranked(df, "x", "rank", "g").collect()}
    assert len(got) == 400
    for i, g, x, _ in rows:
        own = [v for _, h, v, _ in rows if h == g and v is not None]
        assert got[i] is None if x is None else got[i] == sum(v < x for v in own) + (sum(v == x for v in own) + 1) / 2
    for r in od.below(df, "x", w=F.col("w")).collect():
        lesser = [w for _, _, v, w in rows if v is not None and v < r.x]
        assert r.n_below == len(lesser) and math.isclose(r.w_below, sum(lesser), abs_tol=1e-9)
    assert od.below(df.limit(0), "x").count() == 0


@pytest.mark.parametrize("within", [(), ("g",)])
def test_cumulative_curve(df, rows, within):
    for r in rk.cumulative_curve(df, "x", "w", *within).collect():
        own = [(v, w) for _, g, v, w in rows if not within or g == r.g]
        if r.x is None:
            assert r.cum is None
        else:
            assert math.isclose(r.cum, sum(w for v, w in own if v is not None and v <= r.x) / sum(w for _, w in own))


def test_quantiles_are_those_of_percentile(df):
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    for within in ((), ("g",)):
        want = {tuple(r[c] for c in within): r for r in df.groupBy(*within).agg(*[F.percentile("x", F.lit(p)).alias(f"p{p}") for p in shares]).collect()}
        got = od.exact_quantiles(df, "x", shares, *within).collect()
        assert len(got) == len(want) * len(shares)
        for r in got:
            assert math.isclose(r.value, want[tuple(r[c] for c in within)][f"p{r.share}"], abs_tol=1e-12)


def test_equal_frequency_bins(df, rows):
    for bins in (1, 7, 64, 500):
        got = {r.i: r.bin for r in od.equal_frequency(df.where("x is not null"), "x", bins, "i").collect()}
        order = [i for _, i in sorted((x, i) for i, _, x, _ in rows if x is not None)]
        n = len(order)
        want = [b + 1 for b in range(bins) for _ in range(n // bins + (b < n % bins))]
        assert [got[i] for i in order] == want
    assert od.equal_frequency(df.limit(0), "x", 3).count() == 0


def test_correlation_and_rank_sum(df, rows):
    own = [(x, w) for _, _, x, w in rows if x is not None]
    rank = lambda v: np.array([sum(u < a for u in v) + (sum(u == a for u in v) + 1) / 2 for a in v])
    got = ss.correlations(df.where("x is not null"), "x", "w").first()
    np.testing.assert_allclose([got.pearson, got.spearman], [np.corrcoef(*zip(*own))[0, 1], np.corrcoef(rank([x for x, _ in own]), rank([w for _, w in own]))[0, 1]])
    u = ss.mann_whitney(df.where("x is not null").withColumn("f", F.col("w") < 0.4), "x", "f").first()
    a, b = [x for x, w in own if w < 0.4], [x for x, w in own if w >= 0.4]
    assert u.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and (u.n1, u.n0) == (len(a), len(b))


def test_information_against_permutations(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=1000).round(1)
    y = x * 0.15 + r.normal(size=1000)
    got = od.mutual_information_test(spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (math.nan, 2.0)], "x double, y double"), "x", "y", 5, 400).first()
    at = lambda v: np.minimum(4, np.floor(np.array([(v < a).sum() for a in v]) * 5 / 1000)).astype(int)
    bx, by = at(x), at(y)

    def bits(a, b):
        joint = np.zeros((5, 5))
        np.add.at(joint, (a, b), 1)
        return od.information(joint, np.bincount(a, minlength=5) / 1000, np.bincount(b, minlength=5) / 1000)

    null = [bits(r.permutation(bx), by) for _ in range(400)]
    assert got.n == 1000 and math.isclose(got.mi, bits(bx, by), rel_tol=1e-12)
    assert abs(got.null_mean - np.mean(null)) < 4 * np.std(null) / 14 and abs(got.null_sd / np.std(null) - 1) < 0.2
    assert math.isclose(got.z, (got.mi - got.null_mean) / got.null_sd) and math.isclose(got.p, math.erfc(got.z / math.sqrt(2)) / 2)
    assert od.mutual_information_test(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0
    one = od.mutual_information_test(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), "x", "y").first()
    assert one.z is None and one.p is None and one.mi == 0


def test_no_task_holds_a_whole_table(df):
    for out in (rk.cumulative_curve(df, "x", "w"), od.equal_frequency(df, "x", 5), od.ranked(df, "x", "r"), od.below(df, "x")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        window = [line for line in plan.split("\n") if "Window" in line and "windowspecdefinition(x" in line]
        assert not window
