"""The store of open energies: what is stopped goes on, what is repeated adds nothing."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import binning as bn
from kmerlake.sources import energies as en


def fold(df):
    return df.withColumn("e", F.transform(F.sequence(F.lit(0), F.length("seq") - 4), lambda i: F.pmod(F.col("read_id") * 7 + i * 5, F.lit(31)) / 4.0))


@pytest.fixture()
def reads(spark):
    rows = [(float(c), i, "ACGUACGUACGU"[: 8 + i % 4]) for c in (0, 5) for i in range(60)]
    return spark.createDataFrame([*rows, rows[3], (None, 4, "ACGUACGU"), (5.0, None, "ACGUACGU")], "conc double, read_id long, seq string")


def test_a_stopped_write_goes_on_and_holds_each_read_once(spark, reads, tmp_path):
    path, bins = str(tmp_path / "store"), en.Discretisation.linear(8.0)
    stopped = []

    def failing(df):
        if stopped:
            raise RuntimeError("stopped")
        stopped.append(1)
        return fold(df)

    with pytest.raises(RuntimeError):
        en.store(reads, path, 4, failing, bins, steps=4)
    part = en.stored_energies(spark, path, 4)
    held = part.count()
    assert 0 < held < 120
    # A file that a lost writer moved into place, and another of it that it did not.
    lost = en.unstored(reads, path, 4).limit(5)
    en.encoded(fold(lost), bins).withColumn("slice", en._slice()).write.mode("append").partitionBy("conc", "slice").parquet(f"{path}/energies/k=4")
    seen = []

    def watched(df):
        seen.append(df.select("conc", "read_id").collect())
        return fold(df)

    assert en.store(reads, path, 4, watched, bins, steps=4) == 120
    assert sum(map(len, seen)) == 120 - held - 5
    got = en.stored_energies(spark, path, 4).collect()
    assert set(Counter((r.conc, r.read_id) for r in got).values()) == {1} and len(got) == 120
    for r in got:
        n = 8 + r.read_id % 4 - 3
        want = [min(255, math.floor((r.read_id * 7 + i * 5) % 31 / 4 * 32)) / 32 + 1 / 64 for i in range(n)]
        np.testing.assert_allclose(r.e, want)
    assert en.store(reads, path, 4, fold, bins) == 120
    assert en.unstored(reads, path, 4).count() == 0
    with pytest.raises(ValueError):
        en.store(reads, path, 4, fold, en.Discretisation.linear(9.0))
    assert en.store(reads, path, 5, lambda df: df.withColumn("e", F.array(F.lit(1.0))), bins) == 120 and en.stored_energies(spark, path, 4).count() == 120


def test_missing_energies_count_as_open(spark, reads, tmp_path):
    got = en.with_stored_energies(reads, str(tmp_path / "none"), 4).collect()
    assert len(got) == 123 and all(r.missing and r.e == [0.0] * (len(r.seq) - 3) for r in got)
    path = str(tmp_path / "some")
    en.store(reads.where("read_id < 30"), path, 4, fold, en.Discretisation.linear(8.0))
    got = en.with_stored_energies(reads, path, 4).collect()
    assert len(got) == 123 and all(r.missing == (r.conc is None or r.read_id is None or r.read_id >= 30) and len(r.e) == len(r.seq) - 3 for r in got)


def test_rows_that_cover_the_adapters_are_told_by_their_length(spark, tmp_path):
    reads = spark.createDataFrame([(0.0, 1, "ACGUACGU")], "conc double, read_id long, seq string")
    n = 8 + len(sq.ADAPTER_5) + len(sq.ADAPTER_3) - 3
    path, bins = str(tmp_path / "full"), en.Discretisation.linear(256.0)
    en.store(reads, path, 4, lambda df: df.withColumn("e", F.array(*[F.lit(float(i)) for i in range(n)])), bins)
    own = en.with_stored_energies(reads, path, 4).first().e
    assert own == [i + 0.5 for i in range(len(sq.ADAPTER_5), len(sq.ADAPTER_5) + 5)]
    assert en.with_stored_energies(reads, path, 4, whole=True).first().e == [i + 0.5 for i in range(n)]
    path = str(tmp_path / "own")
    en.store(reads, path, 4, lambda df: df.withColumn("e", F.array(*[F.lit(1.0)] * 5)), bins)
    whole = en.with_stored_energies(reads, path, 4, whole=True).first().e
    assert len(whole) == n and sum(whole) == 5 * 1.5 and whole[len(sq.ADAPTER_5)] == 1.5
    path = str(tmp_path / "wrong")
    en.store(reads, path, 4, lambda df: df.withColumn("e", F.array(F.lit(1.0))), bins)
    with pytest.raises(Exception, match="no fitting length"):
        en.with_stored_energies(reads, path, 4).collect()


def test_codes_of_missing_and_extreme_values(spark):
    bins = en.Discretisation.linear(8.0)
    rows = spark.createDataFrame([(0.0, 1, [-5.0, None, float("nan"), 0.03, 100.0]), (0.0, 2, None), (0.0, 3, [])], "conc double, read_id long, e array<double>")
    got = {r.read_id: r for r in en.decoded(en.encoded(rows, bins), list(bins.energies)).collect()}
    assert got[1].e == [1 / 64, 1 / 64, 1 / 64, 1 / 64, 8 - 1 / 64] and got[2].e is None and got[3].e == []


def test_gamma_fit_recovers_drawn_data(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(x)) for g, (a, b) in enumerate(((0.6, 2.0), (2.0, 1.3), (15.0, 0.1))) for x in r.gamma(a, b, 4000)] + [(3, 2.0), (3, 2.0), (4, -1.0), (4, None), (0, 0.0)]
    got = {x.g: x for x in bn.gamma_fit(spark.createDataFrame(rows, "g int, x double"), "x", "g").collect()}
    for g, (a, b) in enumerate(((0.6, 2.0), (2.0, 1.3), (15.0, 0.1))):
        assert got[g].n == 4000 and abs(got[g].shape - a) < 4 * got[g].shape_err and abs(got[g].scale * got[g].shape / (a * b) - 1) < 0.08
        x = np.array([v for h, v in rows if h == g and v > 0])
        assert abs(math.log(got[g].shape) - float(bn.digamma(np.array(got[g].shape))) - (math.log(x.mean()) - np.log(x).mean())) < 1e-10
    assert got[3].shape is None and 4 not in got
    assert bn.gamma_fit(spark.createDataFrame([], "g int, x double"), "x").count() == 0


def test_gamma_bins_hold_equal_shares():
    x = np.random.default_rng(4).gamma(1.5, 1.3, 200_000)
    bins = en.Discretisation.gamma(1.5, 1.3)
    share = np.bincount(bins.encode(x), minlength=256) / len(x)
    assert abs(share * 256 - 1).max() < 0.2
    assert all(lo < e < hi for lo, e, hi in zip((0, *bins.bounds), bins.energies, (*bins.bounds, math.inf)))
