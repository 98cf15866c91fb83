"""Queries over stored open energies, and the gamma distribution that their quantile bins follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.functions.energy import accessibility, rt
from kmerlake.operators import binning as bn
from kmerlake.operators import counts as kc
from kmerlake.operators import footprint as fp
from kmerlake.operators.footprint import synthetic_energies
from kmerlake.plans.base import ENERGY, READS, km, query, reads, rounded
from kmerlake.plans.modelling import MOTIF, sites
from kmerlake.sources import energies as en
from kmerlake.sources.shared import shared_path

BINS = en.Discretisation.linear(8.0)
STEP = 8.0 / en.CODES
STORED = f"((floor({ENERGY} / {STEP!r}::DOUBLE) + 0.5::DOUBLE) * {STEP!r}::DOUBLE)"
OPEN = f"exp(-{STORED} / {rt(4.0)!r})"


def opened(spark, d, k: int):
    """Reads with the energies that a store, written before, decodes to."""
    r = reads(spark, d)
    path = shared_path(spark, "energies")
    en.store(r, path, k, lambda part: synthetic_energies(part, k), BINS)
    return en.with_stored_energies(r, path, k)


@query("stored_energy_histogram", f"WITH {READS}, {km(5)} SELECT conc, kmer, floor({ENERGY} / {STEP!r}::DOUBLE)::INTEGER AS bin, count(*) AS n FROM km GROUP BY ALL")
def _(spark, d):
    return kc.energy_histogram(opened(spark, d, 5), 5)


@query("stored_accessible_count", f"WITH {READS}, {km(5)} SELECT conc, kmer, round(sum({OPEN}), 6) AS w FROM km GROUP BY conc, kmer")
def _(spark, d):
    rows = opened(spark, d, 5).withColumn("acc", F.transform("e", lambda x: accessibility(x, 4.0)))
    return rounded(kc.accessible_counts(rows, 5), "w")


@query("stored_footprint", f"""WITH {READS}, {km(3)}, a AS (SELECT conc, read_id, pos, {OPEN} AS acc FROM km), {sites(MOTIF)}
SELECT z.conc, (a.pos - z.pos)::INTEGER AS rel, round(sum(z.z * a.acc) / sum(z.z), 6) AS acc FROM z JOIN a ON a.conc = z.conc AND a.read_id = z.read_id AND a.pos - z.pos BETWEEN -5 AND 9 GROUP BY ALL""")
def _(spark, d):
    rows = opened(spark, d, 3).withColumn("acc", F.transform("e", lambda x: accessibility(x, 4.0)))
    return rounded(fp.footprint(rows, MOTIF), "acc")


_PSI = "(ln(a + 8) - 1 / (2 * (a + 8)) - 1 / (12 * (a + 8) ** 2) + 1 / (120 * (a + 8) ** 4) - 1 / (252 * (a + 8) ** 6) + 1 / (240 * (a + 8) ** 8) - list_sum(list_transform(range(8), lambda i: 1 / (a + i))))"
_PSI1 = "(1 / (a + 8) + 1 / (2 * (a + 8) ** 2) + 1 / (6 * (a + 8) ** 3) - 1 / (30 * (a + 8) ** 5) + 1 / (42 * (a + 8) ** 7) - 1 / (30 * (a + 8) ** 9) + list_sum(list_transform(range(8), lambda i: 1 / (a + i) ** 2)))"


@query("gamma_fit", f"""WITH RECURSIVE {READS}, {km(5)}, e AS (SELECT conc, {ENERGY} AS e FROM km), s AS (SELECT conc, count(*) AS n, avg(e) AS m, ln(avg(e)) - avg(ln(e)) AS s FROM e WHERE e > 0 GROUP BY conc),
step AS (SELECT conc, n, m, s, 0 AS i, (3 - s + sqrt((s - 3) ** 2 + 24 * s)) / (12 * s) AS a FROM s
UNION ALL SELECT conc, n, m, s, i + 1, 1 / (1 / a + (ln(a) - {_PSI} - s) / (a * a * (1 / a - {_PSI1}))) FROM step WHERE i < 12)
SELECT conc, n, round(a, 6) AS shape, round(m / a, 6) AS scale, round(sqrt(a / (n * (a * {_PSI1} - 1))), 6) AS shape_err FROM step WHERE i = 12""")
def _(spark, d):
    """The gamma distribution of each sample's open energies, by greatest likelihood."""
    rows = synthetic_energies(reads(spark, d), 5).select("conc", F.explode("e").alias("e"))
    return rounded(bn.gamma_fit(rows, "e", "conc"), "shape", "scale", "shape_err")


@query("gamma_binned_energies")
def _(spark, d):
    """Energies of a store whose bins are quantiles of the distribution fitted to them: mean error of what it decodes to, and reads, by sample."""
    k = 5
    r = synthetic_energies(reads(spark, d), k)
    fitted = bn.gamma_fit(r.select(F.explode("e").alias("e")), "e").first()
    path = shared_path(spark, "energies")
    en.store(r.drop("e"), path, k, lambda part: synthetic_energies(part, k), en.Discretisation.gamma(fitted["shape"], fitted["scale"]))
    both = r.join(en.stored_energies(spark, path, k).withColumnRenamed("e", "_e"), ["conc", "read_id"])
    off = F.aggregate(F.zip_with("e", "_e", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("e")
    return rounded(both.groupBy("conc").agg(F.count("*").alias("reads"), F.avg(off).alias("mean_error")), "mean_error")
