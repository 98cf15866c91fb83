"""Queries on cooperative binding, occupancies behind enrichments and bootstrap errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import cooperative as co
from kmerlake.operators import fit as ft
from kmerlake.operators import metrics as mt
from kmerlake.operators import ordering as od
from kmerlake.operators import overlap as ov
from kmerlake.operators import resampling as rs
from kmerlake.operators.sampling import poisson_steps
from kmerlake.plans.base import READS, full, query, reads, replicate_u, rounded, table
from kmerlake.plans.modelling import MOTIF, OTHER, product

PAIR = co.Binding([MOTIF, OTHER], [40.0, 25.0], np.array([[1.0, 6.0], [0.25, 3.0]]), reach=1)


def _site_list(m, free: float, name: str) -> str:
    return f"list_transform(range(1, length(s) - {m.width} + 2), lambda p: {product(m)} * {m.a0 * free!r}::DOUBLE) AS {name}"


def _step(binding: co.Binding, a: int) -> str:
    """The next weight of a site of protein a that ends at base i + 1, from the lists of forward sums."""
    w = binding.motifs[a].width
    near = [f"({float(binding.cooperativity[b, a]) - 1!r}::DOUBLE) * coalesce(g{b}[greatest(i + 1 - {w} - {d} + 1, 0)], 0)" for b in range(2) for d in range(binding.reach + 1) if binding.cooperativity[b, a] != 1]
    return f"CASE WHEN i + 1 >= {w} THEN x{a}[i + 1 - {w} + 1] * (f[i + 1 - {w} + 1] + {' + '.join(near) or '0'}) ELSE 0 END"


@query("cooperative_binding", f"""WITH RECURSIVE {READS}, padded AS (SELECT conc, read_id, '{sq.ADAPTER_5[len(sq.ADAPTER_5) - PAIR.flank:]}' || seq || '{sq.ADAPTER_3[: PAIR.flank]}' AS s FROM reads),
steps AS (SELECT conc, read_id, length(s) AS l, {_site_list(MOTIF, PAIR.free[0], 'x0')}, {_site_list(OTHER, PAIR.free[1], 'x1')}, 0 AS i, [1.0::DOUBLE] AS f, [0.0::DOUBLE] AS g0, [0.0::DOUBLE] AS g1 FROM padded
UNION ALL SELECT conc, read_id, l, x0, x1, i + 1, list_append(f, f[i + 1] + t0 + t1), list_append(g0, t0), list_append(g1, t1) FROM (SELECT *, {_step(PAIR, 0)} AS t0, {_step(PAIR, 1)} AS t1 FROM steps WHERE i < l))
SELECT conc, read_id, round(ln(f[l + 1]), 6) AS log_z, round(1 - 1 / f[l + 1], 6) AS p_bound FROM steps WHERE i = l""")
def _(spark, d):
    """Both motifs on a read, with sites that exclude each other and neighbours that help or hinder."""
    return rounded(co.cooperative_binding(reads(spark, d), PAIR).select("conc", "read_id", "log_z", "p_bound"), "log_z", "p_bound")


@query("occupancy_profile")
def _(spark, d):
    """Mean occupancy of each base by each of two proteins, from forward and backward sums."""
    return rounded(co.occupancy_profile(reads(spark, d), PAIR), "occupancy")


@query("approximation_error")
def _(spark, d):
    """How far the binding curve of reads with excluding sites is from that of a single site of their summed affinity."""
    return rounded(co.approximation_error(reads(spark, d), MOTIF).select("conc", "read_id", "kd", "p_at_kd", "rmse"), "kd", "p_at_kd", "rmse")


def _draws(replicates: int, where: str = "") -> str:
    """CTE of the multiplicity of each read in each replicate."""
    steps = poisson_steps()
    case = "CASE " + " ".join(f"WHEN u < {limit!r}::DOUBLE THEN {n}" for n, limit in steps) + f" ELSE {steps[-1][0] + 1} END"
    fixed = "CASE WHEN conc = 0 THEN 1 ELSE " if where else ""
    return f"draws AS (SELECT conc, read_id, i, {fixed}{case}{' END' if fixed else ''} AS m FROM (SELECT conc, read_id, i, {replicate_u('i')} AS u FROM reads CROSS JOIN range({replicates}) r(i)))"


@query("r_value_error", f"""WITH {full(3)}, {_draws(10, 'fixed')}, b AS (SELECT k.conc, k.kmer, d.i, sum(m) AS n FROM km k JOIN draws d ON d.conc = k.conc AND d.read_id = k.read_id GROUP BY ALL),
every AS (SELECT c.conc, c.kmer, r.i, c.n AS n_all, coalesce(b.n, 0) AS n FROM full_counts c CROSS JOIN range(10) r(i) LEFT JOIN b ON b.conc = c.conc AND b.kmer = c.kmer AND b.i = r.i),
f AS (SELECT conc, kmer, i, (n_all + 10) / sum(n_all + 10) OVER (PARTITION BY conc, i)::DOUBLE AS f, (n + 10) / sum(n + 10) OVER (PARTITION BY conc, i)::DOUBLE AS fb FROM every)
SELECT a.conc, a.kmer, round(any_value(a.f / c.f), 6) AS r, round(stddev_pop(a.fb / c.f), 6) AS err FROM f a JOIN f c ON c.conc = 0 AND c.kmer = a.kmer AND c.i = a.i WHERE a.conc <> 0 GROUP BY a.conc, a.kmer""")
def _(spark, d):
    """Enrichment with its error over ten bootstrap replicates, all made in one pass."""
    return rounded(rs.r_values_with_error(reads(spark, d), 3), "r", "err")


@query("explained_fraction_error", f"""WITH {full(4)}, {_draws(10)}, hit AS (SELECT DISTINCT conc, read_id, kmer FROM km), n AS (SELECT conc, kmer, count(*) AS n FROM hit GROUP BY ALL),
b AS (SELECT h.conc, h.kmer, d.i, sum(m) AS n FROM hit h JOIN draws d ON d.conc = h.conc AND d.read_id = h.read_id GROUP BY ALL), t AS (SELECT conc, i, sum(m) AS n FROM draws GROUP BY ALL),
every AS (SELECT c.conc, c.kmer, (coalesce(n.n, 0) + 10) / (c.reads + 10)::DOUBLE AS fraction, (coalesce(b.n, 0) + 10) / (t.n + 10)::DOUBLE AS drawn FROM full_counts c JOIN t ON t.conc = c.conc LEFT JOIN n ON n.conc = c.conc AND n.kmer = c.kmer LEFT JOIN b ON b.conc = c.conc AND b.kmer = c.kmer AND b.i = t.i)
SELECT conc, kmer, round(any_value(fraction), 6) AS fraction, round(sqrt(avg((drawn - fraction) ** 2) / 10), 6) AS err FROM every GROUP BY conc, kmer""")
def _(spark, d):
    return rounded(rs.explained_with_error(reads(spark, d), 4), "fraction", "err")


@query("o_value")
def _(spark, d):
    """Occupancies behind the enrichments, with their errors."""
    return rounded(ov.o_values(reads(spark, d), 4), "o", "err", digits=5)


@query("enrichment_from_occupancies")
def _(spark, d):
    """The enrichments that fitted occupancies predict through the overlaps of k-mers."""
    r = reads(spark, d)
    m = ov.of_input(r, 4)
    kappa = rs.resampled_counts(r.where("conc = 0"), 4, 1)[0].select("kmer", "n")
    kappa = kappa.join(F.broadcast(kappa.agg(F.sum("n").alias("t"))), how="cross").select("kmer", (F.col("n") / F.col("t")).alias("share"))
    occupied = ov.occupancies(rs.r_values_with_error(r, 4).select("conc", "kmer", F.col("r").alias("o")), m, "o")
    return rounded(ov.predicted_enrichment(occupied, m, kappa), "r", "background", digits=5)


@query("information_test")
def _(spark, d):
    """Bits that the price of an order tells of its customer's balance, against a hundred random orders of the prices."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(od.mutual_information_test(o, "o_totalprice", "c_acctbal"), "mi", "null_mean", "null_sd", "z", "p")


@query("model_gradient")
def _(spark, d):
    """Derivative of the model's error by each of its parameters, of all reads and of those with a fair chance to be bound."""
    r = reads(spark, d)
    k, concs = 3, [5.0, 20.0, 80.0]
    observed = np.ones((3, 4**k))
    for x in mt.r_values(r, k).select("conc", sq.kmer_index("kmer").alias("i"), "r").collect():  # 4**k rows for each sample
        observed[concs.index(x["conc"]), x["i"]] = x["r"]
    control = r.where("conc = 0").persist()
    model = ft.Model(control, k, observed, concs)
    state = model.state(ft.Parameters([MOTIF, OTHER], np.full(3, 0.01)))
    whole, part = model.gradient(state), model.gradient(state, 0.01)
    control.unpersist()
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(whole, part))], "parameter int, derivative double, above_threshold double")
