"""Queries that compare fits and runs, on stand-ins from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.operators import comparison as cp
from kmerlake.operators import counts as kc
from kmerlake.operators import metrics as mt
from kmerlake.operators import motifs as mo
from kmerlake.operators import tokens as tk
from kmerlake.plans.base import READS, domain, km, query, r_of, reads, rounded, table
from kmerlake.plans.modelling import MOTIF, product

ERRORS = "o AS (SELECT o_custkey % 50 AS rbp, o_orderpriority AS p, avg(o_totalprice)::DOUBLE AS error, corr(o_totalprice, o_orderkey)::DOUBLE AS corr FROM orders GROUP BY ALL)"


def errors(spark, d):
    o = table(spark, d, "orders")
    x = F.col("o_totalprice").cast("double")
    return o.groupBy((F.col("o_custkey") % 50).alias("rbp"), F.col("o_orderpriority").alias("p")).agg(F.avg(x).alias("error"), F.corr(x, F.col("o_orderkey").cast("double")).alias("corr"))


@query("run_differences", f"WITH {ERRORS} SELECT a.rbp, round(log2(a.error / b.error), 6) + 0.0::DOUBLE AS log_error, round(a.corr - b.corr, 6) + 0.0::DOUBLE AS d_corr FROM o a JOIN o b ON a.rbp = b.rbp AND a.p = '1-URGENT' AND b.p = '5-LOW' WHERE NOT isnan(a.corr - b.corr)")
def _(spark, d):
    e = errors(spark, d)
    out = cp.run_differences(e.where("p = '1-URGENT'"), e.where("p = '5-LOW'"), "rbp")
    return rounded(out.where("d_corr is not null and not isnan(d_corr)"), "log_error", "d_corr")


@query("agreement", f"WITH {r_of(4)} SELECT round(avg((a.r - b.r) ** 2), 6) AS error, round(corr(log2(a.r), log2(b.r)), 6) AS pearson, 0 AS sample FROM r a JOIN r b ON a.kmer = b.kmer AND a.conc = 5 AND b.conc = 80")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4)
    a, b = (r.where(F.col("conc") == c).select(F.lit(0).alias("sample"), "kmer", "r") for c in (5.0, 80.0))
    return rounded(cp.agreement(a, b), "error", "pearson")


@query("footprint_summary", """WITH f AS (SELECT l_suppkey AS rbp, l_discount::DOUBLE * 10 AS rel_err, l_tax::DOUBLE AS scale, l_quantity::DOUBLE / 50 AS overlap FROM lineitem)
SELECT rbp, round(avg(rel_err), 6) AS mean_err, min(rel_err) AS min_err, round(avg(scale), 6) AS mean_scale, count(*) FILTER (WHERE NOT (overlap > 0.5 AND rel_err < 0.9)) AS failed, bool_and(overlap > 0.5 AND rel_err < 0.9) AS all_good FROM f GROUP BY rbp""")
def _(spark, d):
    c = lambda x: F.col(x).cast("double")
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rbp"), (c("l_discount") * 10).alias("rel_err"), c("l_tax").alias("scale"), (c("l_quantity") / 50).alias("overlap"))
    return rounded(cp.footprint_summary(f), "mean_err", "mean_scale")


@query("enrichment_classes", f"WITH {r_of(5)} SELECT conc, CASE WHEN r > 20 THEN '20+' WHEN r > 5 THEN '5-20' WHEN r > 2 THEN '2-5' WHEN r > 1 THEN '1-2' ELSE 'NA' END AS class, count(*) AS n FROM (SELECT conc, kmer, round(r, 9) AS r FROM r) GROUP BY ALL")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 5).withColumn("r", F.round("r", 9))
    return r.groupBy("conc", cp.enrichment_class("r").alias("class")).agg(F.count("*").alias("n"))


AFF = f"{domain(5)}, a AS (SELECT kmer, {product(MOTIF, 'kmer', '1')} * 0.02::DOUBLE * 50 AS b FROM dom)"


@query("neighbour_occupancy", f"""WITH {READS}, {km(5)}, {km(1, name='km1')}, {AFF}, f AS (SELECT kmer, count(*) / (SELECT count(*) FROM km WHERE conc = 0)::DOUBLE AS p0 FROM km WHERE conc = 0 GROUP BY kmer),
l AS (SELECT kmer AS nt, count(*) / (SELECT count(*) FROM km1 WHERE conc = 0)::DOUBLE AS q FROM km1 WHERE conc = 0 GROUP BY kmer),
n AS (SELECT kmer, b, q, substring(kmer, 2, 4) || nt AS beside FROM a CROSS JOIN l UNION ALL SELECT kmer, b, q, nt || substring(kmer, 1, 4) FROM a CROSS JOIN l),
s AS (SELECT n.kmer, sum(q * (n.b + a.b) / (n.b + a.b + 1)) / 2 AS s FROM n JOIN a ON a.kmer = n.beside GROUP BY n.kmer)
SELECT kmer, round(p0 * s, 9) AS p FROM s JOIN f USING (kmer)""")
def _(spark, d):
    """Chance that a k-mer of the input is there and bound, alone or through the one beside it."""
    b = mo.kmer_affinities(spark, MOTIF).select("kmer", (F.col("affinity") * 50).alias("b"))
    control = reads(spark, d).where("conc = 0")

    def share(k: int, name: str, value: str):
        n = kc.kmer_counts(control, k, False)
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select(F.col("kmer").alias(name), (F.col("n") / F.col("t")).alias(value))  # one row

    return rounded(cp.neighbour_occupancy(b, share(5, "kmer", "p0"), share(1, "nt", "q"), 5), "p", digits=9)


@query("complementarity_check", f"""WITH {r_of(4)}, e AS (SELECT DISTINCT kmer, ((instr('ACGU', substring(kmer, 1, 1)) * 7 + instr('ACGU', substring(kmer, 3, 1)) * 3) % 11)::DOUBLE AS dg FROM r),
m AS (SELECT *, quantile_cont(dg, 0.5) OVER () AS mid FROM e), j AS (SELECT conc, log2(r) AS x, dg AS y FROM r JOIN m USING (kmer) WHERE dg <= mid),
k AS (SELECT *, rank() OVER (PARTITION BY conc ORDER BY x) + (count(*) OVER (PARTITION BY conc, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY conc ORDER BY y) + (count(*) OVER (PARTITION BY conc, y) - 1) / 2.0::DOUBLE AS ry FROM j)
SELECT conc, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman, count(*) AS n FROM k GROUP BY conc""")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4)
    at = lambda i: F.instr(F.lit("ACGU"), F.substring("kmer", i, 1))
    e = tk.kmer_domain(spark, 4).select("kmer", ((at(1) * 7 + at(3) * 3) % 11).cast("double").alias("dg"))
    return rounded(cp.complementarity_check(r, e), "pearson", "spearman", digits=5)


@query("subgroup_effects", "SELECT o_orderpriority, round(avg(x), 4) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 5) AS t, count(*) AS n FROM (SELECT o_orderpriority, o_totalprice::DOUBLE AS x FROM orders) GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("x"))
    return rounded(rounded(cp.subgroup_effects(x, "o_orderpriority", "x"), "mean", digits=4), "t", digits=5)
