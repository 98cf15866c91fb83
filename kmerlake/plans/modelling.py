"""Queries on motifs and the binding model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import counts as kc
from kmerlake.operators import fit as ft
from kmerlake.operators import footprint as fp
from kmerlake.operators import metrics as mt
from kmerlake.operators import model as md
from kmerlake.operators import motifs as mo
from kmerlake.operators import sampling as sm
from kmerlake.operators import seeding as sd
from kmerlake.operators import tokens as tk
from kmerlake.operators.binning import histogram, log_bin
from kmerlake.plans.base import ACC, READS, domain, folded, full, km, query, reads, rounded

MOTIF = mo.Motif(np.array([[0.1, 0.2, 0.05, 1.0], [0.05, 0.02, 1.0, 0.1], [0.1, 1.0, 0.02, 0.3], [1.0, 0.05, 0.1, 0.2], [0.2, 0.1, 0.05, 1.0]]), 0.02)
OTHER = mo.Motif(np.array([[0.3, 0.1, 0.2, 1.0], [1.0, 0.2, 0.1, 0.3], [0.1, 0.1, 0.2, 1.0]]), 0.01)


def product(m: mo.Motif, s: str = "s", p: str = "p") -> str:
    return " * ".join(f"[{', '.join(f'{x!r}::DOUBLE' for x in row.tolist())}][instr('ACGU', substring({s}, {p} + {d}, 1))]" for d, row in enumerate(m.matrix))


def sites(m: mo.Motif, name: str = "z", pad: bool = False) -> str:
    s = f"'{sq.ADAPTER_5[len(sq.ADAPTER_5) - (m.width - 1):]}' || seq || '{sq.ADAPTER_3[: m.width - 1]}'" if pad else "seq"
    return f"{name} AS (SELECT conc, read_id, p - 1 AS pos, {product(m)} AS z FROM (SELECT conc, read_id, s, unnest(range(1, length(s) - {m.width} + 2)) AS p FROM (SELECT conc, read_id, {s} AS s FROM reads)))"


@query("partition_function", f"WITH {READS}, {sites(MOTIF, pad=True)} SELECT conc, read_id, round(sum(z), 9) AS z FROM z GROUP BY conc, read_id")
def _(spark, d):
    return rounded(md.partition_function(reads(spark, d), [MOTIF]).select("conc", "read_id", "z"), "z", digits=9)


@query("motif_mixture", f"WITH {READS}, {sites(MOTIF, 'a', True)}, {sites(OTHER, 'b', True)}, sa AS (SELECT read_id, conc, sum(z) AS z FROM a GROUP BY ALL), sb AS (SELECT read_id, conc, sum(z) AS z FROM b GROUP BY ALL) SELECT conc, read_id, round(sa.z + sb.z * 0.5, 9) AS z FROM sa JOIN sb USING (conc, read_id)")
def _(spark, d):
    return rounded(md.partition_function(reads(spark, d), [MOTIF, OTHER]).select("conc", "read_id", "z"), "z", digits=9)


@query("clipped_partition_function", f"WITH {READS}, {sites(MOTIF, pad=True)} SELECT conc, count(*) AS n, round(sum(c), 5) AS z, round(max(c), 6) AS most FROM (SELECT conc, read_id, least(sum(z), 0.5::DOUBLE) AS c FROM z GROUP BY conc, read_id) GROUP BY conc")
def _(spark, d):
    z = md.partition_function(reads(spark, d), [MOTIF], clip=0.5)
    return rounded(rounded(z.groupBy("conc").agg(F.count("*").alias("n"), F.sum("z").alias("z"), F.max("z").alias("most")), "z", digits=5), "most")


@query("accessible_partition_function", f"WITH {READS}, {sites(MOTIF)} SELECT conc, read_id, round(sum(z * {ACC}), 9) AS z FROM z GROUP BY conc, read_id")
def _(spark, d):
    z = F.aggregate(mo.site_weights(F.col("seq"), MOTIF, F.col("acc")), F.lit(0.0), lambda s, x: s + x)
    return rounded(folded(spark, d, 5).select("conc", "read_id", z.alias("z")), "z", digits=9)


@query("best_site", f"WITH {READS}, {sites(MOTIF)} SELECT read_id, round(sum(z), 9) AS total, round(max(z), 9) AS best, arg_max(pos, (z, -pos))::BIGINT AS at, round(max(z) / sum(z), 6) AS share FROM z GROUP BY read_id")
def _(spark, d):
    r = reads(spark, d)
    found = md.best_site(r, MOTIF).select("seq", "total", "best", "at", "share").distinct().join(r.select("read_id", "seq"), "seq").drop("seq")
    return rounded(rounded(found.withColumn("at", F.col("at").cast("long")), "total", "best", digits=9), "share")


KMER_P = product(MOTIF, "kmer", "1")


@query("kmer_affinities", f"WITH {READS}, {km(5)}, s AS (SELECT conc, kmer, count(*) AS n FROM km GROUP BY ALL) SELECT conc, kmer, n, round(greatest({KMER_P} * 0.02::DOUBLE, 1e-6::DOUBLE), 12) AS affinity FROM s")
def _(spark, d):
    """Affinities of each sample's k-mers."""
    n = kc.kmer_counts(reads(spark, d), 5, False)
    return rounded(n.join(mo.kmer_affinities(spark, MOTIF, 1e-6), "kmer").select("conc", "kmer", "n", "affinity"), "affinity", digits=12)


@query("top_motif_kmers", f"WITH {READS}, {km(5)}, s AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) SELECT kmer, n, round({KMER_P} * 0.02::DOUBLE, 12) AS affinity FROM s ORDER BY 3 DESC, 1 LIMIT 20")
def _(spark, d):
    """The k-mers of the reads with the greatest affinities."""
    n = kc.kmer_counts(reads(spark, d), 5, False).groupBy("kmer").agg(F.sum("n").alias("n"))
    return rounded(n.join(mo.kmer_affinities(spark, MOTIF), "kmer").select("kmer", "n", "affinity"), "affinity", digits=12).orderBy(F.desc("affinity"), "kmer").limit(20)


@query("single_protein_sum", f"WITH {READS}, {km(5)} SELECT conc, read_id, round(sum({KMER_P} * 0.02::DOUBLE * {ACC}), 9) AS z FROM km GROUP BY conc, read_id")
def _(spark, d):
    return rounded(md.single_protein(folded(spark, d, 5), 5, mo.kmer_affinities(spark, MOTIF), "acc"), "z", digits=9)


@query("site_correlation", f"WITH {READS}, {sites(MOTIF, 'a')}, {sites(OTHER, 'b')} SELECT (b.pos - a.pos)::INTEGER AS dist, round(sum(a.z * b.z), 4) AS s FROM a JOIN b ON a.read_id = b.read_id AND a.conc = b.conc GROUP BY 1")
def _(spark, d):
    return rounded(md.site_correlation(reads(spark, d), MOTIF, OTHER), "s", digits=4)


@query("psam_statistics", f"""WITH {READS}, {km(1)}, n AS (SELECT conc::INTEGER AS motif_id, pos, kmer AS nt, count(*) AS n FROM km GROUP BY ALL), c AS (SELECT motif_id, pos, nt, n / max(n) OVER (PARTITION BY motif_id)::DOUBLE AS aff FROM n),
t AS (SELECT *, sum(aff) OVER (PARTITION BY motif_id, pos) AS s FROM c)
SELECT motif_id, pos::INTEGER AS pos, round((max(aff) / any_value(s) - 0.25) / 0.75, 6) AS discrimination, round(2 + sum(aff / s * log2(aff / s)), 6) AS information, round(max(aff), 6) AS greatest FROM t GROUP BY motif_id, pos""")
def _(spark, d):
    """Discrimination and information of the letters at each position of each sample's reads, taken as a motif."""
    n = kc.position_profile(reads(spark, d), 1).select(F.col("conc").cast("int").alias("motif_id"), F.col("pos").cast("int").alias("pos"), F.col("kmer").alias("nt"), "n")
    top = n.groupBy("motif_id").agg(F.max("n").alias("t"))
    cell = n.join(F.broadcast(top), "motif_id").select("motif_id", "pos", "nt", (F.col("n") / F.col("t")).alias("aff"))
    greatest = cell.groupBy("motif_id", "pos").agg(F.max("aff").alias("greatest"))
    return rounded(mo.cell_statistics(cell).drop("best").join(greatest, ["motif_id", "pos"]), "discrimination", "information", "greatest")


@query("footprint", f"""WITH {READS}, {km(3)}, a AS (SELECT conc, read_id, pos, {ACC} AS acc FROM km), {sites(MOTIF)}
SELECT z.conc, (a.pos - z.pos)::INTEGER AS rel, round(sum(z.z * a.acc) / sum(z.z), 6) AS acc FROM z JOIN a ON a.conc = z.conc AND a.read_id = z.read_id AND a.pos - z.pos BETWEEN -5 AND 9 GROUP BY ALL""")
def _(spark, d):
    return rounded(fp.footprint(folded(spark, d, 3), MOTIF), "acc")


@query("informative_reads", f"""WITH {READS}, {sites(MOTIF, pad=True)}, s AS (SELECT conc, read_id, sum(z) AS z FROM z GROUP BY ALL), c AS (SELECT *, max(z) OVER () * 0.5 AS cut, quantile_cont(z, 0.5) OVER () AS mid FROM s), k AS (SELECT *, avg((z > cut)::INTEGER) OVER () AS n FROM c)
SELECT conc, read_id FROM k WHERE z > CASE WHEN n > 0.5 THEN mid ELSE cut END""")
def _(spark, d):
    return fp.informative_reads(md.partition_function(reads(spark, d), [MOTIF]), share=0.5).select("conc", "read_id")


@query("predicted_r", f"""WITH {full(3)}, {sites(MOTIF, pad=True)}, s AS (SELECT read_id, sum(z) AS z FROM z WHERE conc = 0 GROUP BY read_id),
w AS (SELECT k.kmer, sum(z * 0.2 / (z * 0.2 + 1)) AS q FROM km k JOIN s USING (read_id) WHERE k.conc = 0 GROUP BY k.kmer), f AS (SELECT kmer, n AS n0 FROM full_counts WHERE conc = 0),
v AS (SELECT f.kmer, n0, coalesce(q, 0) + n0 * 0.01 AS w FROM f LEFT JOIN w USING (kmer))
SELECT 0 AS sample, kmer, round(w / (n0 / sum(n0) OVER ()::DOUBLE) / sum(w) OVER (), 6) AS r FROM v WHERE n0 > 0""")
def _(spark, d):
    x = md.occupied(md.partition_function(reads(spark, d).where("conc = 0"), [MOTIF]), 10.0, MOTIF.a0)
    return rounded(md.predicted_r(x, 3, [F.col("psi")], [0.01]), "r")


@query("affinity_histogram", f"WITH {READS}, {sites(MOTIF, pad=True)}, s AS (SELECT conc, read_id, sum(z) AS z FROM z GROUP BY ALL) SELECT conc, greatest(0, least(29, floor((log10(z) + 3) / (4 / 30.0::DOUBLE))))::INTEGER AS bin, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    return histogram(md.partition_function(reads(spark, d), [MOTIF]), log_bin("z", -3.0, 1.0, 30), "conc")


@query("reads_by_affinity")
def _(spark, d):
    """Twenty reads of each affinity class."""
    return sm.by_affinity(md.partition_function(reads(spark, d), [MOTIF]), "z", 20).select("conc", "read_id", "bin", "z")


@query("partial_affinities")
def _(spark, d):
    """Affinities of the reads' 4-mers, which a motif may overhang."""
    short = kc.kmer_counts(reads(spark, d), 4, False).select(F.col("kmer").alias("seq")).distinct()
    return rounded(mo.partial_affinities(short, [MOTIF, OTHER]), "affinity", digits=9)


@query("gapless_score")
def _(spark, d):
    """Best scores of the reads' 4-mers within a motif, with their counts."""
    n = kc.kmer_counts(reads(spark, d), 4, False).groupBy("kmer").agg(F.sum("n").alias("n"))
    return n.select("kmer", "n", F.round(mo.gapless_score(F.col("kmer"), MOTIF, multiply=True), 9).alias("score"))


@query("ska_weights")
def _(spark, d):
    return rounded(md.ska_weights(reads(spark, d), 4), "weight")


@query("free_protein")
def _(spark, d):
    """Free protein at four totals, from the log-binned partition function of the input."""
    hist = md.AffinityHistogram.of(md.partition_function(reads(spark, d).where("conc = 0"), [MOTIF]))
    return spark.createDataFrame([(float(t), float(hist.free_protein(t, 1000.0, MOTIF.a0))) for t in (5, 20, 80, 320)], "total double, free double")


@query("seed_motifs")
def _(spark, d):
    """Motifs of the k-mers enriched over all pull-down samples."""
    kmers = sd.enriched_kmers(sd.corrected_r(mt.r_values(reads(spark, d), 5)), 2.5, 10, 60)
    return mo.to_tables(spark, sd.seed_motifs(kmers, n_min=3))[1]


@query("footprint_grid")
def _(spark, d):
    return rounded(fp.calibrate(folded(spark, d, 3), MOTIF, range(-1, 3), 10.0), "error", digits=9)


@query("model_descent")
def _(spark, d):
    """Error over two steps of a fit to the observed enrichments."""
    r = reads(spark, d)
    seen = mt.r_values(r, 3)
    index = {x["kmer"]: x["kidx"] for x in tk.kmer_domain(spark, 3).collect()}
    concs = [5.0, 20.0, 80.0]
    observed = np.ones((3, 64))
    for x in seen.collect():  # 4**k rows for each sample
        observed[concs.index(x["conc"]), index[x["kmer"]]] = x["r"]
    control = r.where("conc = 0").persist()
    model = ft.Model(control, 3, observed, concs)
    out = ft.descend(model, ft.Parameters([OTHER], np.full(3, 0.01)), steps=2)
    control.unpersist()
    return spark.createDataFrame([(h["t"], h["error"]) for h in out.history], "t int, error double")
