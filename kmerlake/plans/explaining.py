"""Queries on what explains enrichments, on spliced sequences and on affinities by range."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import background as bg
from kmerlake.operators import binning as bn
from kmerlake.operators import comparison as cp
from kmerlake.operators import counts as kc
from kmerlake.operators import metrics as mt
from kmerlake.operators import model as md
from kmerlake.operators import motifs as mo
from kmerlake.operators import sampling as sm
from kmerlake.plans.base import ENERGY, READS, folded, km, query, r_of, reads, rounded, table
from kmerlake.plans.modelling import MOTIF, sites
from kmerlake.sources import genome as gn

MODELS = {"letters": ["A", "C", "G", "U"], "letters_entropy": ["A", "C", "G", "U", "entropy"], "site": ["log_z"], "site_letters": ["A", "C", "G", "U", "log_z"], "all": ["A", "C", "G", "U", "entropy", "log_z", "pairs"]}


def enriched(spark, d):
    """Enrichments of 5-mers with what may explain them: letters, entropy, affinity and repeats of letters."""
    r = mt.r_values(reads(spark, d), 5).select("conc", "kmer", F.log2("r").alias("log_r"))
    z = mo.site_weights(F.col("kmer"), MOTIF)[0] * MOTIF.a0
    letters = {x: (sq.count_of("kmer", x) / 5).alias(x) for x in sq.NUCLEOTIDES}
    pairs = sum(((F.substring("kmer", i + 1, 1) == F.substring("kmer", i + 2, 1)).cast("double") for i in range(4)), F.lit(0.0))
    return r.select("conc", "kmer", "log_r", *letters.values(), sq.nucleotide_entropy("kmer").alias("entropy"), F.log2(z).alias("log_z"), z.alias("z"), pairs.alias("pairs"))


@query("background_models")
def _(spark, d):
    """How much of each sample's enrichments five models explain."""
    return rounded(bg.compared_models(enriched(spark, d), MODELS, "log_r", "conc")[0], "r2", "pearson")


@query("background_residuals")
def _(spark, d):
    """What the model with letters and sites leaves of each k-mer's enrichment."""
    rows = enriched(spark, d).persist()
    fits = bg.compared_models(rows, MODELS, "log_r", "conc")[1]
    return rounded(bg.residuals(rows, fits, "site_letters", "log_r", "conc").select("conc", "kmer", "predicted", "residual"), "predicted", "residual")


@query("binding_fit")
def _(spark, d):
    """Effective concentration and background share by which the affinities of k-mers explain each sample's enrichments."""
    rows = enriched(spark, d).select(F.col("conc").alias("sample"), "kmer", "z", "log_r", F.lit(1 / 4**5).alias("f0")).persist()
    out = bg.binding_fit(rows, "z", "f0", "log_r", "sample")
    rows.unpersist()
    return rounded(out, "conc", "beta", "error", digits=4)


@query("read_subset", f"WITH {READS} SELECT conc, read_id, seq FROM reads WHERE read_id IN (SELECT o_orderkey * 100000 FROM orders)")
def _(spark, d):
    return sm.subset(reads(spark, d), table(spark, d, "orders").select((F.col("o_orderkey") * 100000).alias("read_id")))


@query("masked_affinities", f"""WITH {r_of(4)}, s AS (SELECT avg(r) AS m, stddev_pop(r) AS d FROM r WHERE conc = 80)
SELECT kmer, round(CASE WHEN (r - m) / d < 1 THEN 1e-6 ELSE r END, 6) AS affinity FROM r, s WHERE conc = 80""")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4).where("conc = 80").select("kmer", F.col("r").alias("affinity"))
    return rounded(mo.masked_affinities(r, 1.0), "affinity")


_EVERY = ["".join(x) for x in itertools.product("ACGU", repeat=MOTIF.width)]
BEST = sorted(_EVERY, key=lambda x: (-math.prod(row["ACGU".index(c)] for row, c in zip(MOTIF.matrix, x)), x))[:10]
_QUOTED = ", ".join(f"'{x}'" for x in BEST)


@query("best_kmer_energies", f"WITH {READS}, {km(5)} SELECT kmer, list_position([{_QUOTED}], kmer)::INTEGER AS rank, conc, read_id, pos::INTEGER AS pos, round({ENERGY}, 9) AS e FROM km WHERE kmer IN ({_QUOTED})")
def _(spark, d):
    """Open energies at the ten k-mers of greatest affinity."""
    best = [r["kmer"] for r in mo.kmer_affinities(spark, MOTIF).orderBy(F.desc("affinity"), "kmer").limit(10).collect()]
    return rounded(kc.energies_of_best(folded(spark, d, 5), best), "e", digits=9)


@query("bound_histogram", f"""WITH {READS}, {sites(MOTIF, pad=True)}, s AS (SELECT conc, read_id, sum(z) * {MOTIF.a0!r}::DOUBLE AS z FROM z GROUP BY ALL), b AS (SELECT floor(log10(z) + 15)::INTEGER AS bin, conc, z * 20 / (z * 20 + 1) AS psi FROM s WHERE z > 0),
p AS (SELECT r.bin, coalesce(sum(psi) FILTER (WHERE conc = 0), 0) AS psi, count(psi) FILTER (WHERE conc = 80) AS n FROM range(18) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin),
v AS (SELECT bin, psi / sum(psi) OVER () AS bound, psi / sum(psi) OVER () + 0.1::DOUBLE * n / sum(n) OVER () AS v FROM p)
SELECT bin::INTEGER AS bin, round(bound, 6) AS bound, round(v / sum(v) OVER (), 6) AS share FROM v""")
def _(spark, d):
    """Affinities of the input's bound reads, with a tenth of the last sample's for a background."""
    z = md.partition_function(reads(spark, d), [MOTIF]).withColumn("z", F.col("z") * MOTIF.a0)
    bins = bn.histogram(z.where("conc = 80 and z > 0"), F.floor(F.log10("z") + 15).cast("int")).where("bin between 0 and 17")
    bins = bins.crossJoin(F.broadcast(bins.agg(F.sum("n").alias("t")))).select("bin", (F.col("n") / F.col("t")).alias("share"))
    return rounded(bn.bound_histogram(z.where("conc = 0"), "z", 20.0, 0.1, bins), "bound", "share")


@query("structure_effect", """SELECT o_orderpriority, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n
FROM (SELECT o_orderpriority, log2(o_totalprice::DOUBLE / (1000 + o_custkey % 100)) AS y, (o_orderkey % 11) / 10.0::DOUBLE AS x FROM orders) GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (1000 + F.col("o_custkey") % 100).alias("kd_plain"), F.col("o_totalprice").cast("double").alias("kd_structure"), ((F.col("o_orderkey") % 11) / 10.0).alias("gc"))
    return rounded(cp.structure_effect(o, "o_orderpriority"), "slope", "intercept", "r2")


GENOME = "(SELECT doc_id, replace(upper(regexp_replace(text, '[^ACGTUacgtu]', '', 'g')), 'U', 'T') AS s FROM documents)"


@query("spliced_records", f"""WITH g AS {GENOME}, b AS (SELECT doc_id, s, doc_id * 37 % 60 AS x FROM g WHERE length(s) >= 200),
c AS (SELECT doc_id, x, substring(s, x + 1, 40) || substring(s, x + 71, 25) AS dna FROM b)
SELECT doc_id::VARCHAR AS chrom, x AS start, x + 95 AS "end", replace(CASE WHEN doc_id % 2 = 0 THEN dna ELSE reverse(translate(dna, 'ACGT', 'TGCA')) END, 'T', 'U') AS seq FROM c""")
def _(spark, d):
    """Two blocks of each document's letters, taken as a chromosome, on alternating strands."""
    letters = F.translate(F.upper(F.regexp_replace("text", "[^ACGTUacgtu]", "")), "U", "T")
    genome = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chrom"), letters.alias("seq")).where(F.length("seq") >= 200)
    x = F.col("doc_id") * 37 % 60
    records = genome.select("chrom", x.alias("start"), (x + 95).alias("end"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.array(x, x + 70).alias("starts"), F.array(F.lit(40).cast("long"), F.lit(25).cast("long")).alias("sizes"))
    return gn.spliced(records, gn.genome_tiles(genome, 64), 64).select("chrom", "start", "end", "seq")
