"""Counting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators import binning as bn
from kmerlake.operators import counts as kc
from kmerlake.operators import ordering as od
from kmerlake.operators import sampling as sm
from kmerlake.operators import sets as st
from kmerlake.operators import tokens as tk
from kmerlake.plans.base import ACC, ENERGY, READS, U, domain, folded, freq, full, km, query, reads, rounded, table
from kmerlake.sources import reads as rd
from kmerlake.sources import tables as tb

CORES = ["UUU", "GCA", "AUG", "UAU"]
WANTED = ["UGCAU", "UUUUU", "AUUAU", "GAAUU"]
QUOTED = {k: ", ".join(f"'{x}'" for x in v) for k, v in {"cores": CORES, "wanted": WANTED}.items()}


@query("read_dimensions", f"WITH {READS} SELECT conc, count(*) AS reads, max(length(seq))::INTEGER AS length FROM reads GROUP BY conc")
def _(spark, d):
    return rd.dimensions(reads(spark, d))


@query("valid_reads", r"""SELECT read_id, substring(seq, 1, 4) AS seq FROM (SELECT doc_id * 100000 + i AS read_id, replace(upper(w[i]), 'T', 'U') AS seq
FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents))) WHERE length(seq) >= 4 AND regexp_matches(substring(seq, 1, 4), '^[ACGU]+$')""")
def _(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("i", "seq"))
    return rd.valid_reads(words.select((F.col("doc_id") * 100000 + F.col("i") + 1).alias("read_id"), "seq"), length=4)


@query("rows_with_kmer", f"WITH {READS} SELECT conc, read_id FROM reads WHERE instr('CGAUC' || seq || 'UGGAA', 'AUUAUU') > 0")
def _(spark, d):
    return reads(spark, d).where(F.instr(sq.padded("seq", 6), "AUUAUU") > 0).select("conc", "read_id")


@query("read_chunk", f"WITH {READS}, ends AS (SELECT min(read_id) AS lo, max(read_id) AS hi FROM reads) SELECT conc, read_id, seq FROM reads, ends WHERE (read_id - lo) // ((hi - lo + 8) // 8) = 3")
def _(spark, d):
    return sm.chunk(reads(spark, d), 3, 8)


for K in (4, 6):
    for PAD in (False, True):

        @query(f"kmer_count_{K}" + "_padded" * PAD, f"WITH {READS}, {km(K, PAD)} SELECT conc, kmer, count(*) AS n FROM km GROUP BY conc, kmer")
        def _(spark, d, k=K, pad=PAD):
            return kc.kmer_counts(reads(spark, d), k, pad)


@query("kmer_count_deduplicated", f"WITH {READS}, {km(6, True)} SELECT conc, kmer, count(*) AS n FROM km GROUP BY conc, kmer")
def _(spark, d):
    return kc.kmer_counts_deduplicated(reads(spark, d), 6)


@query("valid_kmer_count", """SELECT kmer, count(*) AS n FROM (SELECT replace(upper(substring(s, p, 3)), 'T', 'U') AS kmer FROM (SELECT text AS s, unnest(range(1, length(text) - 1)) AS p FROM documents WHERE length(text) >= 3))
WHERE regexp_matches(kmer, '^[ACGU]{3}$') GROUP BY kmer""")
def _(spark, d):
    return kc.valid_kmer_counts(table(spark, d, "documents").select(F.col("text").alias("seq")), 3)


@query("counts_per_read", f"WITH {READS}, {km(3)} SELECT conc, read_id, kmer, count(*) AS n FROM km GROUP BY ALL")
def _(spark, d):
    return kc.counts_per_read(reads(spark, d), 3)


@query("weighted_kmer_count", f"WITH {READS}, {km(5, True)} SELECT conc, kmer, round(sum({U}) + 1e-20, 6) AS w FROM km GROUP BY conc, kmer")
def _(spark, d):
    return rounded(kc.weighted_counts(reads(spark, d), 5, sm.lcg_uniform("read_id")), "w")


@query("accessible_kmer_count", f"WITH {READS}, {km(4)} SELECT conc, kmer, round(sum({ACC}), 6) AS w FROM km GROUP BY conc, kmer")
def _(spark, d):
    return rounded(kc.accessible_counts(folded(spark, d, 4), 4), "w")


@query("reads_with_kmer", f"WITH {READS}, {km(6, True)} SELECT conc, kmer, count(DISTINCT read_id) AS n_reads FROM km GROUP BY conc, kmer")
def _(spark, d):
    return kc.reads_with_kmer(reads(spark, d), 6)


@query("reads_with_kmer_set", f"WITH {READS}, {km(5, True)}, h AS (SELECT conc, read_id, max((kmer IN ({QUOTED['wanted']}))::INTEGER) AS hit FROM km GROUP BY ALL) SELECT conc, sum(hit)::BIGINT AS n_hit, count(*) AS n_reads FROM h GROUP BY conc")
def _(spark, d):
    return kc.reads_with_any(reads(spark, d), WANTED)


@query("pure_reads", f"WITH {READS}, {km(5, True)}, h AS (SELECT conc, read_id, min(kmer) AS kmer FROM km WHERE kmer IN ({QUOTED['wanted']}) GROUP BY conc, read_id HAVING count(DISTINCT kmer) = 1) SELECT conc, kmer, count(*) AS n_reads FROM h GROUP BY conc, kmer")
def _(spark, d):
    return kc.pure_reads(reads(spark, d), WANTED)


@query("recall_by_rank", f"""WITH {READS}, {km(5, True)}, h AS (SELECT conc, read_id, min(list_position([{QUOTED['wanted']}], kmer)) AS rank FROM km WHERE kmer IN ({QUOTED['wanted']}) GROUP BY conc, read_id)
SELECT conc, [{QUOTED['wanted']}][rank] AS kmer, rank::BIGINT AS rank, count(*) AS n_reads FROM h GROUP BY conc, rank""")
def _(spark, d):
    return kc.recall_by_rank(reads(spark, d), WANTED)


@query("kmer_frequency", f"WITH {freq(4)} SELECT conc, kmer, round(f, 6) AS f FROM freq")
def _(spark, d):
    return rounded(kc.frequencies(kc.kmer_counts(reads(spark, d), 4), 4), "f")


@query("read_fraction", f"""WITH {full(4)}, w AS (SELECT conc, kmer, count(DISTINCT read_id) AS m FROM km GROUP BY conc, kmer)
SELECT f.conc, f.kmer, round((coalesce(m, 0) + 10) / (reads + 10)::DOUBLE, 6) AS fraction FROM full_counts f LEFT JOIN w ON w.conc = f.conc AND w.kmer = f.kmer""")
def _(spark, d):
    r = reads(spark, d)
    return rounded(kc.read_fractions(kc.reads_with_kmer(r, 4), kc.totals(r), 4), "fraction")


@query("position_profile", f"WITH {READS}, {km(3)} SELECT conc, kmer, pos::INTEGER AS pos, count(*) AS n FROM km GROUP BY ALL")
def _(spark, d):
    return kc.position_profile(reads(spark, d), 3)


@query("count_and_last_position", f"WITH {READS}, {km(3)} SELECT conc, read_id, count(*) FILTER (WHERE kmer = 'UUU') AS n, coalesce(max(pos) FILTER (WHERE kmer = 'UUU'), -1)::BIGINT AS last_pos FROM km GROUP BY conc, read_id")
def _(spark, d):
    return kc.count_and_last(reads(spark, d), "UUU")


COOC = f"""{READS}, {km(3)}, hit AS (SELECT * FROM km WHERE kmer IN ({QUOTED['cores']})),
cooc AS (SELECT a.conc, a.kmer AS kmer_a, b.kmer AS kmer_b, b.pos - a.pos AS dist, count(*) AS n FROM hit a JOIN hit b ON a.read_id = b.read_id AND a.conc = b.conc AND b.pos > a.pos GROUP BY ALL)"""
EXPECTED = f"""prof AS (SELECT conc, kmer, pos, count(*) AS n FROM hit GROUP BY ALL), tot AS (SELECT conc, count(*) AS reads FROM reads GROUP BY conc),
expected AS (SELECT a.conc, a.kmer AS kmer_a, b.kmer AS kmer_b, b.pos - a.pos AS dist, sum(a.n * b.n)::DOUBLE / max(t.reads) / (38 - (b.pos - a.pos)) AS expected
FROM prof a JOIN prof b ON a.conc = b.conc AND b.pos > a.pos JOIN tot t ON t.conc = a.conc
WHERE b.pos - a.pos >= 3 OR substring(a.kmer, b.pos - a.pos + 1) = substring(b.kmer, 1, 3 - (b.pos - a.pos)) GROUP BY a.conc, a.kmer, b.kmer, b.pos - a.pos)"""


@query("cooccurrence", f"WITH {COOC} SELECT conc, kmer_a, kmer_b, dist::INTEGER AS dist, n FROM cooc")
def _(spark, d):
    return kc.cooccurrence(reads(spark, d), CORES)


@query("expected_cooccurrence", f"WITH {COOC}, {EXPECTED} SELECT conc, kmer_a, kmer_b, dist::INTEGER AS dist, round(expected, 6) AS expected FROM expected")
def _(spark, d):
    r = reads(spark, d)
    return rounded(kc.expected_cooccurrence(kc.position_profile(r, 3), kc.totals(r), CORES, 40), "expected")


JOINT = f"""{READS}, {km(2, True)}, j AS (SELECT a.conc, b.pos - a.pos AS dist, a.kmer AS kmer_a, b.kmer AS kmer_b, count(*) AS n FROM km a JOIN km b ON a.conc = b.conc AND a.read_id = b.read_id AND b.pos - a.pos >= 2 GROUP BY ALL)"""


@query("joint_frequency", f"WITH {JOINT} SELECT conc, dist::INTEGER AS dist, kmer_a, kmer_b, round((n + 1) / (sum(n) OVER (PARTITION BY conc, dist) + 256)::DOUBLE, 9) AS f FROM j")
def _(spark, d):
    return rounded(kc.joint_frequencies(reads(spark, d), 2), "f", digits=9)


@query("core_flank_profile", f"WITH {READS}, {km(2, name='c')}, {km(1, name='f')} SELECT c.conc, c.kmer AS core, f.kmer AS flank, (f.pos - c.pos)::INTEGER AS rel, (count(*) + 1)::DOUBLE AS n FROM c JOIN f ON c.conc = f.conc AND c.read_id = f.read_id GROUP BY ALL")
def _(spark, d):
    return kc.core_flank_profile(reads(spark, d), 2, 1)


FLANK = f"{READS}, {km(3, name='c')}, {km(2, name='f')}, fl AS (SELECT c.conc, f.kmer AS flank, f.pos - c.pos AS rel, count(*) AS n FROM c JOIN f ON c.conc = f.conc AND c.read_id = f.read_id WHERE c.kmer = 'AUU' GROUP BY ALL)"


@query("flank_profile", f"WITH {FLANK} SELECT conc, flank, rel::INTEGER AS rel, n FROM fl")
def _(spark, d):
    return kc.flank_profile(reads(spark, d), "AUU", 2)


@query("crosstalk", f"WITH {READS}, {km(3, name='a')}, {km(2, name='b')} SELECT a.conc, a.kmer AS kmer_1, b.kmer AS kmer_2, count(*) AS n FROM a JOIN b ON a.conc = b.conc AND a.read_id = b.read_id AND b.pos > a.pos - 2 AND b.pos < a.pos + 3 GROUP BY ALL")
def _(spark, d):
    return kc.crosstalk(reads(spark, d), 3, 2)


@query("energy_histogram", f"WITH {READS}, {km(3)} SELECT conc, kmer, greatest(0, least(255, floor({ENERGY} / (8.0::DOUBLE / 256))))::INTEGER AS bin, count(*) AS n FROM km GROUP BY ALL")
def _(spark, d):
    return kc.energy_histogram(folded(spark, d, 3), 3)


NEAR = f"{READS}, {km(3)}, h AS (SELECT conc, read_id, pos AS at FROM km WHERE kmer = 'GCA'), e AS (SELECT conc, read_id, pos, {ENERGY} AS e FROM km)"


@query("energy_profile", f"WITH {NEAR} SELECT h.conc, (e.pos - h.at)::INTEGER AS rel, count(*) AS n, round(avg(e), 6) AS mean_e FROM h JOIN e ON h.conc = e.conc AND h.read_id = e.read_id AND abs(e.pos - h.at) <= 10 GROUP BY ALL")
def _(spark, d):
    return rounded(kc.energy_profile(folded(spark, d, 3), "GCA"), "mean_e")


@query("aligned_energy_profile", f"WITH {NEAR} SELECT h.conc, (e.pos - h.at + 5)::INTEGER AS rel, count(*) AS n, round(avg(e), 6) AS mean_e FROM h JOIN e ON h.conc = e.conc AND h.read_id = e.read_id AND e.pos BETWEEN h.at - 5 AND h.at + 6 WHERE h.at >= 5 AND h.at + 7 <= 38 GROUP BY ALL")
def _(spark, d):
    return rounded(kc.aligned_profile(folded(spark, d, 3), "GCA"), "mean_e")


@query("energies_of_kmer", f"WITH {READS}, {km(3)} SELECT conc, read_id, pos::INTEGER AS pos, round({ENERGY}, 6) AS e FROM km WHERE kmer = 'GCA'")
def _(spark, d):
    return rounded(kc.energies_of(folded(spark, d, 3), "GCA"), "e")


@query("nucleotide_entropy_profile", f"""WITH {READS}, {km(1)}, p AS (SELECT conc, pos, kmer, count(*) AS n FROM km GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY conc, pos)::DOUBLE AS f FROM p)
SELECT conc, pos::INTEGER AS pos, round(-sum(f * log2(f)), 6) AS entropy FROM q GROUP BY conc, pos""")
def _(spark, d):
    return rounded(kc.nucleotide_entropy_by_position(reads(spark, d)), "entropy")


KIDX = " + ".join(f"(instr('ACGU', substring(kmer, {i}, 1)) - 1) * {4 ** (6 - i)}" for i in range(1, 7))


def seen(spark, d, k: int):
    """(kmer, n): the k-mers of all reads."""
    return kc.kmer_counts(reads(spark, d), k, False).groupBy("kmer").agg(F.sum("n").alias("n"))


def seen_sql(k: int) -> str:
    return f"{READS}, {km(k)}, seen AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer)"


@query("kmer_domain", f"WITH {full(6)} SELECT conc, kmer, ({KIDX})::BIGINT AS kidx, n FROM full_counts")
def _(spark, d):
    """Every 6-mer with its number, and how often each sample has it."""
    counts = tk.dense(kc.kmer_counts(reads(spark, d), 6), 6)
    return counts.join(tk.kmer_domain(spark, 6), "kmer").select("conc", "kmer", "kidx", "n")


@query("kmer_index", f"WITH {READS}, {km(6)} SELECT kmer, ({KIDX})::BIGINT AS kidx, count(*) AS n FROM km GROUP BY ALL")
def _(spark, d):
    return tk.kmer_positions(reads(spark, d), 6).groupBy("kmer", sq.kmer_index("kmer").alias("kidx")).agg(F.count("*").alias("n"))


@query("excluded_kmers", f"WITH {seen_sql(5)} SELECT kmer, n FROM seen WHERE NOT (contains(kmer, 'UUU') OR contains(kmer, 'GCA'))")
def _(spark, d):
    banned = spark.createDataFrame([("UUU",), ("GCA",)], "core string")
    return st.excluded(seen(spark, d, 5), banned, 3)


@query("containing_kmers", f"WITH {seen_sql(5)} SELECT kmer, n FROM seen WHERE contains(kmer, 'UUU') OR contains(kmer, 'GCA')")
def _(spark, d):
    cores = spark.createDataFrame([("UUU",), ("GCA",)], "core string")
    return st.containing(seen(spark, d, 5), cores, 3)


@query("kmer_neighbourhood", f"WITH {seen_sql(4)}, {domain(4)} SELECT a.kmer, b.kmer AS variant, coalesce(v.n, 0) AS n FROM seen a JOIN dom b ON hamming(a.kmer, b.kmer) <= 1 LEFT JOIN seen v ON v.kmer = b.kmer")
def _(spark, d):
    """Each k-mer of the reads with its single substitutions, and how often these are there."""
    n = seen(spark, d, 4)
    return st.neighbourhood(n, 4).join(n.withColumnRenamed("kmer", "variant"), "variant", "left").select("kmer", "variant", F.coalesce("n", F.lit(0)).alias("n"))


@query("kmer_extensions", f"""WITH {seen_sql(5)}, {km(6, name='km6')}, n6 AS (SELECT kmer, count(*) AS n FROM km6 GROUP BY kmer), x(x) AS (VALUES ('A'), ('C'), ('G'), ('U')),
e AS (SELECT kmer, 'left' AS side, x || kmer AS extended FROM seen CROSS JOIN x UNION ALL SELECT kmer, 'right', kmer || x FROM seen CROSS JOIN x) SELECT e.kmer, side, extended, coalesce(n6.n, 0) AS n FROM e LEFT JOIN n6 ON n6.kmer = extended""")
def _(spark, d):
    """Each 5-mer of the reads with its extensions to 6 letters, and how often these are there."""
    longer = seen(spark, d, 6).withColumnRenamed("kmer", "extended")
    return st.extensions(seen(spark, d, 5)).join(longer, "extended", "left").select("kmer", "side", "extended", F.coalesce("n", F.lit(0)).alias("n"))


@query("shifted_neighbours", f"""WITH {seen_sql(4)}, {domain(1, 'e')}, s AS (SELECT seen.kmer, -1 AS shift, e.kmer || substring(seen.kmer, 1, 3) AS neighbour, 0.5::DOUBLE AS weight FROM seen CROSS JOIN e
UNION ALL SELECT seen.kmer, 1, substring(seen.kmer, 2, 3) || e.kmer, 0.5::DOUBLE FROM seen CROSS JOIN e) SELECT s.*, coalesce(v.n, 0) AS n FROM s LEFT JOIN seen v ON v.kmer = neighbour""")
def _(spark, d):
    """Each k-mer of the reads with those that overlap it a base away, and how often these are there."""
    n = seen(spark, d, 4)
    return st.shifted_neighbours(n, 4).join(n.withColumnRenamed("kmer", "neighbour"), "neighbour", "left").select("kmer", "shift", "neighbour", "weight", F.coalesce("n", F.lit(0)).alias("n"))


GC = "(length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))"
ENT = " + ".join(f"coalesce((length(seq) - length(replace(seq, '{x}', ''))) / length(seq)::DOUBLE * log2(nullif(length(seq) - length(replace(seq, '{x}', '')), 0) / length(seq)::DOUBLE), 0)" for x in "ACGU")


@query("sequence_scalars", f"""WITH {READS} SELECT read_id, reverse(translate(seq, 'ACGU', 'UGCA')) AS revcomp, round({GC} / length(seq)::DOUBLE, 6) AS gc, round(-({ENT}), 6) + 0.0::DOUBLE AS entropy FROM reads""")
def _(spark, d):
    out = reads(spark, d).select("read_id", sq.reverse_complement("seq").alias("revcomp"), sq.gc_content("seq").alias("gc"), sq.nucleotide_entropy("seq").alias("entropy"))
    return rounded(out, "gc", "entropy")


@query("counts_matrix", f"""WITH {READS}, {km(4, True)} SELECT kmer, count(*) FILTER (WHERE conc = 0) AS "n0", count(*) FILTER (WHERE conc = 5) AS "n5", count(*) FILTER (WHERE conc = 20) AS "n20", count(*) FILTER (WHERE conc = 80) AS "n80" FROM km GROUP BY kmer""")
def _(spark, d):
    wide = tb.counts_matrix(kc.kmer_counts(reads(spark, d), 4), [0.0, 5.0, 20.0, 80.0])
    return wide.select("kmer", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"n{int(float(c))}") for c in wide.columns if c != "kmer"])


@query("linear_bins", "SELECT greatest(0, least(49, floor((l_extendedprice - 1000) / 2000)))::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"))
    return bn.histogram(rows, bn.linear_bin("x", 1000.0, 101000.0, 50))


@query("digitised", "SELECT (CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 5 THEN 1 ELSE 0 END)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    return bn.digitised(table(spark, d, "lineitem").select(F.col("l_quantity").alias("x")), "x", [5.0, 20.0, 40.0]).groupBy("bin").agg(F.count("*").alias("n"))


@query("density", """WITH h AS (SELECT greatest(0, least(19, floor((l_quantity - 0) / 2.5)))::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, lead(n) OVER (ORDER BY bin) AS nx FROM h)
SELECT bin, n, round(n / sum((n + nx) / 2.0::DOUBLE * 2.5) OVER (), 6) AS density FROM w""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"))
    return rounded(bn.density(bn.histogram(rows, bn.linear_bin("x", 0.0, 50.0, 20)), 2.5), "density")


@query("equal_frequency_bins", "WITH b AS (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS bin FROM orders) SELECT bin::INTEGER AS bin, count(*) AS n, round(min(o_totalprice), 2)::DOUBLE AS low FROM b GROUP BY bin")
def _(spark, d):
    rows = od.equal_frequency(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), "o_totalprice", 10, "o_orderkey")
    return rounded(rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low")), "low", digits=2)
