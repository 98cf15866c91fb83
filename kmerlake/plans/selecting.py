"""Queries on enrichment metrics, ranks, windows, sampling and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kmerlake.functions import energy as en
from kmerlake.operators import counts as kc
from kmerlake.operators import metrics as mt
from kmerlake.operators import peaks as pk
from kmerlake.operators import ranking as rk
from kmerlake.operators import sampling as sm
from kmerlake.operators import seeding as sd
from kmerlake.operators import statistics as ss
from kmerlake.plans.base import ACC, READS, U, folded, freq, full, km, query, r_of, reads, replicate_u, rounded, table
from kmerlake.plans.counting import COOC, CORES, EXPECTED, FLANK, JOINT, NEAR, QUOTED, WANTED
from kmerlake.sources import tables as tb


@query("r_value", f"WITH {r_of(4)} SELECT conc, kmer, round(r, 6) AS r FROM r")
def _(spark, d):
    return rounded(mt.r_values(reads(spark, d), 4), "r")


@query("w_value", f"""WITH {full(3, pad=False)}, w AS (SELECT conc, kmer, sum({ACC}) AS w FROM km GROUP BY ALL),
p AS (SELECT f.conc, f.kmer, (coalesce(w, 0) + 1) / reads AS x FROM full_counts f LEFT JOIN w ON w.conc = f.conc AND w.kmer = f.kmer)
SELECT a.conc, a.kmer, round(a.x / b.x, 6) AS w FROM p a JOIN p b ON a.kmer = b.kmer AND b.conc = 0 WHERE a.conc <> 0""")
def _(spark, d):
    return rounded(mt.w_values(folded(spark, d, 3), 3), "w")


@query("f_ratio", f"""WITH {full(4)}, w AS (SELECT conc, kmer, count(DISTINCT read_id) AS m FROM km GROUP BY conc, kmer),
p AS (SELECT f.conc, f.kmer, (coalesce(m, 0) + 10) / (reads + 10)::DOUBLE AS x FROM full_counts f LEFT JOIN w ON w.conc = f.conc AND w.kmer = f.kmer)
SELECT a.conc, a.kmer, round(a.x / b.x, 6) AS f_ratio FROM p a JOIN p b ON a.kmer = b.kmer AND b.conc = 0 WHERE a.conc <> 0""")
def _(spark, d):
    return rounded(mt.f_ratios(reads(spark, d), 4), "f_ratio")


SHARES = f"""w AS (SELECT unnest([{QUOTED['wanted']}]) AS kmer), t AS (SELECT conc, count(*) AS reads FROM reads GROUP BY conc),
p AS (SELECT t.conc, w.kmer, (count(h.read_id) + 10) / (t.reads + 10)::DOUBLE AS x FROM t CROSS JOIN w LEFT JOIN h ON h.conc = t.conc AND h.kmer = w.kmer GROUP BY t.conc, w.kmer, t.reads)
SELECT a.conc, a.kmer, round(a.x / b.x, 6) AS value FROM p a JOIN p b ON a.kmer = b.kmer AND b.conc = 0 WHERE a.conc <> 0"""


@query("pure_f_ratio", f"WITH {READS}, {km(5, True)}, h AS (SELECT conc, read_id, min(kmer) AS kmer FROM km WHERE kmer IN ({QUOTED['wanted']}) GROUP BY conc, read_id HAVING count(DISTINCT kmer) = 1), {SHARES}")
def _(spark, d):
    return rounded(mt.pure_f_ratios(reads(spark, d), WANTED).withColumnRenamed("pure_f_ratio", "value"), "value")


@query("recall_ratio", f"WITH {READS}, {km(5, True)}, h AS (SELECT conc, read_id, [{QUOTED['wanted']}][min(list_position([{QUOTED['wanted']}], kmer))] AS kmer FROM km WHERE kmer IN ({QUOTED['wanted']}) GROUP BY conc, read_id), {SHARES}")
def _(spark, d):
    return rounded(mt.recall_ratios(reads(spark, d), WANTED).withColumnRenamed("recall_ratio", "value"), "value")


@query("differential_information", f"""WITH {full(4)}, t AS (SELECT *, sum(n) OVER (PARTITION BY conc)::DOUBLE AS w FROM full_counts),
j AS (SELECT a.conc, a.kmer, a.n, b.n AS n0, a.w, b.w AS w0, a.w / (a.w + b.w) AS p, (a.n + b.n) / (a.w + b.w) AS px FROM t a JOIN t b ON a.kmer = b.kmer AND b.conc = 0 WHERE a.conc <> 0)
SELECT conc, kmer, CASE WHEN n > 0 AND n0 > 0 THEN round(p * log2(n / w / (px * p)) + (1 - p) * log2(n0 / w0 / (px * (1 - p))), 6) + 0.0::DOUBLE END AS di FROM j""")
def _(spark, d):
    return rounded(mt.differential_information(reads(spark, d), 4), "di")


@query("explained_fraction", f"WITH {READS}, {km(5, True)}, h AS (SELECT conc, read_id, max((kmer IN ({QUOTED['wanted']}))::INTEGER) AS hit FROM km GROUP BY ALL) SELECT conc, round(avg(hit), 6) AS fraction FROM h GROUP BY conc")
def _(spark, d):
    return rounded(mt.explained_fraction(reads(spark, d), WANTED), "fraction")


@query("mutual_information", f"""WITH {JOINT}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY conc, dist)::DOUBLE AS f FROM j),
m AS (SELECT *, sum(f) OVER (PARTITION BY conc, dist, kmer_a) AS fa, sum(f) OVER (PARTITION BY conc, dist, kmer_b) AS fb FROM p)
SELECT conc, dist::INTEGER AS dist, round(sum(f * log2(f / (fa * fb))), 6) AS mi FROM m GROUP BY conc, dist""")
def _(spark, d):
    return rounded(mt.mutual_information(reads(spark, d), 2), "mi")


FLANKED = f"""{FLANK}, dd AS (SELECT a.x || b.x AS flank FROM (VALUES ('A'), ('C'), ('G'), ('U')) a(x) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('U')) b(x)),
grid AS (SELECT DISTINCT c.conc, r.rel, dd.flank FROM (SELECT DISTINCT conc FROM fl) c CROSS JOIN (SELECT DISTINCT rel FROM fl) r CROSS JOIN dd),
g AS (SELECT grid.*, coalesce(fl.n, 0) + 10 AS n FROM grid LEFT JOIN fl USING (conc, rel, flank)), q AS (SELECT *, n / sum(n) OVER (PARTITION BY conc, rel)::DOUBLE AS f FROM g),
kl AS (SELECT a.conc, a.rel, a.flank, CASE WHEN a.rel > -2 AND a.rel < 3 THEN 0 ELSE log2(a.f / b.f) END AS lr, a.f FROM q a JOIN q b ON a.rel = b.rel AND a.flank = b.flank AND b.conc = 0 WHERE a.conc <> 0)"""


@query("flank_divergence", f"WITH {FLANKED} SELECT conc, rel::INTEGER AS rel, flank, round(lr, 6) + 0.0::DOUBLE AS log_ratio, round(lr * f, 6) + 0.0::DOUBLE AS kl_term FROM kl")
def _(spark, d):
    return rounded(mt.flank_divergence(reads(spark, d), "AUU", 2), "log_ratio", "kl_term")


@query("top_interactors", f"WITH {FLANKED} SELECT flank, round(max(lr * f), 6) AS best FROM kl GROUP BY flank ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return rounded(mt.top_interactors(mt.flank_divergence(reads(spark, d), "AUU", 2)), "best")


@query("cooccurrence_ratio", f"""WITH {COOC}, {EXPECTED} SELECT c.conc, c.kmer_a, c.kmer_b, c.dist::INTEGER AS dist,
round(log2((c.n + 1) / (coalesce(e.expected, 0) + 1)), 6) + 0.0::DOUBLE AS log_expected, round(log2((c.n + 1) / (coalesce(i.n, 0) + 1)::DOUBLE), 6) + 0.0::DOUBLE AS log_input
FROM cooc c LEFT JOIN expected e USING (conc, kmer_a, kmer_b, dist) LEFT JOIN cooc i ON i.conc = 0 AND i.kmer_a = c.kmer_a AND i.kmer_b = c.kmer_b AND i.dist = c.dist WHERE c.conc <> 0""")
def _(spark, d):
    return rounded(mt.cooccurrence_ratios(reads(spark, d), CORES), "log_expected", "log_input")


@query("count_modes", f"WITH {freq(4)} SELECT conc, kmer, c.n AS \"count\", round(f, 6) AS freq, round(f / 256, 9) AS rfreq, round(f / 256 * 1000 * 37, 6) AS nm FROM freq JOIN full_counts c USING (conc, kmer)")
def _(spark, d):
    return rounded(rounded(mt.count_modes(reads(spark, d), 4), "freq", "nm"), "rfreq", digits=9)


@query("accessibility_enrichment", f"""WITH {NEAR}, b AS (SELECT h.conc, greatest(0, least(7, floor(e.e)))::INTEGER AS bin, count(*) AS n FROM h JOIN e ON h.conc = e.conc AND h.read_id = e.read_id AND e.pos = h.at GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY conc)::DOUBLE AS f FROM b) SELECT a.conc, a.bin, round(a.f / i.f, 6) AS ratio FROM s a JOIN s i ON a.bin = i.bin AND i.conc = 0 WHERE a.conc <> 0""")
def _(spark, d):
    return rounded(mt.accessibility_enrichment(folded(spark, d, 3), "GCA"), "ratio")


@query("markov_extrapolation", f"""WITH {READS}, {km(1, name='k1')}, {km(2, True, 'k2')},
f1 AS (SELECT conc, kmer, (count(*) + 10)::DOUBLE AS f FROM k1 GROUP BY ALL), p1 AS (SELECT conc, kmer, f / sum(f) OVER (PARTITION BY conc) AS p FROM f1),
f2 AS (SELECT conc, kmer, (count(*) + 10)::DOUBLE AS f FROM k2 GROUP BY ALL), p2 AS (SELECT conc, kmer, f / sum(f) OVER (PARTITION BY conc, substring(kmer, 1, 1)) AS q FROM f2),
d AS (SELECT a.x || b.x || c.x AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('U')) a(x) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('U')) b(x) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('U')) c(x))
SELECT p1.conc, d.kmer, round(p1.p * s.q * t.q, 6) AS p FROM d JOIN p1 ON p1.kmer = substring(d.kmer, 1, 1) JOIN p2 s ON s.conc = p1.conc AND s.kmer = substring(d.kmer, 1, 2) JOIN p2 t ON t.conc = p1.conc AND t.kmer = substring(d.kmer, 2, 2)""")
def _(spark, d):
    return rounded(mt.extrapolated_frequencies(reads(spark, d), 3), "p")


@query("metric_gather", f"""WITH {r_of(3)}, t AS (SELECT *, sum(n) OVER (PARTITION BY conc)::DOUBLE AS w FROM full_counts),
j AS (SELECT a.conc, a.kmer, a.n, b.n AS n0, a.w, b.w AS w0, a.w / (a.w + b.w) AS p, (a.n + b.n) / (a.w + b.w) AS px FROM t a JOIN t b ON a.kmer = b.kmer AND b.conc = 0 WHERE a.conc <> 0)
SELECT conc, kmer, 'R_value' AS metric, round(r, 6) AS value FROM r UNION ALL
SELECT conc, kmer, 'DI', CASE WHEN n > 0 AND n0 > 0 THEN round(p * log2(n / w / (px * p)) + (1 - p) * log2(n0 / w0 / (px * (1 - p))), 6) + 0.0::DOUBLE END FROM j""")
def _(spark, d):
    return rounded(mt.gather(reads(spark, d), ["R_value", "DI"], 3), "value")


RANKED = f"{r_of(4)}, m AS (SELECT kmer, quantile_cont(r, 0.5) AS median FROM r GROUP BY kmer)"


@query("kmer_ranking", f"WITH {RANKED} SELECT kmer, round(median, 6) AS median, row_number() OVER (ORDER BY round(median, 9) DESC, kmer)::INTEGER AS rank FROM m")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4)
    med = r.groupBy("kmer").agg(F.round(F.percentile("r", F.lit(0.5)), 9).alias("r"))
    return rounded(rk.kmer_ranking(med), "median")


@query("r_z_score", f"WITH {r_of(4)} SELECT conc, kmer, round((r - avg(r) OVER w) / stddev_pop(r) OVER w, 6) + 0.0::DOUBLE AS z FROM r WINDOW w AS (PARTITION BY conc)")
def _(spark, d):
    return rounded(rk.z_scores(mt.r_values(reads(spark, d), 4), "r", "conc").select("conc", "kmer", "z"), "z")


@query("share_within", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang)::DOUBLE, 6) AS share FROM documents GROUP BY lang, source")
def _(spark, d):
    return rounded(rk.share_within(table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), "n", "lang"), "share")


@query("significant_kmers", f"""WITH {r_of(4)}, o AS (SELECT kmer, round(r, 9) AS r, (round(r, 9) - avg(round(r, 9)) OVER ()) / stddev_pop(round(r, 9)) OVER () AS z FROM r WHERE conc = 80), k AS (SELECT *, row_number() OVER (ORDER BY r DESC, kmer) AS rank, count(*) FILTER (WHERE z >= 1.5) OVER () AS c FROM o)
SELECT kmer, round(r, 6) AS r, round(z, 6) AS z, rank::INTEGER AS rank FROM k WHERE rank <= least(100, greatest(10, c))""")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4).where("conc = 80").select("kmer", F.round("r", 9).alias("r"))
    return rounded(rk.significant_kmers(r, "r", 1.5, 10, 100), "r", "z")


@query("sample_ranks", f"WITH {r_of(4)} SELECT conc, round(r, 6) AS r, rank() OVER (ORDER BY round(r, 9) DESC)::INTEGER AS rank FROM r WHERE kmer = 'GCAU' AND r >= 0.5")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4).withColumn("r", F.round("r", 9))
    return rounded(rk.sample_ranks(r, "GCAU", 0.5), "r")


@query("best_samples", f"""WITH {r_of(4)}, b AS (SELECT kmer FROM r GROUP BY kmer ORDER BY round(max(r), 9) DESC, kmer LIMIT 1), s AS (SELECT r.*, row_number() OVER (ORDER BY round(r, 9) DESC, conc) AS rank FROM r JOIN b USING (kmer))
SELECT conc, kmer, round(r, 6) AS r, rank::INTEGER AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM s WHERE r >= 1.1) OR (r >= 1.1 AND rank IN (1, 2, 3))""")
def _(spark, d):
    return rounded(rk.best_samples(mt.r_values(reads(spark, d), 4).withColumn("r", F.round("r", 9))), "r")


@query("diagnostic_kmers", f"""WITH {r_of(4)}, b AS (SELECT DISTINCT arg_max(kmer, (round(r, 9), kmer)) AS kmer FROM r GROUP BY conc)
SELECT kmer, round(min(r) * avg((r > 1)::INTEGER), 6) AS score FROM r JOIN b USING (kmer) GROUP BY kmer""")
def _(spark, d):
    return rounded(rk.diagnostic_kmers(mt.r_values(reads(spark, d), 4).withColumn("r", F.round("r", 9))), "score")


@query("until_insignificant", f"""WITH {r_of(4)}, s AS (SELECT kmer, round(avg(r), 9) AS r, round(stddev_pop(r), 9) AS err FROM r GROUP BY kmer), k AS (SELECT *, row_number() OVER (ORDER BY r DESC, kmer) AS rank FROM s),
e AS (SELECT *, min(CASE WHEN r - err <= 1 AND rank > 10 THEN rank END) OVER () AS stop FROM k) SELECT kmer, round(r, 6) AS r, round(err, 6) AS err, rank::INTEGER AS rank FROM e WHERE stop IS NULL OR rank < stop""")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4).groupBy("kmer").agg(F.round(F.avg("r"), 9).alias("r"), F.round(F.stddev_pop("r"), 9).alias("err"))
    return rounded(rk.until_insignificant(r), "r", "err")


@query("corrected_r", f"""WITH {r_of(4)}, m AS (SELECT kmer, avg(r) AS m FROM r GROUP BY kmer), q AS (SELECT *, quantile_cont(m, 0.05) OVER () AS ns FROM m) SELECT kmer, round(m + ns * (m - 1) / (1 - ns), 6) AS r FROM q""")
def _(spark, d):
    return rounded(sd.corrected_r(mt.r_values(reads(spark, d), 4)), "r")


@query("top_kmers", f"WITH {READS}, {km(6, True)} SELECT kmer, count(*) AS n FROM km GROUP BY kmer ORDER BY n DESC, kmer LIMIT 25")
def _(spark, d):
    return rk.top(kc.kmer_counts(reads(spark, d), 6).groupBy("kmer").agg(F.sum("n").alias("n")), 25, "n", "kmer")


@query("capped_per_group", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def _(spark, d):
    return rk.capped(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 3, ["o_custkey"], ["o_orderkey"])


HISTORY = "h AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t, o_totalprice::DOUBLE AS error FROM orders)"


def history(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(w).cast("long").alias("t"), F.col("o_totalprice").cast("double").alias("error"))


@query("convergence", f"WITH {HISTORY} SELECT run, t, round(error, 4) AS error, round(error - lag(error) OVER w, 4) + 0.0::DOUBLE AS change, round(CASE WHEN t > 1 THEN regr_slope(error, t) OVER (PARTITION BY run ORDER BY t ROWS 4 PRECEDING) END, 4) + 0.0::DOUBLE AS slope FROM h WINDOW w AS (PARTITION BY run ORDER BY t)")
def _(spark, d):
    return rounded(rk.convergence(history(spark, d), 5), "error", "change", "slope", digits=4)


@query("forward_fill", f"WITH {HISTORY}, s AS (SELECT run, t, CASE WHEN t % 3 = 1 THEN error END AS e FROM h) SELECT run, t, round(last_value(e IGNORE NULLS) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING), 4) AS error FROM s")
def _(spark, d):
    return rounded(rk.forward_filled(history(spark, d).withColumn("error", F.when(F.col("t") % 3 == 1, F.col("error"))), "error"), "error", digits=4)


@query("log_changes", f"WITH {HISTORY} SELECT run, t, round(abs(log10(error / lag(error) OVER (PARTITION BY run ORDER BY t))), 6) AS change FROM h")
def _(spark, d):
    return rounded(rk.log_changes(history(spark, d).withColumn("name", F.lit("error")), "error").select("run", "t", "change"), "change")


@query("near_best", f"WITH {HISTORY}, m AS (SELECT *, min(error) OVER (PARTITION BY run) AS least FROM h) SELECT run, t, round(error, 4) AS error FROM m WHERE error <= least * 1.05")
def _(spark, d):
    return rounded(rk.near_best(history(spark, d)), "error", digits=4)


@query("parameter_uncertainty", f"WITH {HISTORY}, m AS (SELECT run % 7 AS run, error FROM h), l AS (SELECT *, min(error) OVER (PARTITION BY run) AS least FROM m) SELECT run, 0 AS idx, count(*) AS n, round(quantile_cont(error, 0.25), 4) AS q25, round(quantile_cont(error, 0.5), 4) AS q50, round(quantile_cont(error, 0.75), 4) AS q75 FROM l WHERE error <= least * 50 GROUP BY run HAVING count(*) >= 10")
def _(spark, d):
    h = history(spark, d).select((F.col("run") % 7).alias("run"), F.lit(0).alias("idx"), "error", F.col("error").alias("value"))
    return rounded(rk.uncertainty(h, 50.0), "q25", "q50", "q75", digits=4)


@query("cumulative_curve", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING) / sum(o_totalprice) OVER ()::DOUBLE, 6) AS cum FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("x"))
    return rounded(rk.cumulative_curve(o, "x", "x").select("o_orderkey", "cum"), "cum")


@query("smoothed_track", f"""WITH {HISTORY}, n AS (SELECT *, lag(error) OVER w AS a, lead(error) OVER w AS b FROM h WINDOW w AS (PARTITION BY run ORDER BY t))
SELECT run, t, round((error + coalesce(a, 0) * exp(-0.5::DOUBLE) + coalesce(b, 0) * exp(-0.5::DOUBLE)) / (1 + CASE WHEN a IS NULL THEN 0 ELSE exp(-0.5::DOUBLE) END + CASE WHEN b IS NULL THEN 0 ELSE exp(-0.5::DOUBLE) END), 4) AS smooth FROM n""")
def _(spark, d):
    return rounded(rk.smoothed(history(spark, d), "t", "error", 1.0, 1, "run").select("run", "t", "smooth"), "smooth", digits=4)


@query("most_variable", "SELECT o_custkey AS item, round(stddev_pop(o_totalprice::DOUBLE), 3) AS sd FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return rounded(rk.most_variable(table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_totalprice").cast("double").alias("x")), "item", "x"), "sd", digits=3)


@query("run_summary", f"WITH {HISTORY} SELECT run, round(arg_min(error, t), 4) AS first_error, round(arg_max(error, t), 4) AS last_error, max(t) AS steps FROM h GROUP BY run")
def _(spark, d):
    return rounded(tb.run_summary(history(spark, d)), "first_error", "last_error", digits=4)


@query("last_states", "SELECT o_custkey AS stage, arg_max(o_orderstatus, o_orderkey) AS state, bool_or(o_orderstatus = 'COMPLETED') AS completed FROM orders GROUP BY 1")
def _(spark, d):
    return tb.last_states(table(spark, d, "orders").select(F.col("o_custkey").alias("stage"), F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("state")))


@query("greedy_peaks")
def _(spark, d):
    """Non-overlapping accessible places of each read."""
    return pk.greedy_peaks(folded(spark, d, 3).select("read_id", F.col("acc").alias("y")), "read_id", "y", pad=4, least=0.3)


@query("bootstrap_counts", f"WITH {READS}, u AS (SELECT *, {replicate_u(0)} AS u FROM reads), c AS (SELECT conc, CASE WHEN u < exp(-1.0::DOUBLE) THEN 0 WHEN u < exp(-1.0::DOUBLE) * 2 THEN 1 WHEN u < exp(-1.0::DOUBLE) * 2.5 THEN 2 WHEN u < exp(-1.0::DOUBLE) * (2.5 + 1 / 6.0::DOUBLE) THEN 3 ELSE 4 END AS n FROM u) SELECT conc, count(*) FILTER (WHERE n > 0) AS reads, sum(n)::BIGINT AS least_copies FROM c GROUP BY conc")
def _(spark, d):
    rows = sm.bootstrap(reads(spark, d), 1)
    return rows.groupBy("conc").agg(F.count("*").alias("reads"), F.sum(F.least("copies", F.lit(4))).alias("least_copies"))


PSI = "(length(seq) - length(replace(seq, 'U', ''))) / 40.0::DOUBLE"


@query("simulated_pulldown", f"WITH {READS} SELECT c::DOUBLE AS conc, read_id, seq FROM (SELECT read_id, seq, unnest([5, 20]) AS c FROM reads WHERE conc = 0) WHERE {U} <= 1 - (1 - {PSI} * c / 20) * (1 - 0.01::DOUBLE)")
def _(spark, d):
    psi = F.array(*[(F.length("seq") - F.length(F.replace("seq", F.lit("U"), F.lit("")))) / 40.0 * (c / 20) for c in (5, 20)])
    return sm.simulated_pulldown(reads(spark, d).where("conc = 0").withColumn("psi", psi), {5.0: 0.01, 20.0: 0.01})


@query("correlations", f"""WITH {r_of(4)}, p AS (SELECT a.kmer, round(log2(a.r), 9) AS x, round(log2(b.r), 9) AS y FROM r a JOIN r b ON a.kmer = b.kmer AND a.conc = 5 AND b.conc = 80),
k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM k""")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4)
    a = r.where("conc = 5").select("kmer", F.round(F.log2("r"), 9).alias("x"))
    return rounded(ss.correlations(a.join(r.where("conc = 80").select("kmer", F.round(F.log2("r"), 9).alias("y")), "kmer"), "x", "y"), "pearson", "spearman")


@query("sample_correlation", f"WITH {r_of(4)} SELECT a.conc AS conc_a, b.conc AS conc_b, round(corr(a.r, b.r), 6) AS r FROM r a JOIN r b ON a.kmer = b.kmer GROUP BY ALL")
def _(spark, d):
    r = mt.r_values(reads(spark, d), 4)
    a, b = r.select("kmer", F.col("conc").alias("conc_a"), F.col("r").alias("ra")), r.select("kmer", F.col("conc").alias("conc_b"), F.col("r").alias("rb"))
    return rounded(a.join(b, "kmer").groupBy("conc_a", "conc_b").agg(F.corr("ra", "rb").alias("r")), "r")


@query("regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return rounded(rounded(rounded(ss.regression(x, "x", "y", "l_returnflag"), "slope", digits=4), "intercept", digits=3), "r2")


@query("quantiles", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {p}), 3) AS p{int(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lineitem GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("x"))
    return rounded(ss.quantiles(x, "x", "l_returnflag"), "p05", "p25", "p50", "p75", "p95", digits=3)


@query("mann_whitney", """WITH r AS (SELECT o_orderstatus = 'F' AS f, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders),
s AS (SELECT sum(r) FILTER (WHERE f) AS r1, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n0 FROM r)
SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1, n0, round((r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) AS z FROM s""")
def _(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("f"), F.col("o_totalprice").cast("double").alias("x"))
    return rounded(ss.mann_whitney(x, "x", "f"), "z")


@query("t_tests", """WITH x AS (SELECT o_orderstatus = 'F' AS f, o_totalprice::DOUBLE AS x FROM orders), s AS (SELECT avg(x) FILTER (WHERE f) AS m1, avg(x) FILTER (WHERE NOT f) AS m2, var_samp(x) FILTER (WHERE f) / count(*) FILTER (WHERE f) AS v1, var_samp(x) FILTER (WHERE NOT f) / count(*) FILTER (WHERE NOT f) AS v2, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2 FROM x)
SELECT round((m1 - m2) / sqrt(v1 + v2), 6) + 0.0::DOUBLE AS t, round((v1 + v2) ** 2 / (v1 ** 2 / (n1 - 1) + v2 ** 2 / (n2 - 1)), 3) AS df FROM s""")
def _(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("f"), F.col("o_totalprice").cast("double").alias("x"))
    return rounded(rounded(ss.t_welch(x, "x", "f"), "t"), "df", digits=3)


@query("one_sample_t", "SELECT o_orderstatus, round((avg(o_totalprice::DOUBLE) - 150000) / (stddev_samp(o_totalprice::DOUBLE) / sqrt(count(*))), 5) + 0.0::DOUBLE AS t, count(*) - 1 AS df FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(ss.t_one_sample(table(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").cast("double").alias("x")), "x", 150000.0, "o_orderstatus"), "t", digits=5)


@query("sign_counts", f"WITH {HISTORY}, c AS (SELECT run % 10 AS g, error - lag(error) OVER (PARTITION BY run ORDER BY t) AS x FROM h) SELECT g, count(*) FILTER (WHERE x > 0) AS positive, count(*) FILTER (WHERE x < 0) AS negative FROM c GROUP BY g")
def _(spark, d):
    x = rk.convergence(history(spark, d)).select((F.col("run") % 10).alias("g"), F.col("change").alias("x"))
    return ss.sign_counts(x, "x", "g").select("g", F.coalesce("positive", F.lit(0)).alias("positive"), F.coalesce("negative", F.lit(0)).alias("negative"))


@query("value_summary", "SELECT count(*) FILTER (WHERE x > 0) AS positive, count(*) FILTER (WHERE x = 0) AS zero, count(*) FILTER (WHERE x < 0) AS negative, count(*) FILTER (WHERE x IS NULL) AS missing, min(x) AS least, max(x) AS most, round(avg(x), 5) AS mean, round(quantile_cont(x, 0.5), 4) AS median FROM (SELECT c_acctbal::DOUBLE AS x FROM customer)")
def _(spark, d):
    return rounded(rounded(ss.summary(table(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("x")), "x"), "mean", digits=5), "median", digits=4)


@query("grouped_median", "SELECT c_mktsegment, round(quantile_cont(c_acctbal::DOUBLE, 0.5), 4) AS median FROM customer GROUP BY 1")
def _(spark, d):
    rows = ss.quantiles(table(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("x")), "x", "c_mktsegment")
    return rounded(rows.select("c_mktsegment", F.col("p50").alias("median")), "median", digits=4)


@query("energy_conversion", f"SELECT p_partkey, round(ln(p_size * 10 / 1e9::DOUBLE) * {en.rt(22.0)!r}, 6) AS kcal, round(p_size / (p_size + 25.0::DOUBLE), 6) AS occupancy FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("kd"), F.col("p_size").cast("double").alias("p"))
    return rounded(p.select("p_partkey", en.kd_to_energy("kd").alias("kcal"), en.occupancy("p", F.lit(25.0)).alias("occupancy")), "kcal", "occupancy")


@query("oligo_enrichment", """WITH o AS (SELECT l_partkey AS id, count(*) FILTER (WHERE l_returnflag = 'N') AS n_input, count(*) FILTER (WHERE l_returnflag = 'R') AS n_c1 FROM lineitem GROUP BY 1)
SELECT id, round((n_c1 + 1) / (n_input + 1)::DOUBLE * (sum(n_c1) OVER () / sum(n_input) OVER ()::DOUBLE), 6) AS enrichment FROM o""")
def _(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "N").alias("n_input"), F.count_if(F.col("l_returnflag") == "R").alias("n_c1"))
    return rounded(tb.oligo_enrichment(o, "n_c1"), "enrichment")


@query("crosstalk_scores", "WITH s AS (SELECT l_partkey AS q, l_suppkey AS t, sum(l_quantity) AS s FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL) SELECT q AS query, sum(s)::DOUBLE AS total FROM s GROUP BY q HAVING sum(s) > 800")
def _(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("subject"), F.col("l_quantity").cast("double").alias("score"))
    return tb.crosstalk_scores(hits)
