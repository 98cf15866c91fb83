"""Tables around the reads: k-mer matrices, reference constants, motif files, results and status logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.motifs import Motif, format_motifs, parse_motifs


def kmer_matrix(values: DataFrame, value: str = "value", error: str = "err", concs: list[float] | None = None) -> DataFrame:
    """values(conc, kmer, value, err) -> a row for each k-mer with value and error columns of each concentration, values rounded by their errors."""
    shown = values.withColumn(value, sq.significant(value, error))
    pivot = shown.groupBy("kmer").pivot("conc", concs) if concs else shown.groupBy("kmer").pivot("conc")
    return pivot.agg(F.first(value).alias("value"), F.first(error).alias("err"))


def write_kmer_matrix(values: DataFrame, path: str, ranking: DataFrame | None = None) -> None:
    """Tab-separated, by the ranking (kmer, rank) or the k-mer."""
    wide = kmer_matrix(values)
    wide = wide.join(ranking, "kmer").orderBy("rank").drop("rank") if ranking is not None else wide.orderBy("kmer")
    wide.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in wide.columns]).coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_kmer_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(conc, kmer, value, err) from the wide form; a # before the header is allowed."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = [c for c in wide.columns if c.lstrip("#").strip() != "kmer"]
    key = next(c for c in wide.columns if c.lstrip("#").strip() == "kmer")
    concs = [c.removesuffix("_value") for c in names if c.endswith("_value")]
    rows = F.explode(F.array(*[F.struct(F.lit(float(c.replace("_", "."))).alias("conc"), F.col(f"`{c}_value`").cast("double").alias("value"), F.col(f"`{c}_err`").cast("double").alias("err")) for c in concs]))
    return wide.select(F.col(f"`{key}`").alias("kmer"), rows.alias("x")).select("x.conc", "kmer", "x.value", "x.err").orderBy("kmer", "conc")


def write_kmer_values(values: DataFrame, path: str, *columns: str) -> None:
    """A tab-separated table of k-mers and their values, such as predicted enrichments or inverse dissociation constants, in order of the k-mer. 4**k rows."""
    values.select("kmer", *columns).repartitionByRange(1, "kmer").sortWithinPartitions("kmer").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def counts_matrix(counts: DataFrame, concs: list[float]) -> DataFrame:
    """A row for each k-mer with its count at each concentration."""
    return counts.groupBy("kmer").pivot("conc", concs).agg(F.sum("n"))


def read_motifs(spark: SparkSession, path: str, most: int | None = None, by_affinity: bool = False) -> list[Motif]:
    """Motifs of a small text file."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    return parse_motifs("\n".join(lines), most, by_affinity)


def write_motifs(spark: SparkSession, motifs: list[Motif], path: str, comment: str = "") -> None:
    spark.createDataFrame([(format_motifs(motifs, comment),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def known_constants(spark: SparkSession, path: str) -> DataFrame:
    """(protein, name, seq, kd, kd_err, temp) of a tab-separated reference table; '# alias A B' lines make A another name of B."""
    lines = spark.read.text(path)
    alias = lines.where(F.col("value").rlike(r"^#\s*alias\s")).select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") >= 4).select(F.element_at("w", -2).alias("_from"), F.element_at("w", -1).alias("_to"))
    cells = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 5)
    rows = cells.select(
        F.col("c")[0].alias("protein"), F.col("c")[1].alias("name"), sq.normalised(F.trim(F.col("c")[2])).alias("seq"),
        F.col("c")[3].try_cast("double").alias("kd"), F.col("c")[4].try_cast("double").alias("kd_err"), F.get("c", F.lit(5)).try_cast("double").alias("temp"),
    ).where(F.col("seq").rlike("^[ACGU]+$"))
    return rows.join(F.broadcast(alias), F.col("protein") == F.col("_from"), "left").withColumn("protein", F.coalesce("_to", "protein")).drop("_from", "_to")


def kmer_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(sq.normalised(F.trim("value")).alias("kmer")).where("kmer <> ''")


def reference_counts(alignments: DataFrame, least: int, most: int) -> DataFrame:
    """(ref, n) of alignments(ref, pos) that start within the bounds."""
    return alignments.where(F.col("pos").between(least, most)).groupBy("ref").agg(F.count("*").alias("n"))


def crosstalk_scores(hits: DataFrame, cut: float = 800.0) -> DataFrame:
    """(query, total) above the cut, of hits(query, subject, score), each query's hits on itself left out."""
    return hits.where("query <> subject").groupBy("query", "subject").agg(F.sum("score").alias("score")).groupBy("query").agg(F.sum("score").alias("total")).where(F.col("total") > cut)


def oligo_counts(counts: DataFrame, crosstalk: DataFrame, least_input: int = 100) -> DataFrame:
    """counts(id, n_input, ...) without oligos of crosstalk(query) or few input reads."""
    return counts.where(F.col("n_input") >= least_input).join(crosstalk.select(F.col("query").alias("id")), "id", "left_anti")


def oligo_enrichment(counts: DataFrame, sample: str, pseudo: float = 1.0) -> DataFrame:
    """(id, enrichment): (n + pseudo) / (n_input + pseudo) times the ratio of the samples' totals."""
    whole = counts.agg((F.sum(sample) / F.sum("n_input")).alias("_whole"))
    return counts.crossJoin(F.broadcast(whole)).select("id", ((F.col(sample) + pseudo) / (F.col("n_input") + pseudo) * F.col("_whole")).alias("enrichment"))  # one row


def unpivoted_motifs(wide: DataFrame, proteins: list[str]) -> DataFrame:
    """(protein, kmer, value) of a table with a k-mer and a value column for each protein."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("protein"), F.col(f"{p}_kmer").alias("kmer"), F.col(f"{p}_value").cast("double").alias("value")) for p in proteins]))
    return wide.select(rows.alias("x")).select("x.*").where("kmer is not null")


def significant_in_best(values: DataFrame, z_cut: float = 4.0) -> DataFrame:
    """values(protein, conc, kmer, r): k-mers of z above the cut in the sample of greatest r."""
    top = values.groupBy("protein").agg(F.max_by("conc", "r").alias("conc"))
    w = Window.partitionBy("protein")
    return values.join(F.broadcast(top), ["protein", "conc"]).withColumn("z", (F.col("r") - F.avg("r").over(w)) / F.stddev_pop("r").over(w)).where(F.col("z") > z_cut)


def run_summary(history: DataFrame) -> DataFrame:
    """(run, first_error, last_error, steps) of history(run, t, error)."""
    return history.groupBy("run").agg(F.min_by("error", "t").alias("first_error"), F.max_by("error", "t").alias("last_error"), F.max("t").alias("steps"))


def best_footprint(grid: DataFrame) -> DataFrame:
    """(run, shift, scale, error) of least error."""
    return grid.groupBy("run").agg(F.min_by(F.struct("shift", "scale", "error"), "error").alias("b")).select("run", "b.*")


def last_states(log: DataFrame) -> DataFrame:
    """(stage, state, completed) of log(stage, ts, state)."""
    return log.groupBy("stage").agg(F.max_by("state", "ts").alias("state"), F.bool_or(F.col("state") == "COMPLETED").alias("completed"))


def append_rows(df: DataFrame, path: str, *partitions: str) -> None:
    """History, residuals and logs: rows added to a Parquet table."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def to_json(df: DataFrame, path: str, *drop: str) -> None:
    df.drop(*drop).write.mode("overwrite").json(path)


def cached_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made first if it is not there yet."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
