"""Read libraries from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq) of a file with one read a line; read_id follows the order of the lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("read_id"), F.trim("value").alias("seq")).where("seq <> ''")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of FASTA records over any number of lines; lines that begin with # are skipped."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\r?\n")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: ~F.startswith(x, F.lit("#")))
    return rows.where(~F.startswith("value", F.lit("#"))).select(F.trim(lines[0]).alias("name"), F.array_join(F.transform(body, lambda x: F.trim(x)), "").alias("seq"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of four-line FASTQ records."""
    rows = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split("value", "\r?\n")
    return rows.where(F.size(lines) > 1).select(F.regexp_replace(lines[0], "^@", "").alias("name"), F.trim(lines[1]).alias("seq"))


FORMATS = {"raw": raw_lines, "fasta": fasta, "fastq": fastq}


def valid_reads(rows: DataFrame, length: int | None = None, most: int | None = None) -> DataFrame:
    """Reads as upper-case ACGU of one length: longer ones are cut to it, shorter ones and those with another letter go.

    length defaults to that of the first read by read_id; most keeps the first valid ones by read_id.
    """
    if length is None:
        first = rows.orderBy("read_id").select(F.length("seq").alias("n")).first()
        length = first["n"] if first else 0
    out = rows.where(F.length("seq") >= length).withColumn("seq", sq.normalised(F.substring("seq", 1, length))).where(F.col("seq").rlike("^[ACGU]+$"))
    return out.orderBy("read_id").limit(most) if most else out


def read_library(spark: SparkSession, path: str, conc: float, kind: str = "raw", **kw) -> DataFrame:
    """(conc, read_id, seq)."""
    rows = FORMATS[kind](spark, path)
    rows = rows if "read_id" in rows.columns else rows.withColumn("read_id", F.monotonically_increasing_id())
    return valid_reads(rows, **kw).select(F.lit(float(conc)).alias("conc"), "read_id", "seq")


def from_sequences(spark: SparkSession, seqs: list[str], conc: float = 0.0) -> DataFrame:
    return spark.createDataFrame([(float(conc), i, s.upper().replace("T", "U")) for i, s in enumerate(seqs)], "conc double, read_id long, seq string")


def dimensions(reads: DataFrame) -> DataFrame:
    """(conc, reads, length)."""
    return reads.groupBy("conc").agg(F.count("*").alias("reads"), F.max(F.length("seq")).alias("length"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, conc) of the experiment with most files named <name>_<conc or input>.<reads or txt>, by concentration; input is 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{reads,txt}").load(folder).select("path")
    pattern = r"([^/]+)_([0-9.]+|input)(?:nM)?\.(?:reads|txt)$"
    rows = files.where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).alias("name"), F.regexp_extract("path", pattern, 2).alias("_c"))
    rows = rows.withColumn("conc", F.when(F.col("_c") == "input", 0.0).otherwise(F.col("_c").cast("double"))).drop("_c")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("name")))
    best = rows.agg(F.max_by("name", F.struct("_n", "name")).alias("best"))
    return rows.join(F.broadcast(best), F.col("name") == F.col("best")).select("path", "name", "conc").orderBy("conc")


def write_sequences(reads: DataFrame, path: str) -> None:
    reads.select("seq").write.mode("overwrite").text(path)


def pure_read_records(reads: DataFrame, kmers: list[str], per_kmer: int) -> DataFrame:
    """(kmer, ordinal, record): FASTA records of the first reads by read_id that hold each k-mer and no other of the list."""
    k = len(kmers[0])
    own = F.array_intersect(F.array_distinct(sq.kmers("seq", k)), F.array(*map(F.lit, kmers)))
    rows = reads.withColumn("_own", own).where(F.size("_own") == 1).withColumn("kmer", F.col("_own")[0])
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("kmer").orderBy("conc", "read_id"))).where(F.col("ordinal") <= per_kmer)
    head = F.format_string(">%s r=%d n=%d", "kmer", "read_id", "ordinal")
    return rows.select("kmer", "ordinal", F.concat(head, F.lit("\n"), F.col("seq")).alias("record"))
