"""Incremental k-mer counts by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kmerlake.functions import sequence as sq


def stream_reads(spark: SparkSession, folder: str) -> DataFrame:
    """(conc, seq) of files named <name>_<conc or input>.reads as they arrive."""
    lines = spark.readStream.text(folder, pathGlobFilter="*.reads")
    tag = F.regexp_extract(F.input_file_name(), r"_([0-9.]+|input)\.reads$", 1)
    conc = F.when(tag == "input", 0.0).otherwise(tag.try_cast("double"))
    return lines.select(conc.alias("conc"), sq.normalised(F.trim("value")).alias("seq")).where(F.col("seq").rlike("^[ACGU]+$"))


def stream_counts(reads: DataFrame, k: int, pad: bool = True) -> DataFrame:
    """(conc, kmer, n), updated with every batch; the state holds a row for each sample and k-mer."""
    seq = sq.padded("seq", k) if pad else F.col("seq")
    return reads.select("conc", F.explode(sq.kmers(seq, k)).alias("kmer")).groupBy("conc", "kmer").agg(F.count("*").alias("n"))


def start_counts(spark: SparkSession, folder: str, checkpoint: str, table: str, k: int) -> StreamingQuery:
    """Counts of all files in the folder so far, in the memory table; ends when there is nothing new."""
    return stream_counts(stream_reads(spark, folder), k).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
