"""BED records and the spliced sequences that they name in a genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq

#: Bases of a genome in one row.
TILE = 1 << 14


def bed_records(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name, score, strand, starts, sizes) of a tab-separated file with 3, 6 or 12 columns.

    starts and sizes are a record's blocks in the genome, from left to right; one block for records without. Header and
    comment lines, and lines without an interval, are left out. A strand other than - counts as +.
    """
    c = F.split("value", "\t")
    start, end = F.get(c, F.lit(1)).try_cast("long"), F.get(c, F.lit(2)).try_cast("long")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser)"))
    numbers = lambda i: F.transform(F.filter(F.split(F.get(c, F.lit(i)), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("long"))
    sizes, offsets = numbers(10), numbers(11)
    blocked = (F.size(c) >= 12) & (F.size(sizes) == F.size(offsets)) & (F.size(sizes) > 0)
    rows = lines.select(
        F.get(c, F.lit(0)).alias("chrom"), start.alias("start"), end.alias("end"), F.get(c, F.lit(3)).alias("name"), F.get(c, F.lit(4)).try_cast("double").alias("score"),
        F.when(F.get(c, F.lit(5)) == "-", "-").otherwise("+").alias("strand"),
        F.when(blocked, F.transform(offsets, lambda o: o + start)).otherwise(F.array(start)).alias("starts"),
        F.when(blocked, sizes).otherwise(F.array(end - start)).alias("sizes"),
    )
    return rows.where("start is not null and end is not null and start >= 0 and end > start")


def genome_tiles(genome: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, tile, seq) of genome(chrom, seq): pieces of `tile` bases, the last one of a chromosome shorter."""
    n = F.ceil(F.length("seq") / tile).cast("int")
    cut = F.explode(F.sequence(F.lit(0), n - 1)).alias("tile")
    return genome.where(F.length("seq") > 0).select("chrom", "seq", cut).select("chrom", "tile", F.expr(f"substring(seq, tile * {tile} + 1, {tile})").alias("seq"))


def spliced(records: DataFrame, tiles: DataFrame, tile: int = TILE, rna: bool = True) -> DataFrame:
    """records with seq: their blocks in order, complemented and reversed on the - strand; upper case, with rna U for T.

    Each block meets only the tiles that it lies in. Blocks beyond a chromosome's end are cut there; a record on an
    unknown chromosome has a null seq. Repeated records are repeated. A record's pieces are gathered to one row, which is
    as long as its sequence.
    """
    rows = records.withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.select("_id", "chrom", F.explode(F.arrays_zip(F.col("starts").alias("b"), F.col("sizes").alias("n"))).alias("x")).select("_id", "chrom", F.col("x.b").alias("b"), (F.col("x.b") + F.col("x.n")).alias("e")).where("e > b")
    parts = blocks.withColumn("tile", F.explode(F.sequence(F.floor(F.col("b") / tile).cast("int"), F.floor((F.col("e") - 1) / tile).cast("int"))))
    first = F.greatest(F.col("b"), F.col("tile").cast("long") * tile)
    size = F.least(F.col("e"), (F.col("tile").cast("long") + 1) * tile) - first
    parts = parts.join(tiles, ["chrom", "tile"]).select("_id", first.alias("at"), F.substring("seq", (first - F.col("tile").cast("long") * tile + 1).cast("int"), size.cast("int")).alias("part"))
    whole = parts.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("_seq"))
    seq = F.upper("_seq")
    dna = F.translate(seq, "U", "T")
    back = F.reverse(F.translate(dna, "ACGTRYKMBVDH", "TGCAYRMKVBHD"))
    stranded = F.when(F.col("strand") == "-", back).otherwise(dna)
    return rows.join(whole, "_id", "left").withColumn("seq", F.translate(stranded, "T", "U") if rna else stranded).drop("_id", "_seq")


def genomic_place(at: Column, strand: Column | str = "strand", starts: Column | str = "starts", sizes: Column | str = "sizes") -> Column:
    """Place in the genome of a base of the spliced sequence, both from 0; null beyond its end."""
    strand, starts, sizes = sq.col(strand), sq.col(starts), sq.col(sizes)
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    forward = F.when(strand == "-", total - 1 - at).otherwise(at).cast("long")
    state = F.struct(forward.alias("left"), F.lit(None).cast("long").alias("place"))

    def step(s: Column, b: Column) -> Column:
        inside = s["place"].isNull() & (s["left"] >= 0) & (s["left"] < b["sizes"])
        return F.struct((s["left"] - b["sizes"]).alias("left"), F.when(inside, b["starts"] + s["left"]).otherwise(s["place"]).alias("place"))

    return F.aggregate(F.arrays_zip(starts.alias("starts"), sizes.alias("sizes")), state, step)["place"]


def best_hits(records: DataFrame, motif_sites) -> DataFrame:
    """(chrom, start, end, name, best, strand, total, share) of each spliced record: the genomic place of its best site, by motif_sites(seq), an array of the weights of a motif's windows, and `width` of them.

    Records without a site are left out; of equal sites the first counts.
    """
    weights, width = motif_sites
    z = weights(F.col("seq"))
    rows = records.withColumn("_z", z).where(F.size("_z") > 0)
    rows = rows.select("*", F.array_max("_z").alias("best"), (F.array_position("_z", F.array_max("_z")) - 1).cast("long").alias("_at"), F.aggregate("_z", F.lit(0.0), lambda s, x: s + x).alias("total"))
    a, b = genomic_place(F.col("_at")), genomic_place(F.col("_at") + width - 1)
    return rows.select("chrom", F.least(a, b).alias("start"), (F.greatest(a, b) + 1).alias("end"), "name", "best", "strand", "total", (F.col("best") / F.col("total")).alias("share"))
