"""Mixing sources to target weights: Efraimidis-Spirakis keys, sorted within each source and prefix-summed to word budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import cut, documents, plain_names, sized

WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
MOST = 3
#: Rows of a source that share a key bucket, about; only one bucket of each source is sorted.
BUCKET_ROWS = 10_000
#: Bytes of a source's row in the tables of sources, which are broadcast while they are small.
SOURCE_BYTES = 200


def words_in(text: "F.Column") -> "F.Column":
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: "F.Column") -> "F.Column":
    """Share of ASCII white space, letters and sentence marks, and of all characters above ASCII; at least 0.01."""
    junk = F.length(F.regexp_replace(text, r"[a-zA-Z \t\n\r.,;:'?()\x{80}-\x{10FFFF}-]+", ""))
    return F.greatest(F.lit(0.01), F.coalesce(1 - junk / F.greatest(F.length(text), F.lit(1)), F.lit(1.0)))


def unit_hash(*cols) -> "F.Column":
    """A reproducible uniform in (0, 1): the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) -> adds target: shares of the whole by weight, capped at `most` times the size, the excess reshared by weight until none is above.

    In order of cap over weight, a source is full where its cap is within its share of what the sources before it
    left. Sources are ordered by code point, null last, and take the weights in turn. One row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        sizes.withColumn("weight", turn)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("whole", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("level", (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level"))).over(Window.partitionBy())["level"])
    )
    return w.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs.

    A source gives floor(target / size) complete epochs of all its documents; the rest of its target is met by
    documents in ascending order of -ln(u) / w, u a hash of the id and w the quality weight, as long as their sum stays
    within it, and by one more of the last key bucket whose size comes nearest to the gap, if that narrows it. Documents
    are taken whole. Null texts have size 0 and are taken 0 words; a source without words has target 0.
    Rows that repeat a document in full tie and are interchangeable. An empty table gives an empty result.

    Keys are cut into buckets by value; bucket sums find the bucket in which each source's sum ends, and only that
    one is sorted, so a source of any size is neither gathered nor sorted whole.
    """
    return _mix(docs, id_col, text_col, source_col, seed, weights, most)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carried: tuple[str, ...] = ()) -> DataFrame:
    """mix(), with the carried columns of docs added to each row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), *carried)
    u = unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.coalesce("text", F.lit("")))), F.lit(seed))
    keyed = cut(base.select("doc_id", "source", words_in(F.col("text")).alias("size"), (-F.log(u) / quality_weight(F.col("text"))).alias("key"), *carried))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sizes.select("source", "source_size"), weights, most).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = cut(
        plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    )
    # Whatever the weights, at most 37 % of a source's keys are expected within a factor of e, so a bucket holds fewer than BUCKET_ROWS.
    bucket = F.floor(F.log("key") * F.col("buckets"))
    joined = keyed.join(sized(plan.withColumnRenamed("source", "s"), SOURCE_BYTES), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket)
    sums = joined.groupBy("source", "part", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .where((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("last"), "before")
    )
    placed = joined.join(sized(cut(ends), SOURCE_BYTES), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    done = placed.where(F.col("last").isNull() | (F.col("bucket") != F.col("last"))).withColumn("extra", F.when(F.col("bucket") < F.col("last"), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    split = (
        placed.where(F.col("bucket") == F.col("last"))
        .withColumn("sum", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("gap", F.col("part") - F.max(F.when(F.col("sum") <= F.col("part"), F.col("sum")).otherwise(F.col("before"))).over(Window.partitionBy("source")))
        .withColumn("off", F.when((F.col("sum") > F.col("part")) & (F.col("size") > 0), F.abs(F.col("gap") - F.col("size"))))
        .withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("off"), "key", "doc_id", "size")))
        .withColumn("extra", ((F.col("sum") <= F.col("part")) | ((F.col("rank") == 1) & (F.col("off") < F.col("gap")))).cast("int"))
        .drop("sum", "gap", "off", "rank")
    )
    return (
        done.unionByName(split)
        .withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried)
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """docs, all columns, each row as often as mix() takes it; rows taken no times go.

    Rows are found again by 128 bits of hash of id, source and text. Rows that repeat a document in full share them;
    where mix() takes some of these once more than the others, they are numbered, by all of their columns. Any other
    columns may have any names; an empty table gives an empty table.
    """
    inner, name = plain_names(docs)
    return _mixed(inner, name[id_col], name[text_col], name[source_col], seed).toDF(*docs.columns)


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    same = [x for c in (id_col, source_col, text_col) for x in (F.col(c).isNull(), F.col(c))]
    marked = docs.withColumns({"_hash": F.xxhash64(*same), "_hash2": F.xxhash64(F.lit(1), *same)})
    decided = _mix(marked, id_col, text_col, source_col, seed, carried=("_hash", "_hash2"))
    # rows of one hash are equal in source and size, so their copies differ by one at most
    taken = cut(
        decided.groupBy("_hash", "_hash2")
        .agg(F.min("copies").cast("int").alias("_copies"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("_more"))
        .where("_copies > 0 or _more > 0")
    )
    found = marked.join(sized(taken.where("_more = 0").drop("_more"), 32), ["_hash", "_hash2"])
    uneven = taken.where("_more > 0")
    if uneven.limit(1).count():
        order = Window.partitionBy("_hash", "_hash2").orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
        numbered = marked.join(sized(uneven, 32), ["_hash", "_hash2"]).withColumn("_copies", F.col("_copies") + (F.row_number().over(order) <= F.col("_more")).cast("int"))
        found = found.unionByName(numbered.where("_copies > 0").select(*found.columns))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(doc_id::VARCHAR || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(0.01, coalesce(1 - length(regexp_replace(text, '[a-zA-Z \t\n\r.,;:''?()\x{80}-\x{10FFFF}-]+', '', 'g')) / greatest(length(text), 1), 1.0)) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight,
    (source_size * 3)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS whole FROM s),
l AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source::BLOB)),
t AS (
  SELECT *, CASE WHEN cap <= level * weight THEN cap
    ELSE least(cap, arg_min(level, cap / weight) FILTER (WHERE cap > level * weight) OVER () * weight) END AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs, ceil(n / 10000) AS buckets FROM t),
j AS (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS part, floor(ln(key) * buckets) AS bucket
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bucket, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS through FROM j),
b AS (
  SELECT *, max(CASE WHEN through <= part THEN through ELSE 0 END) OVER (PARTITION BY source) AS got,
    min(CASE WHEN through > part THEN bucket END) OVER (PARTITION BY source) AS last FROM c),
g AS (
  SELECT *, CASE WHEN through > part AND size > 0 AND bucket = last THEN abs(part - got - size) END AS off FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off NULLS LAST, key, doc_id, size) AS rank FROM g)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN (epochs + (through <= part OR (rank = 1 AND off IS NOT NULL AND off < part - got))::INTEGER) * size ELSE 0 END::BIGINT AS taken
FROM r
"""
