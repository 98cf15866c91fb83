"""SpotSigs document fingerprints: chains of content words that follow common-word anchors. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import documents
from kmerlake.llm.setjoin import similar_pairs

# The common words that anchor signatures (English, German, French, Spanish).
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il la le les leur mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no o para pero por que se sin sobre su sus también un una y ya"
).split()
#: Content words of a chain.
CHAIN = 2
#: Documents of one order bucket, about.
BUCKET_ROWS = 20_000
#: The table with a row for each bucket is broadcast up to this many rows (24 bytes each).
BROADCAST_ROWS = 1_000_000


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: the sorted distinct signatures of the text column, each `CHAIN` content words after an anchor.

    Words are lower-cased runs of letters and digits. A text without a chain has its whole word sequence as its only
    signature, so texts with other words differ; null counts as empty.
    """
    words, kinds, content = f"_{out}_words", f"_{out}_kinds", f"_{out}_content"
    df = df.withColumn(words, F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " "))
    df = df.withColumn(kinds, F.transform(words, lambda w: w.isin(*sorted(set(ANCHORS)))))
    df = df.withColumn(
        content,
        F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(F.col(kinds), i).alias("anchor"), F.coalesce(F.get(F.col(kinds), i - 1), F.lit(False)).alias("after"))),
            lambda x: ~x["anchor"],
        ),
    )
    df = df.withColumn(
        out,
        F.array_sort(F.array_distinct(F.filter(
            F.transform(content, lambda x, i: F.when(x["after"], F.concat(x["w"], *[y for k in range(1, CHAIN) for y in (F.lit(" "), F.get(F.col(content), i + k)["w"])]))),
            lambda s: s.isNotNull(),
        ))),
    )
    df = df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.concat(F.lit("="), F.array_join(words, " ")))))
    return df.drop(words, kinds, content)


def digest(signatures: "F.Column") -> "F.Column":
    return F.md5(F.array_join(signatures, "|").cast("binary"))


def likeness(a: str, b: str) -> "F.Column":
    """Jaccard index of two signature sets; sets whose lengths alone rule out any overlap bound above 0 are still exact."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, signatures) for every row. Equal texts have equal fingerprints."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_signatures(df, "text", "signatures").select("doc_id", digest(F.col("signatures")).alias("fingerprint"), "signatures")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs(a, b, similarity) of fingerprints whose Jaccard index is at least `least`, and members(fingerprint, doc_id).

    Fingerprints are partitioned by set length and pruned by prefix, position and length before they are compared.
    Equal fingerprints are one class and are not expanded into pairs.
    """
    found = fingerprints(docs, id_col, text_col)
    sets = found.groupBy("fingerprint").agg(F.first("signatures").alias("signatures")).select(F.col("fingerprint").alias("id"), F.transform("signatures", lambda s: F.xxhash64(s)).alias("tokens"))
    return similar_pairs(sets, least), found.select("fingerprint", "doc_id")


def with_next(docs: DataFrame, rows: int = BUCKET_ROWS) -> tuple[DataFrame, "Window", str]:
    """docs(doc_id, text) dealt into buckets of neighbouring ids, each with the first row of the following bucket as an `extra` row.

    Returns the rows, the window in which lead() gives the next row in descending order of the id (after the last:
    the first), and the name of the flag of the rows to drop in the end. Null ids come last, rows of one id in the
    order of their texts' hash.
    """
    n = docs.count()
    k = max(1, -(-n // rows))
    ids = docs.select(F.col("doc_id").cast("double").alias("_at"))
    cuts = sorted(set(ids.where("_at is not null").stat.approxQuantile("_at", [i / k for i in range(1, k)], 0.2 / k))) if k > 1 else []
    lead = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_bucket", handleInvalid="keep") if cuts else None

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("_at", F.col("doc_id").cast("double"))
        df = lead.transform(df) if lead else df.withColumn("_bucket", F.lit(0.0))
        return df.withColumn("_bucket", F.when(F.col("doc_id").isNull(), -1.0).otherwise(F.col("_bucket"))).drop("_at")

    order = Window.orderBy(F.desc("_bucket"))  # one row for each bucket
    heads = dealt(docs.select("doc_id")).groupBy("_bucket").agg(F.max("doc_id").alias("head"))
    heads = heads.select(
        F.col("head"),
        F.coalesce(F.lag("_bucket").over(order), F.last("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_for"),
    )
    heads = F.broadcast(heads) if k <= BROADCAST_ROWS else heads
    both = dealt(docs).join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("x"))
    other = F.struct(F.col("_for").alias("b"), F.lit(True).alias("x"))
    both = both.withColumn("_place", F.explode(F.when(F.col("_for").isNull(), F.array(own)).otherwise(F.array(own, other))))
    both = both.select("doc_id", "text", F.col("_place.b").alias("_bucket"), F.col("_place.x").alias("_extra"), F.xxhash64("text").alias("_hash"))
    return both, Window.partitionBy("_bucket").orderBy("_extra", F.desc_nulls_last("doc_id"), F.desc("_hash")), "_extra"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document's.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Null texts count as
    empty; the only row of a table follows itself; rows repeated in full are interchangeable and all kept.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, window, extra = with_next(base)
    rows = rows.withColumn("_next", F.lead("text").over(window))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)))
    rows = with_signatures(rows.withColumn("n_chars", n.cast("long")), "text", "_own").withColumn("_next_set", F.lead("_own").over(window))
    rows = with_signatures(rows.where(~F.col(extra)), "_edited", "_other")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("_own")).alias("fingerprint"),
        digest(F.col("_other")).alias("edited_fingerprint"),
        likeness("_own", "_other").alias("near_edited"),
        likeness("_own", "_next_set").alias("near_next"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


_SETS = """
  SELECT doc_id, kind, w,
    list_sort(list_distinct([w2 FOR w2 IN list_transform(list_zip(c, a, c[2:]), lambda x: CASE WHEN x[2] AND x[3] IS NOT NULL THEN x[1] || ' ' || x[3] END) IF w2 IS NOT NULL])) AS s
  FROM (
    SELECT doc_id, kind, w,
      list_transform(list_filter(list_zip(w, k, list_concat([false], k[:-2])), lambda x: NOT x[2]), lambda x: x[1]) AS c,
      list_transform(list_filter(list_zip(w, k, list_concat([false], k[:-2])), lambda x: NOT x[2]), lambda x: x[3]) AS a
    FROM (
      SELECT *, list_transform(w, lambda x: list_contains({anchors}, x)) AS k
      FROM (SELECT doc_id, kind, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM both_texts)))
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM d),
e AS (SELECT doc_id, next_id, n, text, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM n),
both_texts AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
raw_sets AS (""" + _SETS.format(anchors="[" + ", ".join(f"'{a}'" for a in sorted(set(ANCHORS))) + "]") + """),
sets AS (SELECT doc_id, kind, CASE WHEN len(s) > 0 THEN s ELSE ['=' || array_to_string(w, ' ')] END AS s FROM raw_sets)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256,
  md5(array_to_string(o.s, '|')) AS fingerprint, md5(array_to_string(x.s, '|')) AS edited_fingerprint,
  len(list_intersect(o.s, x.s))::DOUBLE / (len(o.s) + len(x.s) - len(list_intersect(o.s, x.s))) AS near_edited,
  len(list_intersect(o.s, y.s))::DOUBLE / (len(o.s) + len(y.s) - len(list_intersect(o.s, y.s))) AS near_next
FROM e JOIN sets o ON o.doc_id = e.doc_id AND o.kind = 0
  JOIN sets x ON x.doc_id = e.doc_id AND x.kind = 1
  JOIN sets y ON y.doc_id = e.next_id AND y.kind = 0
"""
