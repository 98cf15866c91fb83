"""Exact set-similarity join on token sets: rarity order, prefix, length, position and bitmap filters, then the Jaccard index. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table of token counts; its size is fixed whatever the input.
SLOTS = 1 << 18
_BLOCK = 512
#: Tokens of a set beyond which a second word of parity bits is kept.
LONG = 80
_LOW = (1 << 56) - 1


def percent(least: float) -> int:
    return round(least * 100)


def needed(n: "F.Column", pct: int) -> "F.Column":
    """Least number of a set's tokens that a match shares with it."""
    return F.call_function("div", n * pct + 99, F.lit(100)).cast("int")


def rarity(tokens: DataFrame) -> "F.Column":
    """tokens(token long), a row for each occurrence -> an array of SLOTS bytes: how common the tokens of a slot are, five steps to two doublings, rarest first.

    Every row counts. Tokens share a slot by their low bits, so the order is by counts up to
    collisions and is the same everywhere, which is all that the prefix filter needs.
    """
    counts = tokens.groupBy(F.col("token").bitwiseAND(SLOTS - 1).alias("slot")).agg(F.count("*").alias("n"))
    every = tokens.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("n"))
    table = counts.unionByName(every).groupBy("slot").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2(F.col("n") + 1) * 2.5).cast("tinyint")
    blocks = table.groupBy(F.floor(F.col("slot") / _BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("slot", level.alias("v")))).alias("own"))
    blocks = blocks.select("block", F.transform("own", lambda x: x["v"]).alias("own"))
    return blocks.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "own"))), lambda b: b["own"]))).scalar()


def ranked(token: "F.Column", rank: "F.Column") -> "F.Column":
    """A token's hash as a long that sorts by rarity and agrees with the hash in its 56 low bits."""
    return F.shiftleft(F.get(rank, token.bitwiseAND(SLOTS - 1).cast("int")).cast("long"), 56).bitwiseOR(token.bitwiseAND(_LOW))


def prefix_size(n: "F.Column", pct: int) -> "F.Column":
    return n - needed(n, pct) + 1


def parity(tokens: "F.Column", low: int = 16) -> "F.Column":
    """64 parity bits of the tokens: the bits in which two sets differ are at most the tokens that one of them lacks."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, low).bitwiseAND(63).cast("int"))))


def long_parity(tokens: "F.Column", n: "F.Column") -> "F.Column":
    """64 more parity bits where a set is so large that parity() alone tells little."""
    return F.when(n > LONG, parity(tokens, 24)).otherwise(F.lit(0).cast("long"))


def shared(nx: "F.Column", ny: "F.Column", pct: int) -> "F.Column":
    """Least number of tokens that matching sets of these sizes share."""
    return F.call_function("div", (nx + ny) * pct + 99 + pct, F.lit(100 + pct)).cast("int")


def may_match(pct: int, x: str, y: str) -> "F.Column":
    """Length, position and bitmap filters for prefix rows aliased x and y with columns n, i, bits and more. Never false for a match."""
    nx, ny, ix, iy = (F.col(f"{a}.{c}") for c in ("n", "i") for a in (x, y))
    both = shared(nx, ny, pct)
    most = nx + ny - 2 * both
    differ, more = (F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("bits", "more"))
    return (
        (F.least(nx, ny) >= needed(F.greatest(nx, ny), pct))
        & (F.least(nx - ix, ny - iy) >= both)
        & (differ <= most)
        & ((F.least(nx, ny) <= LONG) | (more <= most))
    )


def prefix_rows(sets: DataFrame, pct: int, *keep: str) -> DataFrame:
    """sets(tokens, rank, keep...) -> a row (token, i, n, bits, more, keep...) for each token of a set's prefix; sets that only an equal set can match are left out."""
    n = F.col("n")
    sets = sets.select(*keep, F.size("tokens").alias("n"), F.sort_array(F.transform("tokens", lambda t: ranked(t, F.col("rank")))).alias("tokens"))
    sets = sets.where((n >= F.lit(1)) & (F.ceil(n * 100 / pct) > n) | (needed(n, pct) < n))
    return sets.select(*keep, "n", parity(F.col("tokens")).alias("bits"), long_parity(F.col("tokens"), n).alias("more"), F.posexplode(F.slice("tokens", F.lit(1), prefix_size(n, pct))).alias("i", "token"))


def verified(pairs: DataFrame, tokens: DataFrame, pct: int, a: str = "a", b: str = "b") -> DataFrame:
    """pairs(a, b, ...) and tokens(id, tokens) -> the pairs whose Jaccard index is at least pct / 100, with `similarity`."""
    ta = tokens.select(F.col("id").alias(a), F.col("tokens").alias("_ta"))
    tb = tokens.select(F.col("id").alias(b), F.col("tokens").alias("_tb"))
    both = F.size(F.array_intersect("_ta", "_tb"))
    return (
        pairs.join(ta, a).join(tb, b)
        .withColumn("_both", both)
        .withColumn("_all", F.size("_ta") + F.size("_tb") - F.col("_both"))
        .where(F.col("_both") * 100 >= F.col("_all") * pct)
        .withColumn("similarity", F.col("_both") / F.col("_all"))
        .drop("_ta", "_tb", "_both", "_all")
    )


def similar_pairs(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """sets(id, tokens array<long>), distinct ids and sets -> (a, b, similarity) with a < b for every two sets whose Jaccard index is at least `least`."""
    pct = percent(least)
    sets = sets.select("id", F.array_distinct("tokens").alias("tokens"))
    rows = prefix_rows(sets.withColumn("rank", rarity(sets.select(F.explode("tokens").alias("token")))), pct, "id")
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & may_match(pct, "x", "y"))
    return verified(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), sets, pct)
