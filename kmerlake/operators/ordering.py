"""Ranks, running sums and exact quantiles of a column by ranges of its values: no task holds a whole table, ties stay together.

Rows are first added up by value, so a value that many rows share is one row. Values are dealt to ranges by approximate
quantiles; a range's share of what lies below is a prefix sum over the ranges, of which there are RANGES at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.operators.binning import digitised
from kmerlake.sources.shared import cut

#: Ranges of values worked on apart from each other.
RANGES = 256
#: Error of the shares at which ranges are cut; it moves their sizes, never a result.
SHARE_ERROR = 1 / 1024


def below(df: DataFrame, x: str, *within: str, **sums: Column) -> DataFrame:
    """(within, x, n, n_below, and for each of sums its total and total_below) of each value of x: rows with it and with a lesser one. Null x and NaN are left out."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    names = ["n", *sums]
    values = cut(rows.groupBy(*within, x).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]))
    cuts = values.select(F.col(x).cast("double").alias("_x")).approxQuantile("_x", [i / RANGES for i in range(1, RANGES)], SHARE_ERROR)
    values = digitised(values.withColumn("_x", F.col(x).cast("double")), "_x", cuts, "_range").drop("_x") if cuts else values.withColumn("_range", F.lit(0))
    ahead = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    ranges = values.groupBy(*within, "_range").agg(*[F.sum(c).alias(c) for c in names])
    ranges = ranges.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_range").alias("_r"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in names])
    own = Window.partitionBy(*within, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    values = values.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_own_{c}") for c in names])
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    joined = values.join(F.broadcast(ranges) if not within else ranges, same)
    return joined.select(*within, x, *[e for c in names for e in (F.col(c), (F.col(f"_{c}") + F.col(f"_own_{c}")).alias(f"{c}_below"))])


def ranked(df: DataFrame, x: str, out: str, *within: str) -> DataFrame:
    """Adds the rank of x from 1, ties at their mean; null where x is null."""
    ranks = below(df, x, *within).select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col(x).alias("_x"), (F.col("n_below") + (F.col("n") + 1) / 2).alias(out))
    same = F.col(x) == F.col("_x")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return df.join(ranks, same, "left").drop("_x", *[f"_w{i}" for i in range(len(within))])


def exact_quantiles(df: DataFrame, x: str, shares: list[float], *within: str) -> DataFrame:
    """(within, share, value): quantiles between the two values around them, as percentile() gives, from counts by value."""
    values = cut(below(df, x, *within))
    totals = values.groupBy(*within).agg(F.sum("n").alias("_n"))
    wanted = totals.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_at", (F.col("_n") - 1) * F.col("share"))
    ends = wanted.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], "share", "_at", F.explode(F.array(F.floor("_at"), F.floor("_at") + 1)).alias("_place"))
    same = (F.col("n_below") <= F.col("_place")) & (F.col("_place") < F.col("n_below") + F.col("n"))
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    found = values.join(ends if within else F.broadcast(ends), same)  # two places a share
    low = F.max(F.when(F.col("_place") == F.floor("_at"), F.col(x).cast("double")))
    high = F.max(F.when(F.col("_place") == F.floor("_at") + 1, F.col(x).cast("double")))
    part = F.first("_at") - F.floor(F.first("_at"))
    return found.groupBy(*within, "share").agg((F.when(part > 0, low + (high - low) * part).otherwise(low)).alias("value"))


def numbered_rows(df: DataFrame, out: str, *order: str) -> tuple[DataFrame, int]:
    """(df with the place of each row, from 0, in the order of the columns, number of rows). Rows alike in all of these stand in any order, and may be dealt to several ranges."""
    sorted_ = cut(df.withColumn("_salt", F.rand(1)).repartitionByRange(*order, "_salt").sortWithinPartitions(*order).drop("_salt"))
    rows = sorted_.withColumn("_at", F.monotonically_increasing_id())  # range << 33, then the place in the range
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # a row a range
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    if not total:
        return df.withColumn(out, F.lit(0).cast("long")), 0
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_p long, _before long"))
    rows = rows.join(starts, F.shiftright("_at", 33) == F.col("_p"))
    return rows.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_before"), total


def equal_frequency(df: DataFrame, x: str, bins: int, *ties: str) -> DataFrame:
    """Adds bin: 1 to `bins`, of equal numbers of rows in order of x, the first ones a row larger where they cannot be equal."""
    rows, n = numbered_rows(df, "_place", x, *ties)
    size, large = n // bins, n % bins
    edge = large * (size + 1)
    at = F.col("_place")
    return rows.withColumn("bin", (F.when(at < edge, F.floor(at / (size + 1))).otherwise(large + F.floor((at - edge) / max(1, size))) + 1).cast("int")).drop("_place")


def information(joint: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Bits of a joint table of counts, one added to each, against the product of the shares x and y."""
    p = (joint + 1.0) / (joint + 1.0).sum()
    return float((p * np.log2(p / np.outer(x, y))).sum())


def mutual_information_test(df: DataFrame, x: str, y: str, bins: int = 10, replicates: int = 100, seed: int = 0) -> DataFrame:
    """(n, mi, null_mean, null_sd, z, p): bits that bins of equal frequency of x tell of those of y, against dealing out the values of x anew.

    Values go to bins by the rows below them, so ties stay together. A random order of x leaves both margins of the
    joint table as they are and makes each table as likely as the orders that give it; so the replicates' tables are
    drawn by that law, a row of the table after another, from the bins x bins counts, without touching the rows again.
    p is the upper tail of a normal deviate. Rows with a null are left out; z and p are null if the replicates do not vary.
    """
    spark = df.sparkSession
    rows = df.select(F.col(x).cast("double").alias("_vx"), F.col(y).cast("double").alias("_vy")).where("_vx is not null and _vy is not null and not isnan(_vx) and not isnan(_vy)")
    n = rows.count()
    kind = "n long, mi double, null_mean double, null_sd double, z double, p double"
    if not n:
        return spark.createDataFrame([], kind)
    for own in ("_vx", "_vy"):
        at = below(rows, own).select(F.col(own).alias("_v"), F.least(F.lit(bins - 1), F.floor(F.col("n_below") * bins / n)).cast("int").alias(f"{own}b"))
        rows = rows.join(at, F.col(own) == F.col("_v")).drop("_v")
    joint = np.zeros((bins, bins), np.int64)
    for r in rows.groupBy("_vxb", "_vyb").agg(F.count("*").alias("n")).collect():  # bins x bins
        joint[r["_vxb"], r["_vyb"]] = r["n"]
    use = (joint.sum(axis=1) > 0), (joint.sum(axis=0) > 0)
    joint = joint[use[0]][:, use[1]]
    rx, ry = joint.sum(axis=1), joint.sum(axis=0)
    seen = information(joint, rx / n, ry / n)
    draws, null = np.random.default_rng(seed), []
    for _ in range(replicates):
        left, table = ry.copy(), []
        for size in rx:
            table.append(draws.multivariate_hypergeometric(left, size, method="marginals"))
            left = left - table[-1]
        null.append(information(np.array(table), rx / n, ry / n))
    mean, sd = float(np.mean(null)), float(np.std(null))
    z = (seen - mean) / sd if sd > 0 else None
    return spark.createDataFrame([(n, seen, mean, sd, z, None if z is None else math.erfc(z / math.sqrt(2)) / 2)], kind)
