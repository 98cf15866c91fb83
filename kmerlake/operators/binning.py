"""Histograms and bins."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.functions.sequence import col


def linear_bin(x: str | Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0, ends clipped."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((col(x) - low) / ((high - low) / bins)))).cast("int")


def log_bin(x: str | Column, low: float, high: float, bins: int) -> Column:
    """Bin of log10 x; null where x is not positive."""
    return F.when(col(x) > 0, linear_bin(F.log10(col(x)), low, high, bins))


def digitised(df: DataFrame, x: str, bounds: list[float], out: str = "bin") -> DataFrame:
    """Adds the number of bounds at or below x, by binary search."""
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    return Bucketizer(splits=splits, inputCol=x, outputCol=out, handleInvalid="keep").transform(df.withColumn(x, F.col(x).cast("double"))).withColumn(out, F.col(out).cast("int"))


def bin_midpoint(bin_: str | Column, low: float, high: float, bins: int) -> Column:
    """The energy that a bin stands for."""
    step = (high - low) / bins
    return (col(bin_) + 0.5) * step + low


def gamma_bounds(shape: float, scale: float, bins: int) -> list[float]:
    """Inner bounds of bins that hold equal shares of a gamma distribution."""
    return gamma_quantiles(shape, scale, np.arange(1, bins) / bins).tolist()


def gamma_moments(df: DataFrame, x: str, *within: str) -> DataFrame:
    """(shape, scale) of a gamma distribution with the column's mean and variance."""
    return df.groupBy(*within).agg((F.avg(x) ** 2 / F.var_pop(x)).alias("shape"), (F.var_pop(x) / F.avg(x)).alias("scale"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln gamma for x > 0: the recurrence up by eight, then the asymptotic series."""
    y = x + 8.0
    series = np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - sum(1 / (x + i) for i in range(8))


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    series = 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) - 1 / (30 * y**9)
    return series + sum(1 / (x + i) ** 2 for i in range(8))


def gamma_fit(df: DataFrame, x: str, *within: str, steps: int = 30) -> DataFrame:
    """(within, n, shape, scale, shape_err): the gamma distribution of greatest likelihood for a column's positive values.

    Two sums, the log of the mean and the mean of the logs, are all it needs: the shape solves ln a - digamma(a) = their
    difference, by Newton steps. Values that are null or not positive are left out; a group whose values are all equal
    has no such distribution, and nulls for it. shape_err is the standard error at large n.
    """
    sums = df.where(F.col(x) > 0).groupBy(*within).agg(F.count("*").alias("_n"), F.avg(x).alias("_m"), F.avg(F.log(x)).alias("_l")).where("_n > 0")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, mean, log = (batch.column(len(within) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(3))
            s = np.log(mean) - log
            known = s > 1e-14
            s = np.where(known, s, 1.0)
            a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
            for _ in range(steps):  # on 1 / a, in which the function is nearly straight
                a = 1 / (1 / a + (np.log(a) - digamma(a) - s) / (a * a * (1 / a - trigamma(a))))
            err = np.sqrt(a / (n * (a * trigamma(a) - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(within)], batch.column(len(within)), *(pa.array(v, mask=~known) for v in (a, mean / a, err))], names=[*within, "n", "shape", "scale", "shape_err"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*within).schema]
    return sums.mapInArrow(solve, ", ".join([*kinds, "n long, shape double, scale double, shape_err double"]))


def gamma_share(shape: float, x: np.ndarray) -> np.ndarray:
    """Share of a gamma distribution of scale 1 below x > 0: a series below shape + 1, a continued fraction above it."""
    lead = np.exp(shape * np.log(x) - x - lgamma(shape))
    low = x < shape + 1
    term = np.full_like(x, 1 / shape)
    total = term.copy()
    for n in range(1, 2000):
        term = np.where(low, term * x / (shape + n), 0.0)
        total += term
        if (term <= total * 1e-17).all():
            break
    b = np.where(low, shape + 2, x) + 1 - shape  # modified Lentz's method
    c, d = np.full_like(x, 1e300), 1 / b
    h = d.copy()
    for n in range(1, 2000):
        b = b + 2
        an = -n * (n - shape)
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-16).all():
            break
    return np.where(low, total * lead, 1 - h * lead)


def gamma_quantiles(shape: float, scale: float, q: np.ndarray) -> np.ndarray:
    """The values below which shares q, each above 0 and below 1, of a gamma distribution lie: halving on the log of the value."""
    q = np.asarray(q, float)
    low, high = np.full(q.shape, -700.0), np.full(q.shape, np.log(shape + 40 * np.sqrt(shape) + 40))
    for _ in range(70):
        mid = (low + high) / 2
        below = gamma_share(shape, np.exp(mid)) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.exp((low + high) / 2) * scale


def histogram(df: DataFrame, bin_: Column, *within: str, weight: Column | None = None) -> DataFrame:
    return df.groupBy(*within, bin_.alias("bin")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def bound_histogram(reads: DataFrame, z: str, conc: float, beta: float = 0.0, background: DataFrame | None = None, low: float = -15.0, high: float = 3.0, bins: int = 18) -> DataFrame:
    """(bin, bound, share) over log10 bins of a read's affinity: the occupancy-weighted share of bound reads at a concentration, and that with beta times a background(bin, share) added, 1 in sum again.

    Affinities beyond the ends, or not above 0, are in no bin; bins without reads have 0.
    """
    x = F.floor((F.log10(F.col(z)) - low) / ((high - low) / bins)).cast("int")
    y = F.col(z) * conc
    sums = reads.where(F.col(z) > 0).groupBy(x.alias("bin")).agg(F.sum(y / (y + 1)).alias("psi")).where(F.col("bin").between(0, bins - 1))
    rows = reads.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    rows = rows.crossJoin(F.broadcast(sums.agg(F.sum("psi").alias("_all")))).withColumn("bound", F.col("psi") / F.col("_all"))  # one row
    if background is not None:
        rows = rows.join(background.select("bin", (F.col("share") * beta).alias("_b")), "bin", "left")
    else:
        rows = rows.withColumn("_b", F.lit(0.0))
    rows = rows.withColumn("_v", F.col("bound") + F.coalesce("_b", F.lit(0.0)))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("_v").alias("_w")))).select("bin", "bound", (F.col("_v") / F.col("_w")).alias("share"))  # one row


def density(hist: DataFrame, width: float, *within: str) -> DataFrame:
    """Adds density: the histogram over its trapezoidal integral."""
    w = Window.partitionBy(*within)
    nxt = F.lead("n").over(w.orderBy("bin"))
    area = F.sum((F.col("n") + F.col("_next")) / 2 * width).over(w)
    return hist.withColumn("_next", nxt).withColumn("density", F.col("n") / area).drop("_next")
