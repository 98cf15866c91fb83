"""Correlation, regression and tests; sums are made on the cluster, p-values from a few numbers on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.operators.ordering import below, exact_quantiles, ranked


def correlations(df: DataFrame, x: str, y: str, *within: str) -> DataFrame:
    """(within, pearson, spearman, n)."""
    both = ranked(ranked(df, x, "_rx", *within), y, "_ry", *within)
    return both.groupBy(*within).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def regression(df: DataFrame, x: str, y: str, *within: str) -> DataFrame:
    """(within, slope, intercept, r2) of y on x."""
    return df.groupBy(*within).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def ridge(df: DataFrame, features: list[str], y: str, alpha: float = 0.5) -> dict[str, float]:
    """Coefficients of the standardised features, the intercept and r2 of a ridge fit with penalty alpha on the sum of squares."""
    stats = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = df.select(F.col(y).alias("_y"), *[((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0)).alias(c) for c in features])
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(z)
    m = LinearRegression(featuresCol="_x", labelCol="_y", regParam=alpha / stats["n"], elasticNetParam=0.0, standardization=False, solver="normal").fit(data)
    return {**dict(zip(features, m.coefficients.toArray().tolist())), "intercept": m.intercept, "r2": m.summary.r2}


def quantiles(df: DataFrame, x: str, *within: str) -> DataFrame:
    """(within, p05, p25, p50, p75, p95), from counts by value."""
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    found = exact_quantiles(df, x, list(shares), *within)
    return found.groupBy(*within).agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"p{int(100 * p):02d}") for p in shares])


def mann_whitney(df: DataFrame, x: str, flag: str) -> DataFrame:
    """(u, n1, n0, z): U of the flagged rows against the others, and its normal deviate without a tie correction."""
    one, none = F.col(flag).cast("long"), (~F.col(flag)).cast("long")
    s = below(df, x, n1=one, n0=none).agg(F.sum(F.col("n1") * (F.col("n_below") + (F.col("n") + 1) / 2)).alias("r1"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")  # the product of three counts leaves the range of a long at some 3 million rows
    u = F.col("r1") - a * (a + 1) / 2
    return s.select(u.alias("u"), "n1", "n0", ((u - a * b / 2) / F.sqrt(a * b * (a + b + 1) / 12)).alias("z"))


def t_one_sample(df: DataFrame, x: str, mean: float = 0.0, *within: str) -> DataFrame:
    return df.groupBy(*within).agg(((F.avg(x) - mean) / (F.stddev_samp(x) / F.sqrt(F.count(x)))).alias("t"), (F.count(x) - 1).alias("df"))


def t_welch(df: DataFrame, x: str, flag: str) -> DataFrame:
    """(t, df) of the flagged rows against the others, variances not assumed equal."""
    one, two = F.when(F.col(flag), F.col(x)), F.when(~F.col(flag), F.col(x))
    s = df.agg(F.avg(one).alias("m1"), F.avg(two).alias("m2"), (F.var_samp(one) / F.count(one)).alias("v1"), (F.var_samp(two) / F.count(two)).alias("v2"), F.count(one).alias("n1"), F.count(two).alias("n2"))
    return s.select(((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") + F.col("v2"))).alias("t"), ((F.col("v1") + F.col("v2")) ** 2 / (F.col("v1") ** 2 / (F.col("n1") - 1) + F.col("v2") ** 2 / (F.col("n2") - 1))).alias("df"))


def sign_counts(df: DataFrame, x: str, *within: str) -> DataFrame:
    return df.groupBy(*within).agg(F.sum((F.col(x) > 0).cast("long")).alias("positive"), F.sum((F.col(x) < 0).cast("long")).alias("negative"))


def sign_test(positive: int, negative: int) -> float:
    """Two-sided binomial p."""
    n, k = positive + negative, min(positive, negative)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs))) if n else 1.0


def normal_p(z: float) -> float:
    """Two-sided p of a normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_p(t: float, df: float, steps: int = 20_000) -> float:
    """Two-sided p of Student's t, by integrating its density in a bounded variable."""
    edge = math.atan(abs(t) / math.sqrt(df))
    a = np.linspace(edge, math.pi / 2, steps)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return float(min(1.0, 2 * c * np.trapezoid(np.cos(a) ** (df - 1), a)))


def summary(df: DataFrame, x: str, *within: str) -> DataFrame:
    """Counts by sign, missing values, and the range, mean and median."""
    c = F.col(x)
    return df.groupBy(*within).agg(
        F.count_if(c > 0).alias("positive"), F.count_if(c == 0).alias("zero"), F.count_if(c < 0).alias("negative"), F.count_if(c.isNull() | F.isnan(c.cast("double"))).alias("missing"),
        F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"),
    )
