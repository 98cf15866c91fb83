"""What explains enrichments besides binding: saturating fits with a background share, and ridge regressions compared.

Both need sums over the rows only: one aggregation gives the normal equations of all groups, and the solver holds a few
numbers for each group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the effective concentration and of the background share.
CONC, SHARE = (1e-3, 1e3), (1e-6, 10.0)


def _key(row, within: tuple[str, ...]) -> tuple:
    return tuple(row[c] for c in within)


def _parameters(df: DataFrame, fits: dict[tuple, dict[str, float]], within: tuple[str, ...]) -> DataFrame:
    """df with the fields of its group's fit as columns; a row a group is broadcast."""
    names = list(next(iter(fits.values())))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"_g{i} {kinds[c]}" for i, c in enumerate(within)), *(f"{n} double" for n in names)])
    table = df.sparkSession.createDataFrame([(*k, *(float(v[n]) for n in names)) for k, v in fits.items()], schema)
    if not within:
        return df.crossJoin(F.broadcast(table))  # one row
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(within)]
    return df.join(F.broadcast(table), same).drop(*[f"_g{i}" for i in range(len(within))])


def _bound(z: Column) -> Column:
    y = F.exp(F.col("_u")) * z
    return y / (y + 1)


def predicted_log_ratio(df: DataFrame, z: str, f0: str, fits: DataFrame, *within: str) -> DataFrame:
    """df with log_ratio, log2 of the share of each row after binding over its share f0 before: (p + beta) / sum f0 (p + beta), p = conc z / (conc z + 1)."""
    own = {_key(r, within): {"_u": math.log(r["conc"]), "_b": r["beta"]} for r in fits.collect()}  # a row a group
    rows = _parameters(df, own, within)
    weight = _bound(F.col(z)) + F.col("_b")
    total = rows.groupBy(*within).agg((F.sum(F.col(f0) * weight) / F.sum(f0)).alias("_w"))
    totals = {_key(r, within): {"_w": r["_w"]} for r in total.collect()}
    return _parameters(rows, totals, within).withColumn("log_ratio", F.log2(weight / F.col("_w"))).drop("_u", "_b", "_w")


def binding_fit(df: DataFrame, z: str, f0: str, y: str, *within: str, steps: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """(within, n, conc, beta, error): effective concentration and background share for which predicted_log_ratio() comes nearest to y, in the mean square.

    Damped Gauss-Newton steps on the logs of both, within CONC and SHARE. A step's residuals depend on a sum over all
    rows; since that enters them as one number, fourteen sums of one pass give it, the error and the normal equations
    together. Rows with a null or not finite value, or f0 not above 0, are left out; groups without rows have no fit.
    df is read once for each step: persist it.
    """
    kept = df.where((F.col(f0) > 0) & F.col(z).isNotNull() & F.col(y).isNotNull() & (F.abs(F.col(y)) < float("inf")) & ~F.isnan(y) & ~F.isnan(z))

    def sums(at: dict[tuple, np.ndarray]) -> dict[tuple, dict[str, float]]:
        rows = _parameters(kept, {k: {"_u": v[0], "_b": math.exp(v[1])} for k, v in at.items()}, within)
        p, b, f = _bound(F.col(z)), F.col("_b"), F.col(f0)
        a, du, dv = F.log2(p + b) - F.col(y), p * (1 - p) / (p + b) / math.log(2), b / (p + b) / math.log(2)
        rows = rows.select(*within, f.alias("f"), (f * (p + b)).alias("w"), (f * p * (1 - p)).alias("wu"), (f * b).alias("wv"), a.alias("a"), du.alias("u"), dv.alias("v"))
        products = ("aa", "au", "av", "uu", "uv", "vv")
        found = rows.groupBy(*within).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("f", "w", "wu", "wv", "a", "u", "v")], *[F.sum(F.col(c[0]) * F.col(c[1])).alias(c) for c in products])
        return {_key(r, within): r.asDict() for r in found.collect()}

    def equations(s: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
        """(mean square, J'e, J'J)."""
        n = s["n"]
        shift = np.array([math.log2(s["w"] / s["f"]), s["wu"] / s["w"] / math.log(2), s["wv"] / s["w"] / math.log(2)])
        raw = np.array([[s["aa"], s["au"], s["av"]], [s["au"], s["uu"], s["uv"]], [s["av"], s["uv"], s["vv"]]])
        mean = np.array([s["a"], s["u"], s["v"]])
        m = raw - np.outer(mean, shift) - np.outer(shift, mean) + n * np.outer(shift, shift)
        return m[0, 0] / n, m[1:, 0], m[1:, 1:]

    low, high = np.log([CONC[0], SHARE[0]]), np.log([CONC[1], SHARE[1]])
    groups = [_key(r, within) for r in (kept.select(*within).distinct() if within else kept.limit(1)).collect()]
    at = {k: np.array([0.0, math.log(0.1)]) for k in groups}
    state = {k: equations(s) for k, s in sums(at).items()} if at else {}
    count = {}
    damp = {k: 1e-3 for k in at}
    active = set(at)
    for _ in range(steps):
        if not active:
            break
        trial = {}
        for k in active:
            _, g, h = state[k]
            trial[k] = np.clip(at[k] - np.linalg.solve(h + damp[k] * (np.diag(np.diag(h)) + 1e-12 * np.eye(2)), g), low, high)
        for k, s in sums({**at, **trial}).items():
            count[k] = s["n"]
            if k not in active:
                continue
            new = equations(s)
            if new[0] <= state[k][0]:
                settled = state[k][0] - new[0] <= tolerance * (state[k][0] + 1e-300) and np.abs(trial[k] - at[k]).max() < 1e-5
                at[k], state[k], damp[k] = trial[k], new, max(1e-12, damp[k] / 10)
                if settled or new[0] < 1e-24:
                    active.discard(k)
            else:
                damp[k] *= 10
                if damp[k] > 1e10:
                    active.discard(k)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in within), "n long, conc double, beta double, error double"])
    return df.sparkSession.createDataFrame([(*k, count.get(k, 0), math.exp(v[0]), math.exp(v[1]), float(state[k][0])) for k, v in at.items()], schema)


@dataclass
class Ridge:
    """A ridge fit of one group by standardised features; alpha weighs the sum of squared coefficients against that of squared residuals."""

    features: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    coefficients: np.ndarray
    intercept: float
    r2: float
    pearson: float
    n: int

    def predicted(self) -> Column:
        out = F.lit(self.intercept)
        for f, m, d, c in zip(self.features, self.mean, self.deviation, self.coefficients):
            out = out + (F.col(f) - m) * (c / d)
        return out


def moments(df: DataFrame, columns: list[str], *within: str) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """(n, means, covariances) of the columns in each group, by one pass after that for a common origin. Rows with a null in any are left out."""
    known = df
    for c in columns:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    origin = known.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if origin is None or origin["m0"] is None:
        return {}
    near = [F.col(c) - origin[f"m{i}"] for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = known.groupBy(*within).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(near)], *[F.sum(near[i] * near[j]).alias(f"p{i}_{j}") for i, j in pairs])
    out = {}
    for r in found.collect():
        n, s = r["n"], np.array([r[f"s{i}"] for i in range(len(columns))]) / r["n"]
        cov = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - s[i] * s[j]
        out[_key(r, within)] = n, s + np.array([origin[f"m{i}"] for i in range(len(columns))]), cov
    return out


def ridge_of(n: int, mean: np.ndarray, cov: np.ndarray, features: list[str], at: list[int], y: int, alpha: float) -> Ridge:
    """The fit of column y of moments() by the columns `at`. A feature that does not vary has no weight."""
    scale = np.sqrt(np.diag(cov)[at])
    scale = np.where(scale > 1e-12, scale, 1.0)
    x = cov[np.ix_(at, at)] / np.outer(scale, scale)
    xy = cov[at, y] / scale
    w = np.linalg.solve(n * x + alpha * np.eye(len(at)), n * xy)
    rest = cov[y, y] - 2 * w @ xy + w @ x @ w
    spread = math.sqrt(max(0.0, float(w @ x @ w)) * cov[y, y])
    return Ridge(features, mean[at], scale, w, float(mean[y]), 1 - float(rest) / cov[y, y] if cov[y, y] > 0 else math.nan, float(w @ xy) / spread if spread > 0 else math.nan, n)


def compared_models(df: DataFrame, models: dict[str, list[str]], y: str, *within: str, alpha: float = 0.5) -> tuple[DataFrame, dict[tuple, dict[str, Ridge]]]:
    """((within, model, n, r2, pearson), the fits by group and model) of ridge regressions of y by each model's features.

    All models of all groups come from one aggregation of the products of their features, so every model sees the same
    rows: those without a null in any feature or y. r2 is null where y does not vary.
    """
    features = sorted({f for own in models.values() for f in own})
    fits: dict[tuple, dict[str, Ridge]] = {}
    for k, (n, mean, cov) in moments(df, [*features, y], *within).items():
        fits[k] = {name: ridge_of(n, mean, cov, own, [features.index(f) for f in own], len(features), alpha) for name, own in models.items()}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in within), "model string, n long, r2 double, pearson double"])
    clean = lambda v: None if math.isnan(v) else float(v)
    rows = [(*k, name, m.n, clean(m.r2), clean(m.pearson)) for k, own in fits.items() for name, m in own.items()]
    return df.sparkSession.createDataFrame(rows, schema), fits


def residuals(df: DataFrame, fits: dict[tuple, dict[str, Ridge]], model: str, y: str, *within: str) -> DataFrame:
    """df with predicted and residual of one of compared_models(), null in groups without a fit."""
    predicted = None
    for k, own in fits.items():
        here = F.lit(True)
        for c, v in zip(within, k):
            here = here & F.col(c).eqNullSafe(F.lit(v))
        value = own[model].predicted()
        predicted = F.when(here, value) if predicted is None else predicted.when(here, value)
    predicted = F.lit(None).cast("double") if predicted is None else predicted
    return df.withColumn("predicted", predicted).withColumn("residual", F.col(y) - F.col("predicted"))
