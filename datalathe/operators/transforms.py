"""Log, square root, Box-Cox and Yeo-Johnson transforms of one numeric column.

The power of the last two maximises a smooth likelihood. Each pass evaluates it at
many powers in one map-side aggregate; a polynomial through the values then places
the next, much smaller grid, so three or four scans reach about 1e-8.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import require_numeric
from datalathe.functions.scalars import col, non_nan
from datalathe.operators.distribution import histogram, shape
from datalathe.operators.steps import Fitted

TRANSFORMS = ("none", "log", "sqrt", "box_cox", "yeo_johnson")

GRID = tuple(i * 0.25 for i in range(-8, 9))


def box_cox(v: Column, power: float, scale: float = 1.0) -> Column:
    x = v if scale == 1.0 else v / F.lit(scale)
    if abs(power) < 1e-12:
        return F.log(x)
    # expm1 keeps its precision where the power is close to zero
    return F.expm1(F.log(x) * F.lit(power)) / F.lit(power)


def yeo_johnson(v: Column, power: float) -> Column:
    up = F.log1p(v) if abs(power) < 1e-12 else F.expm1(F.log1p(v) * F.lit(power)) / F.lit(power)
    rest = 2.0 - power
    down = -F.log1p(-v) if abs(rest) < 1e-12 else -F.expm1(F.log1p(-v) * F.lit(rest)) / F.lit(rest)
    return F.when(v >= 0, up).otherwise(F.when(v < 0, down))


def _likelihoods(df: DataFrame, curve, powers, n: int, slope: float) -> np.ndarray:
    row = df.agg(*[F.var_pop(curve(p)).alias(f"v{i}") for i, p in enumerate(powers)]).first()
    out = []
    for i, p in enumerate(powers):
        var = row[i]
        usable = var is not None and math.isfinite(var) and var > 0
        out.append((p - 1.0) * slope - n / 2.0 * math.log(var) if usable else -math.inf)
    return np.array(out)


def best_power(df: DataFrame, curve, n: int, slope: float) -> float:
    """The power that maximises ``(p-1)*slope - n/2*log(var(curve(p)))``."""
    powers = np.array(GRID)
    for _ in range(8):
        values = _likelihoods(df, curve, powers, n, slope)
        best = int(np.argmax(values))
        if 0 < best < len(powers) - 1:
            break
        span = powers[-1] - powers[0]
        powers = powers + (-span * 0.75 if best == 0 else span * 0.75)
    centre, reach = float(powers[best]), float(powers[1] - powers[0])
    # Chebyshev nodes: the polynomial through them is accurate over the whole interval.
    for nodes, shrink in ((9, 1 / 40), (5, 1 / 400)):
        unit = np.cos(np.pi * (2 * np.arange(nodes) + 1) / (2 * nodes))
        values = _likelihoods(df, curve, centre + reach * unit, n, slope)
        fit = np.polynomial.chebyshev.Chebyshev.fit(unit, values - values.max(), nodes - 1, domain=[-1, 1])
        turning = [r.real for r in fit.deriv().roots() if abs(r.imag) < 1e-9 and -1.05 <= r.real <= 1.05]
        if turning:
            centre += reach * max(turning, key=fit)
        else:
            centre += reach * float(unit[int(np.argmax(values))])
        reach *= shrink
    return centre


def fit_transform(df: DataFrame, column: str, transform: str) -> Fitted:
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform '{transform}'")
    require_numeric(df, column, "a transform")
    if transform == "none":
        return curved(column, transform)
    v = non_nan(col(column))
    head = df.agg(
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.count(v).alias("n"),
        F.avg(F.when(v > 0, F.log(v))).alias("mean_log"),
        F.sum(F.signum(v) * F.log1p(F.abs(v))).alias("signed_log"),
    ).first()
    low = head["lo"]
    if low is not None and low <= 0 and transform in ("log", "box_cox"):
        raise ValueError(f"{transform} needs positive values, but '{column}' has a minimum of {low}; try yeo_johnson")
    if low is not None and low < 0 and transform == "sqrt":
        raise ValueError(f"sqrt needs non-negative values, but '{column}' has a minimum of {low}; try yeo_johnson")
    if transform in ("log", "sqrt") or head["n"] == 0:
        return curved(column, transform)
    if low == head["hi"]:
        raise ValueError(f"{transform} needs more than one distinct value in '{column}'")
    if transform == "box_cox":
        # Dividing by the geometric mean leaves the best power unchanged and keeps powers in range.
        scale = math.exp(head["mean_log"])
        power = best_power(df, lambda p: box_cox(v, float(p), scale), head["n"], 0.0)
    else:
        power = best_power(df, lambda p: yeo_johnson(v, float(p)), head["n"], head["signed_log"])
    return curved(column, transform, power)


def curved(column: str, transform: str, power: float | None = None) -> Fitted:
    """A transform with its power; without values there was none to learn, and only the type changes."""
    v = non_nan(col(column))
    if transform == "none":
        return Fitted("transform", {"column": column, "transform": transform})
    if transform in ("log", "sqrt"):
        new = F.log(v) if transform == "log" else F.sqrt(v)
    elif power is None:
        new = col(column).cast("double")
    else:
        new = box_cox(v, power) if transform == "box_cox" else yeo_johnson(v, power)
    return Fitted("transform", {"column": column, "transform": transform}, {"power": power}, lambda d: d.withColumn(column, new))


def apply_transform(df: DataFrame, column: str, transform: str) -> DataFrame:
    return fit_transform(df, column, transform).apply(df)


def preview_transform(df: DataFrame, column: str, transform: str) -> dict:
    """Skewness and 30-bin histogram before and after."""
    after = apply_transform(df, column, transform)

    def bins(frame):
        rows = histogram(frame, column).orderBy("bin").collect()
        return {
            "bin_edges": [r["lower_edge"] for r in rows] + [rows[-1]["upper_edge"]],
            "counts": [r["count"] for r in rows],
        }

    return {
        "column": column,
        "transform": transform,
        "before_skewness": shape(df, {column: col(column)})[column][0],
        "after_skewness": shape(after, {column: col(column)})[column][0],
        "before_histogram": bins(df),
        "after_histogram": bins(after),
    }
