"""Histogram, box plot, scatter sample, normality and shape of one numeric column."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import ROW_ID, require_column, require_numeric
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import col, missing, non_nan, round_py

BINS = 30
NORMALITY_ROWS = 5000
PLOT_ROWS = 3000
SAMPLE_SEED = 42


def bin_edges(low: float | None, high: float | None, bins: int = BINS) -> tuple[float, float]:
    """First and last edge: one unit wide around a constant, [0, 1] for no values."""
    if low is None:
        return 0.0, 1.0
    if low == high:
        return low - 0.5, high + 0.5
    return low, high


def bin_index(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value; the last bin includes its right edge.

    The first guess comes from a division and may be off by one at an edge, so it
    is checked against the edges themselves.
    """
    step = (high - low) / bins
    guess = F.least(F.floor((v - F.lit(low)) * F.lit(bins) / F.lit(high - low)), F.lit(bins - 1)).cast("int")

    def edge(i: Column) -> Column:
        return i * F.lit(step) + F.lit(low)

    return (
        F.when(v < edge(guess), guess - 1)
        .when((v >= edge(guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )


def histogram(df: DataFrame, column: str | Column, bins: int = BINS) -> DataFrame:
    """``(bin, lower_edge, upper_edge, count)`` for every bin, empty ones included."""
    v = non_nan(col(column) if isinstance(column, str) else column)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    low, high = bin_edges(ends["lo"], ends["hi"], bins)
    counted = (
        df.select(v.alias("v")).where("v IS NOT NULL").groupBy(bin_index(F.col("v"), low, high, bins).alias("bin")).count()
    )
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    grid = df.sparkSession.createDataFrame(
        [(i, round_py(edges[i], 4), round_py(edges[i + 1], 4)) for i in range(bins)],
        "bin int, lower_edge double, upper_edge double",
    )
    return grid.join(counted, "bin", "left").select(
        "bin", "lower_edge", "upper_edge", F.coalesce("count", F.lit(0)).alias("count")
    )


def boxplot(df: DataFrame, column: str, row_id: str | None = ROW_ID, values: int = PLOT_ROWS) -> dict:
    """Five-number summary and the first values in row order, for drawing."""
    require_numeric(df, column, "a box plot")
    summary = boxplot_stats(df, column).first().asDict()
    rows = df.where(~missing(df, column))
    if row_id is not None and row_id in df.columns:
        rows = rows.orderBy(col(row_id))
    summary["values"] = [float(r[0]) for r in rows.select(col(column)).limit(values).collect()]
    return summary


def boxplot_stats(df: DataFrame, column: str) -> DataFrame:
    v = non_nan(col(column))
    q1, median, q3 = exact_quantiles(df, {column: v}, (0.25, 0.5, 0.75))[column]
    return df.agg(
        F.lit(column).alias("column"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(median).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        (F.min(v) + 0.0).alias("minimum"),
        (F.max(v) + 0.0).alias("maximum"),
    )


def hash_sample(df: DataFrame, row_id: str, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the row id: the same rows on any cluster.

    A top-n: each task keeps ``n`` rows, whatever the size of the data.
    """
    return df.orderBy(sample_order(row_id, seed), col(row_id)).limit(n)


def sample_order(row_id: str, seed: int = SAMPLE_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), col(row_id).cast("string")))


def scatter(df: DataFrame, x: str, y: str, row_id: str = ROW_ID, n: int = PLOT_ROWS) -> DataFrame:
    """``(row_id, x, y)`` of at most ``n`` rows where both columns have a value."""
    for c in (x, y):
        require_column(df, c)
    both = df.where(~missing(df, x) & ~missing(df, y)).select(
        col(row_id).alias("row_id"), col(x).alias("x"), col(y).alias("y")
    )
    return hash_sample(both, "row_id", n)


# Polynomial coefficients of the published W approximation (Royston 1995), lowest power first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MU_SMALL = (0.544, -0.39978, 0.025054, -6.714e-4)
_LOG_SIGMA_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
_MU_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LOG_SIGMA_LARGE = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def _poly(coefficients, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for 3 to 5000 values, after Royston's 1995 approximation."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if x[-1] == x[0]:
        return 1.0, 1.0
    normal = NormalDist()
    if n == 3:
        half = math.sqrt(0.5)
        weights = np.array([-half, 0.0, half])
    else:
        m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        size = float(m @ m)
        u = 1.0 / math.sqrt(n)
        last = m[-1] / math.sqrt(size) + _poly(_C1, u)
        weights = np.empty(n)
        if n > 5:
            second = m[-2] / math.sqrt(size) + _poly(_C2, u)
            rest = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            weights[2:-2] = m[2:-2] / math.sqrt(rest)
            weights[1], weights[-2] = -second, second
        else:
            rest = (size - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            weights[1:-1] = m[1:-1] / math.sqrt(rest)
        weights[0], weights[-1] = -last, last
    centred = x - x.mean()
    w = min(float((weights @ centred) ** 2 / (centred @ centred)), 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(max(p, 0.0), 1.0)
    if w == 1.0:
        return w, 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        limit = _poly(_GAMMA, n)
        if y >= limit:
            return w, 1e-99
        y = -math.log(limit - y)
        mu, sigma = _poly(_MU_SMALL, n), math.exp(_poly(_LOG_SIGMA_SMALL, n))
    else:
        log_n = math.log(n)
        mu, sigma = _poly(_MU_LARGE, log_n), math.exp(_poly(_LOG_SIGMA_LARGE, log_n))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2.0))


NORMALITY_SCHEMA = "column string, sample_size long, statistic double, p_value double, is_normal boolean"


def normality(df: DataFrame, columns: list[str], row_id: str = ROW_ID, rows: int = NORMALITY_ROWS) -> DataFrame:
    """Shapiro-Wilk per column on at most 5000 hash-ordered values; NULLs below three values.

    A scan per column reads it and the row id; a task keeps the first values. Only the samples
    leave their tasks; columns are tested in parallel.
    """
    if rows > NORMALITY_ROWS:
        raise ValueError(f"the statistic is published for {NORMALITY_ROWS} values at most")
    for c in columns:
        require_numeric(df, c, "a normality test")
    # A top-n per column: a task holds that many rows at most, where ranking rows would sort all it reads.
    samples = reduce(
        DataFrame.unionAll,
        [
            hash_sample(values.where("value IS NOT NULL"), "__r", rows).select("column", "value")
            for values in (
                df.select(col(row_id).alias("__r"), F.lit(c).alias("column"), non_nan(col(c)).alias("value"))
                for c in columns
            )
        ],
    )

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        w, p = shapiro_wilk(pdf["value"].to_numpy()) if n >= 3 else (None, None)
        return pd.DataFrame(
            {
                "column": [pdf["column"].iloc[0]],
                "sample_size": [n],
                "statistic": [w],
                "p_value": [p],
                "is_normal": [None if p is None else p > 0.05],
            }
        )

    tested = samples.groupBy("column").applyInPandas(test, NORMALITY_SCHEMA)
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return names.join(tested, "column", "left").select(
        "column", F.coalesce("sample_size", F.lit(0)).alias("sample_size"), "statistic", "p_value", "is_normal"
    )


def jarque_bera(df: DataFrame, columns: list[str]) -> DataFrame:
    """Full-data companion of the sampled test: ``(column, n, statistic, p_value)`` from the moments.

    The statistic is chi-squared with two degrees of freedom, so p = exp(-JB/2).
    """
    from datalathe.operators.profile import numeric_moments

    m = numeric_moments(df, columns)
    jb = F.col("count") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return m.select("column", F.col("count").alias("n"), jb.alias("statistic"), F.exp(-jb / 2.0).alias("p_value"))


def shape(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple]:
    """(skewness, kurtosis) of several expressions from one pass; None below three values."""
    aggs = []
    for i, v in enumerate(values.values()):
        v = non_nan(v)
        enough = F.count(v) >= 3
        aggs += [F.when(enough, F.skewness(v)).alias(f"s{i}"), F.when(enough, F.kurtosis(v)).alias(f"k{i}")]
    row = df.agg(*aggs).first()
    return {name: (row[f"s{i}"], row[f"k{i}"]) for i, name in enumerate(values)}


def distribution(df: DataFrame, column: str, row_id: str = ROW_ID) -> dict:
    """Shape, 30-bin histogram and normality test of one numeric column."""
    require_numeric(df, column, "distribution analysis")
    skewness, kurtosis = shape(df, {column: col(column)})[column]
    bins = histogram(df, column).orderBy("bin").collect()
    tested = normality(df, [column], row_id).first().asDict()
    return {
        "column": column,
        "skewness": skewness,
        "kurtosis": kurtosis,
        "histogram": {
            "bin_edges": [b["lower_edge"] for b in bins] + [bins[-1]["upper_edge"]],
            "counts": [b["count"] for b in bins],
        },
        "normality_test": {k: tested[k] for k in ("statistic", "p_value", "is_normal")},
    }
