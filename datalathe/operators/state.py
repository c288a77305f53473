"""Mergeable state of columns: value counts, from which a whole profile follows without the rows.

The state of two parts of a table together is the sum of their counts, so what is appended to a
table is counted alone. Counts are made map-side; a value with a third of the rows is one row of the state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from datalathe.functions.kinds import require_column
from datalathe.operators.grouped import QUARTILES, quartiles_of, text_and_number

MOMENTS = ("mean", "std", "variance", "minimum", "maximum", "range", "skewness", "kurtosis")


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(cell, text, value, cnt)`` for each column (``cell``) and value that is not missing; ``value`` is a number's."""
    for c in columns:
        require_column(df, c)
    entries = [F.struct(F.lit(c).alias("cell"), *text_and_number(df, c)) for c in columns]
    long = df.select(F.inline(F.array(*entries))).where("text IS NOT NULL")
    return long.groupBy("cell", "text", "value").agg(F.count(F.lit(1)).alias("cnt"))


def merged(states: list[DataFrame]) -> DataFrame:
    """The state of all parts together."""
    if len(states) == 1:
        return states[0]
    return reduce(DataFrame.unionByName, states).groupBy("cell", "text", "value").agg(F.sum("cnt").alias("cnt"))


def profile_of(counts: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """One row per column: ``column, rows, missing_count, unique_count, mode``, moments and quartiles.

    ``counts`` is read several times and should be a written table. ``mode`` is text; of values equally frequent it
    is the least number, or the least text. Moments are taken about the mean in a second pass; skewness and kurtosis
    need three values that are not all equal. A column without values has no rows in ``counts`` and is all missing.
    """
    spark = counts.sparkSession
    all_columns = spark.createDataFrame([(c,) for c in columns], "cell string")
    x, w = F.col("value"), F.col("cnt")
    heads = counts.groupBy("cell").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum(w).alias("n"), F.max(w).alias("most"),
        (F.sum(x * w) / F.sum(w)).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
    )
    # One row per column.
    small = F.broadcast(heads.select("cell", "most", "mean"))
    around = counts.drop("mean").join(small, "cell")
    off = x - F.col("mean")
    powers = around.groupBy("cell").agg(
        *[F.sum(w * F.pow(off, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)],
        F.min(F.when(w == F.col("most"), F.struct("value", "text"))).alias("first"),
    )
    quartiles = quartiles_of(counts.where("value IS NOT NULL"), heads)
    n, m2 = F.col("n"), F.col("m2")
    shaped = (n >= 3) & (F.col("minimum") < F.col("maximum"))
    variance = F.when(n > 1, m2 / (n - 1))
    return (
        all_columns.join(heads, "cell", "left").join(powers, "cell", "left").join(quartiles, "cell", "left")
        .select(
            F.col("cell").alias("column"),
            F.lit(rows).cast("long").alias("rows"),
            (F.lit(rows) - F.coalesce(n, F.lit(0))).cast("long").alias("missing_count"),
            F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
            F.col("first.text").alias("mode"),
            "mean",
            F.sqrt(variance).alias("std"),
            variance.alias("variance"),
            "minimum",
            "maximum",
            (F.col("maximum") - F.col("minimum")).alias("range"),
            F.when(shaped, F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5))).alias("skewness"),
            F.when(shaped, n * F.col("m4") / (m2 * m2) - 3.0).alias("kurtosis"),
            *QUARTILES,
        )
    )
