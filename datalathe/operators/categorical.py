"""Frequencies of categories and of the labels inside multi-label text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datalathe.functions.kinds import require_column
from datalathe.functions.scalars import col, percent, present, round_dp, tokens
from datalathe.operators.types import detect_delimiter


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, count)`` of the non-missing values, counted map-side first."""
    require_column(df, column)
    return df.select(present(df, column).alias("value")).where("value IS NOT NULL").groupBy("value").count()


def category_frequencies(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """``(category, count, percentage, total_unique)`` of the most frequent values.

    Ties are ordered by value. Totals come from a small aggregate over the counts.
    """
    counts = category_counts(df, column)
    totals = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("u")).first()
    return (
        counts.orderBy(F.col("count").desc(), F.col("value").asc())
        .limit(top_n)
        .select(
            F.col("value").cast("string").alias("category"),
            "count",
            percent(F.col("count"), F.lit(totals["n"])).alias("percentage"),
            F.lit(totals["u"]).alias("total_unique"),
        )
    )


def label_counts(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """``(label, count)`` over all non-empty labels."""
    labels = df.where(col(column).isNotNull()).select(F.explode(tokens(col(column).cast("string"), delimiter)).alias("label"))
    return labels.where("label <> ''").groupBy("label").count()


def multi_label_profile(df: DataFrame, column: str, delimiter: str | None = None, top_n: int = 20) -> DataFrame:
    """``(delimiter, vocabulary_size, avg_labels_per_row, label, count)``, one row per frequent label."""
    require_column(df, column)
    delimiter = delimiter or detect_delimiter(df, column)
    if delimiter is None:
        raise ValueError(f"'{column}': detect_delimiter finds none of its characters often enough; pass delimiter")
    counts = label_counts(df, column, delimiter)
    vocabulary = counts.count()
    average = df.where(col(column).isNotNull()).agg(
        round_dp(F.avg(F.size(tokens(col(column).cast("string"), delimiter))), 2).alias("m")
    ).first()["m"]
    return (
        counts.orderBy(F.col("count").desc(), F.col("label").asc())
        .limit(top_n)
        .select(
            F.lit(delimiter).alias("delimiter"),
            F.lit(vocabulary).cast("long").alias("vocabulary_size"),
            F.lit(average).alias("avg_labels_per_row"),
            "label",
            "count",
        )
    )
