"""Profile of columns within each group of a key.

Counts and moments are merged map-side, so a key with most of the rows is one small state per task. Quartiles, distinct values and
modes come from one histogram ``(group, column, value, count)``; its running totals are taken over
ranges of group *and* value, so a large group is cut over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import ROW_ID, data_columns, is_numeric, kind_of, require_column
from datalathe.functions.ordering import running_total
from datalathe.functions.scalars import col, missing, non_nan, present
from datalathe.session import cut_lineage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
SHAPE = ("mean", "std", "minimum", "maximum")


def grouped_profile(df: DataFrame, by: list[str], columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """One row per group and column: ``column, rows, missing_count, unique_count, mode`` and, for numbers, moments and quartiles.

    Rows without a key (NULL or NaN) are a group of their own. ``mode`` is text; of values equally frequent it is the
    least number, or the least text.
    """
    columns = columns or [c for c in data_columns(df, row_id) if c not in by]
    for c in [*by, *columns]:
        require_column(df, c)
    if not by or not columns:
        raise ValueError("a grouped profile needs keys and columns")
    reserved = {"column", "rows", "missing_count", "unique_count", "mode", *SHAPE, *QUARTILES}
    if reserved & {b.lower() for b in by}:
        raise ValueError(f"key columns may not be called {sorted(reserved & {b.lower() for b in by})}")
    group = F.struct(*[present(df, b).alias(f"k{i}") for i, b in enumerate(by)]).alias("group")
    numbers = [c for c in columns if is_numeric(df, c)]

    def states(i: int, c: str) -> list[Column]:
        out = [F.count_if(missing(df, c)).alias(f"missing{i}")]
        x = non_nan(col(c)) if c in numbers else None
        made = (F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)) if c in numbers else [F.lit(None).cast("double")] * 4
        return out + [m.alias(f"{s}{i}") for s, m in zip(SHAPE, made)]

    wide = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *[s for i, c in enumerate(columns) for s in states(i, c)])
    tidy = wide.select(
        "group", "rows",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.col(f"missing{i}").alias("missing_count"),
                     *[F.col(f"{s}{i}").alias(s) for s in SHAPE])
            for i, c in enumerate(columns)
        ])),
    ).withColumn("cell", F.struct("group", "at"))

    counts = _histogram(df, group, columns)
    heads = counts.groupBy("cell").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("cnt").alias("n"), F.max("cnt").alias("most"))
    modes = (
        counts.join(heads.select("cell", "most"), "cell").where("cnt = most")
        .groupBy("cell").agg(F.min(F.struct("value", "text")).alias("first"))
        .select("cell", F.col("first.text").alias("mode"))
    )
    facts = heads.drop("most").join(modes, "cell")
    quartiles = quartiles_of(counts.where("value IS NOT NULL"), heads)
    joined = tidy.join(facts, "cell", "left").join(quartiles, "cell", "left")
    return joined.select(
        *[F.col("group").getField(f"k{i}").alias(b) for i, b in enumerate(by)],
        "column", "rows", "missing_count", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "mode", *SHAPE, *QUARTILES,
    )


def text_and_number(df: DataFrame, c: str) -> tuple[Column, Column]:
    """A value as ``text`` and, in a numeric column, as the number ``value``; both NULL where it is missing."""
    number = non_nan(col(c)) if is_numeric(df, c) else F.lit(None).cast("double")
    binary = kind_of(df.schema[c]) == "float" and not df.schema[c].dataType.typeName().startswith("decimal")
    # Adding zero makes one of the two zeros of floating columns.
    shown = present(df, c) + F.lit(0.0) if binary else present(df, c)
    return shown.cast("string").alias("text"), number.cast("double").alias("value")


def _histogram(df: DataFrame, group: Column, columns: list[str]) -> DataFrame:
    """``(cell, text, value, cnt)``; ``value`` is the number of a numeric column."""

    def entry(i: int, c: str) -> Column:
        return F.struct(F.lit(i).alias("at"), *text_and_number(df, c))

    long = df.select(group, F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)]))).where("text IS NOT NULL")
    counted = long.groupBy(F.struct("group", "at").alias("cell"), "text", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return cut_lineage(counted)


def quartiles_of(counts: DataFrame, heads: DataFrame) -> DataFrame:
    """``(cell, q1, median, q3)``, interpolated between the two nearest ranks."""
    totals = running_total(counts.select("cell", "value", "cnt"), "cell", "value", "cnt", bounded=False)
    ranked = totals.join(heads.select("cell", "n"), "cell")
    picks, out = [], ["cell"]
    for name, q in QUARTILES.items():
        place = (F.col("n") - 1) * F.lit(q)
        for end, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            here = (F.col("before") <= rank) & (rank < F.col("before") + F.col("cnt"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"{name}_{end}"))
        share = F.first(place - F.floor(place)).alias(f"{name}_f")
        picks.append(share)
        out.append((F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * F.col(f"{name}_f")).alias(name))
    return ranked.groupBy("cell").agg(*picks).select(*out)
