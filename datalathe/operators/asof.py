"""As-of join: each row with the last (or next) row of another table under the same key.

Both tables are laid into one order of key and time and cut into ranges, so a key that holds
a large part of all rows is spread over as many tasks as its rows need. Each range is walked by itself;
only the keys that a border cuts, at most two for each range, need the last match from the ranges
before, and that is one small row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from datalathe.functions.kinds import require_column
from datalathe.functions.scalars import col, present
from datalathe.operators.features import UNITS
from datalathe.session import cut_lineage

DIRECTIONS = ("backward", "forward")


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str, columns: list[str], suffix: str = "_asof", direction: str = "backward"
) -> DataFrame:
    """All rows of ``left`` with ``columns`` of the nearest row of ``right`` whose ``on`` is not later (``forward``: not earlier).

    A row without key or ``on``, or without a match, has NULLs. Of several rows of ``right`` at the same place the greatest
    (``forward``: the least) in the order of ``columns`` is taken. A name that ``left`` already has is an error.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction '{direction}'")
    for name in [*by, on]:
        require_column(left, name)
        require_column(right, name)
    for name in columns:
        require_column(right, name)
    new = [f"{c}{suffix}" for c in columns]
    taken = {c.lower() for c in left.columns} & {c.lower() for c in new}
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already")

    keys = [f"k{i}" for i in range(len(by))]
    row_type = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(left.schema.fields)])
    match_type = T.StructType([T.StructField(f"m{i}", right.schema[c].dataType) for i, c in enumerate(columns)])

    def placed_by(d: DataFrame) -> list[Column]:
        return [*[present(d, b).alias(k) for b, k in zip(by, keys)], present(d, on).alias("t")]

    rows = left.select(
        *placed_by(left), F.lit(1).alias("side"), F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(left.columns)]).alias("row"),
        F.lit(None).cast(match_type).alias("match"),
    )
    matches = right.select(
        *placed_by(right), F.lit(0).alias("side"), F.lit(None).cast(row_type).alias("row"),
        F.struct(*[col(c).alias(f"m{i}") for i, c in enumerate(columns)]).alias("match"),
    ).dropna(subset=[*keys, "t"])

    # Rows without a time come before all matches of their key; matches come before the rows they hold for.
    backward = direction == "backward"
    along = lambda c: F.col(c).asc_nulls_first() if backward else F.col(c).desc_nulls_first()
    order = [along("t"), F.col("side"), along("match")]
    # The number lets a range end between rows that agree in all else.
    both = rows.unionByName(matches).withColumn("number", F.monotonically_increasing_id())
    ranged = both.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order, "number")
    # Written out because sampled range borders may differ when recomputed.
    placed = cut_lineage(ranged.drop("number").withColumn("part", F.spark_partition_id()))

    walk = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    walked = placed.withColumn("local", F.last("match", ignorenulls=True).over(walk)).where("side = 1")
    carried = _carried(placed, keys, backward)
    joined = walked.join(carried, ["part", *keys], "left").withColumn("found", F.coalesce("local", "carried"))
    return joined.select(
        *[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(left.columns)],
        *[F.col("found").getField(f"m{i}").alias(n) for i, n in enumerate(new)],
    )


def _carried(placed: DataFrame, keys: list[str], backward: bool) -> DataFrame:
    """``(part, keys, carried)``: the last match of all parts before, for keys that stand in several parts."""
    key = F.struct(*keys)
    ends = placed.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    cut = ends.select("part", F.explode(F.array("low", "high")).alias("key")).distinct()
    cut = cut.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # Two rows a part at most; written so that their true size is known.
    cut = cut_lineage(cut.select("key.*").dropna())
    latest = F.max if backward else F.min
    last = latest(F.when(F.col("side") == 0, F.struct("t", "match"))).alias("last")
    of_parts = placed.join(cut, keys, "left_semi").groupBy("part", *keys).agg(last)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_parts.select("part", *keys, F.last("last.match", ignorenulls=True).over(before).alias("carried"))
    return cut_lineage(carried.where("carried IS NOT NULL"))


def elapsed_since(left: DataFrame, right: DataFrame, by: list[str], on: str, name: str, unit: str = "days") -> DataFrame:
    """``left`` with ``name``: the time from the last row of ``right`` under the same key, in units; NULL where there is none."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit '{unit}'")
    if name.lower() in {c.lower() for c in left.columns}:
        raise ValueError(f"columns ['{name}'] exist already")
    at = "__asof"
    joined = asof_join(left, right, by, on, [on], at)
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return joined.withColumn(name, (micros(on) - micros(on + at)) / (UNITS[unit] * 1e6)).drop(on + at)
