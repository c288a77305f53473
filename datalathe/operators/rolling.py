"""Statistics over the last rows before each row, in row order, without a window over all rows.

Rows are numbered without gaps and cut into buckets; a bucket also gets the rows just before it that its first
rows look back on (its halo). Inside, rows stand in blocks as long as the window. A window is then
the end of one block and the beginning of the next, or exactly one block, so two running
aggregates per block give every statistic at the same cost for any length, and sums never subtract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from datalathe.functions.kinds import ROW_ID, require_numeric
from datalathe.functions.ordering import BUCKET_ROWS, assign_row_id
from datalathe.functions.scalars import col, present
from datalathe.operators.features import _with

STATISTICS = ("mean", "sum", "min", "max", "count")


def rolling(
    df: DataFrame,
    column: str,
    rows: int,
    statistics: tuple[str, ...] = ("mean", "min", "max"),
    row_id: str = ROW_ID,
    least: int = 1,
    width: int = BUCKET_ROWS,
) -> DataFrame:
    """``{column}_rolling_{statistic}`` over each row and the ``rows - 1`` rows before it.

    Missing values are passed over; with fewer than ``least`` present ones all statistics but the count are NULL.
    """
    require_numeric(df, column, "rolling statistics")
    unknown = [s for s in statistics if s not in STATISTICS]
    if unknown or not statistics or rows < 1 or least < 1:
        raise ValueError("rolling statistics need known names and positive numbers of rows")
    names = [f"{column}_rolling_{s}" for s in statistics]
    _with(df, {n: F.lit(None) for n in names})  # an existing name is an error
    width = max(width, rows)
    placed = _positions(df, row_id)
    home = F.expr(f"__pos div {width}L")
    reaches = F.col("__pos") % width >= width - (rows - 1)
    buckets = F.when(reaches, F.array(home, home + 1)).otherwise(F.array(home))
    data = [c for c in placed.columns if c != "__pos"]
    value = present(df, column)
    spread = placed.select(
        *[col(c) for c in data], "__pos", value.alias("__v"), F.expr(f"__pos div {rows}L").alias("__block"),
        F.explode(buckets).alias("__bucket"),
    )
    block = Window.partitionBy("__bucket", "__block")
    running = Window.unboundedPreceding, Window.currentRow
    begun, left = block.orderBy("__pos").rowsBetween(*running), block.orderBy(F.desc("__pos")).rowsBetween(*running)
    number = F.col("__v").cast("double")
    parts = {"n": F.count("__v"), "s": F.sum(number), "lo": F.min("__v"), "hi": F.max("__v")}
    needed = ["n", *(["s"] if {"mean", "sum"} & {*statistics} else []), *(["lo"] if "min" in statistics else []),
              *(["hi"] if "max" in statistics else [])]
    both = spread.select(
        "*", *[parts[p].over(left).alias(f"__{p}_left") for p in needed], *[parts[p].over(begun).alias(f"__{p}_begun") for p in needed]
    )
    # Positions have no gaps inside a bucket, so the row that opens the window is found by its distance.
    line = Window.partitionBy("__bucket").orderBy("__pos")
    whole = (F.col("__pos") + 1) % rows == 0
    opened = lambda p: F.when(~whole, F.lag(f"__{p}_left", rows - 1).over(line)) if rows > 1 else F.lit(None)
    met = both.select("*", *[opened(p).alias(f"__{p}_open") for p in needed]).where(F.col("__bucket") == home)
    zero = lambda p: F.coalesce(f"__{p}_begun", F.lit(0)) + F.coalesce(f"__{p}_open", F.lit(0))
    n = zero("n")
    made = {
        "mean": lambda: zero("s") / n, "sum": lambda: zero("s"), "count": lambda: n,
        "min": lambda: F.least("__lo_begun", "__lo_open") if rows > 1 else F.col("__lo_begun"),
        "max": lambda: F.greatest("__hi_begun", "__hi_open") if rows > 1 else F.col("__hi_begun"),
    }
    results = [(made[s]() if s == "count" else F.when(n >= least, made[s]())).alias(name) for s, name in zip(statistics, names)]
    return met.select(*[col(c) for c in df.columns], *results)


def _positions(df: DataFrame, row_id: str) -> DataFrame:
    """The rows with ``__pos``, their place in row order from 0."""
    ends = df.agg(F.min(col(row_id)).alias("lo"), F.max(col(row_id)).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"] or ends["hi"] - ends["lo"] + 1 == ends["n"]:
        return df.withColumn("__pos", (col(row_id) - F.lit(ends["lo"] or 0)).cast("long"))
    return assign_row_id(df, [row_id], "__pos")
