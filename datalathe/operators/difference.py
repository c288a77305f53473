"""What changed between two tables with the same row ids, cell by cell.

Rows that are equal on both sides cancel by a 128-bit hash per row, so only ids and hashes
of the whole tables are shuffled; full rows are read again for changed ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from datalathe.functions.kinds import ROW_ID, data_columns, require_column
from datalathe.functions.scalars import col, present

SCHEMA = "change string, row_id long, column string, old string, new string, rows long"
_KEYS = ["__id", "__h1", "__h2"]


def difference(before: DataFrame, after: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """``(change, row_id, column, old, new, rows)``; values are shown as text.

    - ``changed``: a cell of a row that both tables have under its id. NaN and NULL are both missing.
    - ``deleted``, ``inserted``: ``rows`` rows under an id without a counterpart. Equal rows under one id cancel one
      by one; where several different rows of an id are left on a side, they count as deleted and inserted.
    - ``column_added``, ``column_dropped``, ``column_retyped``: the types are ``old`` and ``new``. Cells of columns
      that only one table has are not compared; those of retyped columns are compared as text.

    Rows without id are compared with one another like rows of one id. Empty tables give no or only one-sided rows.
    """
    for side in (before, after):
        require_column(side, row_id)
    shared = [c for c in data_columns(before, row_id) if c in after.columns]
    types = {c: before.schema[c].dataType if before.schema[c].dataType == after.schema[c].dataType else T.StringType() for c in shared}
    old, new = _keyed(before, types, row_id), _keyed(after, types, row_id)

    sides = old.select(*_KEYS, F.lit(1).alias("__n")).unionAll(new.select(*_KEYS, F.lit(-1).alias("__n")))
    left = sides.groupBy(*_KEYS).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    gone, come = F.greatest(F.col("__n"), F.lit(0)), F.greatest(-F.col("__n"), F.lit(0))
    # One row per id: how many rows are left on each side, and the hashes of the one left where it is one.
    ids = left.groupBy("__id").agg(
        F.sum(gone).alias("__gone"),
        F.sum(come).alias("__come"),
        *[F.max(F.when(F.col("__n") > 0, F.col(h))).alias(f"{h}_old") for h in _KEYS[1:]],
        *[F.max(F.when(F.col("__n") < 0, F.col(h))).alias(f"{h}_new") for h in _KEYS[1:]],
    )
    paired = F.expr("__gone = 1 AND __come = 1 AND __id IS NOT NULL")
    rows = ids.where(~paired).selectExpr(
        "inline(filter(array("
        "struct('deleted' AS change, __id AS row_id, __gone AS rows), "
        "struct('inserted' AS change, __id AS row_id, __come AS rows)), x -> x.rows > 0))"
    )
    empty = F.lit(None).cast("string")
    out = rows.select("change", "row_id", empty.alias("column"), empty.alias("old"), empty.alias("new"), "rows")
    if shared:
        out = out.unionByName(_cells(old, new, ids.where(paired), shared))
    return out.unionByName(_schema_changes(before, after, row_id))


def _keyed(df: DataFrame, types: dict[str, T.DataType], row_id: str) -> DataFrame:
    """Id, two hashes and the compared columns as ``c<i>``."""
    values = [present(df, c).cast(t) for c, t in types.items()]
    # A missing value has its own place in the hash, so that it cannot be taken for a shift of its neighbours.
    gaps = F.concat(F.lit(""), *[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return df.select(
        col(row_id).cast("long").alias("__id"),
        F.xxhash64(F.lit(1), gaps, *values).alias("__h1"),
        F.xxhash64(F.lit(2), *values, gaps).alias("__h2"),
        *[v.alias(f"c{i}") for i, v in enumerate(values)],
    )


def _cells(old: DataFrame, new: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    sides = []
    for name, frame in (("old", old), ("new", new)):
        wanted = pairs.select("__id", *[F.col(f"{h}_{name}").alias(h) for h in _KEYS[1:]])
        # Rows repeated under their id stand for one another.
        found = frame.join(wanted, _KEYS).dropDuplicates(_KEYS)
        sides.append(found.select("__id", *[F.col(f"c{i}").alias(f"{name}{i}") for i in range(len(columns))]))
    cells = F.array(*[_cell(c, F.col(f"old{i}"), F.col(f"new{i}")) for i, c in enumerate(columns)])
    changed = F.inline(F.filter(cells, lambda x: x["differs"]))
    return sides[0].join(sides[1], "__id").select(F.col("__id").alias("row_id"), changed).select(
        F.lit("changed").alias("change"), "row_id", "column", "old", "new", F.lit(1).cast("long").alias("rows")
    )


def _cell(column: str, old: Column, new: Column) -> Column:
    return F.struct(
        (~old.eqNullSafe(new)).alias("differs"),
        F.lit(column).alias("column"),
        old.cast("string").alias("old"),
        new.cast("string").alias("new"),
    )


def _schema_changes(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    a = {f.name: f.dataType.simpleString() for f in before.schema.fields if f.name != row_id}
    b = {f.name: f.dataType.simpleString() for f in after.schema.fields if f.name != row_id}
    out = [("column_dropped", None, c, a[c], None, None) for c in a if c not in b]
    out += [("column_added", None, c, None, b[c], None) for c in b if c not in a]
    out += [("column_retyped", None, c, a[c], b[c], None) for c in a if c in b and a[c] != b[c]]
    return before.sparkSession.createDataFrame(out, SCHEMA)
