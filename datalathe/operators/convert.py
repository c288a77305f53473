"""Conversion of one column to another type, with a preview of what would be lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from datalathe.functions.kinds import ROW_ID, kind_of, require_column
from datalathe.functions.scalars import col, missing, non_nan, parse_timestamp, present, strip
from datalathe.operators.layouts import fit_datetime
from datalathe.operators.steps import Fitted

TARGETS = ("datetime", "integer", "category", "float", "string")


def converted(df: DataFrame, column: str, target_type: str) -> Column:
    """The converted column; values that do not fit become NULL."""
    require_column(df, column)
    c = present(df, column)
    kind = kind_of(T.StructField(column, df.schema[column].dataType))  # of the values, whatever the tag
    if target_type == "datetime":
        if kind == "datetime":
            return c
        if kind in ("integer", "float"):
            return F.timestamp_micros((c / F.lit(1000)).cast("long"))  # numbers count nanoseconds
        return parse_timestamp(c.cast("string"))
    if target_type == "integer":
        if kind == "integer":
            return c.cast("long")
        return F.rint(_as_double(c, kind)).try_cast("long")
    if target_type == "float":
        return _as_double(c, kind)
    if target_type == "category":
        return c  # the values stay what they are; the column is tagged
    if target_type == "string":
        return c.cast("string")
    raise ValueError(f"unsupported target type '{target_type}'")


def _as_double(c: Column, kind: str) -> Column:
    if kind in ("string", "category"):
        text = strip(c)
        # Java also reads "1d" and "1f" as numbers; here they are text.
        return non_nan(F.when(~text.rlike(r"[0-9.][dDfF]$"), text).try_cast("double"))
    if kind == "datetime":
        return F.unix_micros(c.cast("timestamp")).cast("double") * 1000.0
    return c.cast("double")


def fit_convert(df: DataFrame, column: str, target_type: str, layouts: str | None = None) -> Fitted:
    """``layouts="infer"`` reads dates in text by the layouts that the column itself shows."""
    if target_type not in TARGETS:
        raise ValueError(f"unsupported target type '{target_type}'")
    require_column(df, column)
    if layouts not in (None, "infer") or (layouts and target_type != "datetime"):
        raise ValueError("layouts can be inferred for dates only")
    if layouts and df.schema[column].dataType.simpleString() == "string":
        return fit_datetime(df, column)
    return to_type(column, target_type)


def to_type(column: str, target_type: str) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        tag = {"logical_type": "categorical"} if target_type == "category" else {}
        new = converted(d, column, target_type).alias(column, metadata=tag)
        return d.select(*[new if n == column else col(n) for n in d.columns])

    return Fitted("convert_dtype", {"column": column, "target_type": target_type}, transform=transform)


def convert(df: DataFrame, column: str, target_type: str, layouts: str | None = None) -> DataFrame:
    return fit_convert(df, column, target_type, layouts).apply(df)


def preview_conversion(
    df: DataFrame, column: str, target_type: str, row_id: str | None = ROW_ID, sample: int = 5
) -> dict:
    """Types and missing counts before and after from one aggregate, and a few values side by side."""
    after_df = convert(df, column, target_type)
    after_field = after_df.schema[column]
    after = converted(df, column, target_type)
    counts = df.agg(
        F.count_if(missing(df, column)).alias("before"), F.count_if(after.isNull()).alias("after")
    ).first()
    rows = df.where(~missing(df, column))
    if row_id is not None and row_id in df.columns:
        rows = rows.orderBy(col(row_id))
    shown = rows.select(col(column).alias("b"), after.alias("a")).limit(sample).collect()
    return {
        "column": column,
        "before_dtype": df.schema[column].dataType.simpleString(),
        "after_dtype": "category" if target_type == "category" else after_field.dataType.simpleString(),
        "before_missing": counts["before"],
        "after_missing": counts["after"],
        "newly_invalid_count": counts["after"] - counts["before"],
        "sample_before": [r["b"] for r in shown],
        "sample_after": [r["a"] for r in shown],
    }
