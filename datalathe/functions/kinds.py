"""Physical kinds of columns and the few schema checks operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

ROW_ID = "__row_id"

LOGICAL_TYPES = ("numerical", "categorical", "boolean", "datetime", "text", "id", "multi_label", "mixed")


def kind_of(field: T.StructField) -> str:
    """integer, float, boolean, datetime, string, category or other."""
    t = field.dataType
    if (field.metadata or {}).get("logical_type") == "categorical":
        return "category"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def is_numeric(df: DataFrame, column: str) -> bool:
    return kind_of(df.schema[column]) in ("integer", "float")


def data_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    """All columns except the row id."""
    return [c for c in df.columns if c != row_id]


def numeric_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    return [c for c in data_columns(df, row_id) if is_numeric(df, c)]


def require_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise KeyError(f"column '{column}' not found")


def require_numeric(df: DataFrame, column: str, what: str) -> None:
    require_column(df, column)
    if not is_numeric(df, column):
        raise ValueError(
            f"{what} requires a numeric column, but '{column}' is {df.schema[column].dataType.simpleString()}"
        )
