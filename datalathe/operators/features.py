"""Columns made from one column by an expression: clean text, parts of dates, sizes, ranges, cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import kind_of, require_column, require_numeric
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import col, non_nan, parse_timestamp, present, strip as stripped, word_count
from datalathe.operators.steps import Fitted

CASES = {"lower": F.lower, "upper": F.upper, "title": F.initcap}
# Parts by name; the week starts on Monday as day 0.
PARTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
    "day_of_week": F.weekday, "day_of_year": F.dayofyear, "week": F.weekofyear,
}
UNITS = {"days": 86_400, "hours": 3_600, "minutes": 60, "seconds": 1}
BINNINGS = ("equal_width", "quantile")


def _text(df: DataFrame, column: str) -> Column:
    require_column(df, column)
    if kind_of(df.schema[column]) not in ("string", "category") or df.schema[column].dataType.simpleString() != "string":
        raise ValueError(f"'{column}' holds {df.schema[column].dataType.simpleString()}, not text")
    return col(column)


def _instant(df: DataFrame, column: str) -> Column:
    require_column(df, column)
    kind = kind_of(df.schema[column])
    if kind not in ("datetime", "string"):
        raise ValueError(f"'{column}' holds neither dates nor text")
    return col(column) if kind == "datetime" else parse_timestamp(col(column))


def _replaced(df: DataFrame, column: str, new: Column) -> DataFrame:
    return df.withColumn(column, new.alias(column, metadata=df.schema[column].metadata))


def _with(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    taken = {c.lower() for c in df.columns} & {c.lower() for c in new}
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already")
    return df.withColumns(new)


def strip(df: DataFrame, column: str) -> DataFrame:
    """Text without surrounding white space."""
    return _replaced(df, column, stripped(_text(df, column)))


def change_case(df: DataFrame, column: str, case: str = "lower") -> DataFrame:
    """Text in one casing: lower, upper or title."""
    if case not in CASES:
        raise ValueError(f"unknown case '{case}'")
    return _replaced(df, column, CASES[case](_text(df, column)))


def date_parts(df: DataFrame, column: str, parts: list[str] | None = None) -> DataFrame:
    """One integer column per part, named after it; missing dates have missing parts."""
    parts = parts or ["year", "month", "day_of_week"]
    unknown = [p for p in parts if p not in PARTS]
    if unknown:
        raise ValueError(f"unknown date parts {unknown}")
    instant = _instant(df, column)
    return _with(df, {f"{column}_{p}": PARTS[p](instant) for p in parts})


def fit_elapsed(df: DataFrame, column: str, until: str | None = None, unit: str = "days") -> Fitted:
    """Time from the column to ``until``, by default the latest date in it, as a number of units."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit '{unit}'")
    instant = _instant(df, column).cast("timestamp")
    end = F.to_timestamp(F.lit(until)) if until else None
    last = (df.agg(F.unix_micros(F.max(instant))) if end is None else df.sparkSession.range(1).select(F.unix_micros(end))).first()[0]

    return elapsed_until(column, unit, last, until)


def elapsed_until(column: str, unit: str, last: int | None, end: str | None) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        gone = (F.lit(last) - F.unix_micros(_instant(d, column).cast("timestamp"))) / (UNITS[unit] * 1e6)
        return _with(d, {f"{column}_{unit}": gone})

    return Fitted("elapsed", {"column": column, "until": end, "unit": unit}, {"until_micros": last}, transform)


def text_size(df: DataFrame, column: str) -> DataFrame:
    """Characters and words of a text; missing texts have missing sizes."""
    c = _text(df, column)
    words = F.when(c.isNotNull(), word_count(c)).cast("long")
    return _with(df, {f"{column}_length": F.length(c).cast("long"), f"{column}_words": words})


def fit_bin(df: DataFrame, column: str, bins: int = 10, method: str = "equal_width") -> Fitted:
    """The number of the range a value lies in, from 0; ranges are closed on the left, the last one on both sides."""
    require_numeric(df, column, "binning")
    if bins < 1 or method not in BINNINGS:
        raise ValueError("binning needs a positive number of bins and a known method")
    if method == "quantile":
        edges = exact_quantiles(df, {column: col(column)}, tuple(i / bins for i in range(bins + 1)))[column]
    else:
        ends = df.agg(F.min(non_nan(col(column))).alias("lo"), F.max(non_nan(col(column))).alias("hi")).first()
        edges = [] if ends["lo"] is None else [ends["lo"] + i * (ends["hi"] - ends["lo"]) / bins for i in range(bins + 1)]
    return binned(column, bins, method, list(edges))


def binned(column: str, bins: int, method: str, edges: list) -> Fitted:
    inner = sorted({e for e in edges[1:-1] if e is not None and e > edges[0]})

    def transform(d: DataFrame) -> DataFrame:
        value = present(d, column).cast("double")
        passed = sum((F.when(value >= e, 1).otherwise(0) for e in inner), F.lit(0))
        return _with(d, {f"{column}_bin": F.when(value.isNotNull(), passed).cast("int")})

    return Fitted("bin", {"column": column, "bins": bins, "method": method}, {"edges": edges}, transform)


def cyclic(df: DataFrame, column: str, period: float) -> DataFrame:
    """Sine and cosine of the value's place in a period, so its end meets its start."""
    require_numeric(df, column, "cyclic encoding")
    if not period > 0:
        raise ValueError("a period is above 0")
    angle = present(df, column).cast("double") * F.lit(2 * math.pi / period)
    return _with(df, {f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})
