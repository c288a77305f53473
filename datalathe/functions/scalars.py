"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters Python's str.strip() removes; none lies beyond the ideographic space.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Date layouts tried after the ISO layout, month before day.
DATE_LAYOUTS = (
    "yyyy/M/d",
    "yyyy/M/d H:mm",
    "yyyy/M/d H:mm:ss",
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M-d-yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "yyyyMMdd",
)


def col(name: str) -> Column:
    """A column by its literal name; dots and backticks are not special."""
    return F.col(q(name))


def q(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def number(x: float) -> str:
    """A double literal for SQL text."""
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def text(s: str) -> str:
    """A string literal for SQL text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_sql(df: DataFrame, column: str) -> str:
    """SQL text of the column with NaN turned into NULL."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return f"nanvl({q(column)}, NULL)"
    return q(column)


def number_sql(column: str) -> str:
    """SQL text of a numeric column as double, with NaN turned into NULL."""
    return f"nanvl(double({q(column)}), NULL)"


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into NULL."""
    return F.expr(value_sql(df, column))


def missing(df: DataFrame, column: str) -> Column:
    """True for NULL, and for NaN in floating columns."""
    return F.expr(f"{value_sql(df, column)} IS NULL")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def round_dp(c: Column, digits: int) -> Column:
    """Half-even rounding at ``digits`` decimals; never yields a negative zero."""
    scale = float(10**digits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def round_py(x: float | None, digits: int) -> float | None:
    """``round_dp`` for a value already on the driver."""
    if x is None:
        return None
    scale = 10.0**digits
    return round(x * scale) / scale + 0.0


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent at two decimals, 0 for an empty whole."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(round_dp(ratio * 100.0, 2), F.lit(0.0))


def non_nan(c: Column) -> Column:
    """Double value with NaN turned into NULL."""
    return F.nanvl(c.cast("double"), F.lit(None))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def parse_timestamp(c: Column) -> Column:
    """First layout that parses wins; text that fits none becomes NULL.

    The ISO cast also accepts bare times of day, which are not dates, so it is
    tried only on text that starts with a four-digit year.
    """
    trimmed = strip(c)
    iso = F.when(trimmed.rlike(r"^\d{4}($|-)"), trimmed.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(trimmed, F.lit(layout)) for layout in DATE_LAYOUTS])


def tokens(c: Column, delimiter: str) -> Column:
    """Trimmed parts of a delimited text; empty parts are kept."""
    literal = r"\Q" + delimiter + r"\E"
    return F.transform(F.split(c, literal), lambda t: strip(t))
