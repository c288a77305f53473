"""Column scaling. Each fit is one aggregate (or one quantile search), each apply one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datalathe.functions.kinds import require_numeric
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import col, non_nan
from datalathe.operators.steps import Fitted

METHODS = ("standard", "minmax", "robust", "maxabs", "normalize")


def fit_scale(df: DataFrame, column: str, method: str) -> Fitted:
    """Learn ``offset`` and ``divisor``; a zero divisor leaves the shifted values undivided."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method '{method}'")
    require_numeric(df, column, "scaling")
    v = non_nan(col(column))
    if method == "robust":
        q1, median, q3 = exact_quantiles(df, {column: v}, (0.25, 0.5, 0.75))[column]
        offset, divisor = median, None if q1 is None else q3 - q1
    else:
        offset, divisor = df.agg(*_LEARN[method](v)).first()
    return scaled(column, method, {"offset": offset, "divisor": divisor})


def scaled(column: str, method: str, state: dict) -> Fitted:
    offset, divisor = state["offset"], state["divisor"]

    def transform(d: DataFrame) -> DataFrame:
        x = non_nan(col(column))
        if offset is not None and offset != 0.0:
            x = x - F.lit(float(offset))
        if divisor:
            x = x / F.lit(float(divisor))
        return d.withColumn(column, x)

    return Fitted("scale", {"column": column, "method": method}, state, transform)


_LEARN = {
    "standard": lambda v: (F.avg(v), F.stddev_samp(v)),
    "minmax": lambda v: (F.min(v), F.max(v) - F.min(v)),
    "maxabs": lambda v: (F.lit(0.0), F.max(F.abs(v))),
    "normalize": lambda v: (F.lit(0.0), F.sqrt(F.sum(v * v))),
}


def scale(df: DataFrame, column: str, method: str) -> DataFrame:
    return fit_scale(df, column, method).apply(df)
