"""Outlier detection and treatment by IQR, z-score and modified z-score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import ROW_ID, require_numeric
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import col, non_nan, percent
from datalathe.operators.steps import Fitted

# Multipliers and thresholds of the three methods.
IQR_MULTIPLIER = 1.5
Z_THRESHOLD = 3.0
MODIFIED_Z_THRESHOLD = 3.5
MAD_TO_SIGMA = 0.6745

METHODS = ("iqr", "zscore", "modified_zscore")
ACTIONS = ("remove", "cap")


def fit_bounds(df: DataFrame, columns: list[str], method: str = "iqr") -> dict[str, dict]:
    """Centre, spread and bounds of several columns; shared map-side passes for all of them."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method '{method}'")
    values = {c: col(c) for c in columns}
    out = {}
    if method == "iqr":
        for c, (q1, q3) in exact_quantiles(df, values, (0.25, 0.75)).items():
            out[c] = iqr_bounds(q1, q3)
    elif method == "zscore":
        row = df.agg(
            *[F.avg(non_nan(v)).alias(f"m{i}") for i, v in enumerate(values.values())],
            *[F.stddev_samp(non_nan(v)).alias(f"s{i}") for i, v in enumerate(values.values())],
        ).first()
        for i, c in enumerate(columns):
            out[c] = _around(row[f"m{i}"], row[f"s{i}"], Z_THRESHOLD, 1.0)
    else:
        medians = {c: m for c, (m,) in exact_quantiles(df, values, (0.5,)).items()}
        deviations = {c: F.abs(non_nan(v) - F.lit(medians[c])) for c, v in values.items() if medians[c] is not None}
        mads = {c: m for c, (m,) in exact_quantiles(df, deviations, (0.5,)).items()}
        for c in columns:
            out[c] = _around(medians[c], mads.get(c), MODIFIED_Z_THRESHOLD, MAD_TO_SIGMA)
    return out


def iqr_bounds(q1: float | None, q3: float | None) -> dict:
    if q1 is None:
        return {"center": None, "spread": None, "lower": None, "upper": None}
    iqr = q3 - q1
    return {
        "center": None,
        "spread": iqr,
        "lower": q1 - IQR_MULTIPLIER * iqr,
        "upper": q3 + IQR_MULTIPLIER * iqr,
    }


def _around(center, spread, threshold, scale) -> dict:
    usable = spread is not None and spread > 0
    reach = threshold * spread / scale if usable else None
    return {
        "center": center,
        "spread": spread,
        "lower": center - reach if usable else None,
        "upper": center + reach if usable else None,
    }


def outlier_mask(value: Column, method: str, bounds: dict) -> Column:
    """True for an outlier, false otherwise and for missing values."""
    v = non_nan(value)
    if bounds["lower"] is None:
        return F.lit(False)
    if method == "iqr":
        mask = (v < F.lit(bounds["lower"])) | (v > F.lit(bounds["upper"]))
    elif method == "zscore":
        mask = F.abs((v - F.lit(bounds["center"])) / F.lit(bounds["spread"])) > F.lit(Z_THRESHOLD)
    else:
        z = F.lit(MAD_TO_SIGMA) * (v - F.lit(bounds["center"])) / F.lit(bounds["spread"])
        mask = F.abs(z) > F.lit(MODIFIED_Z_THRESHOLD)
    return F.coalesce(mask, F.lit(False))


def outlier_counts(df: DataFrame, columns: list[str], method: str = "iqr", bounds=None) -> DataFrame:
    """``(column, outlier_count, outlier_percentage)`` of several columns from one map-side pass."""
    bounds = bounds or fit_bounds(df, columns, method)
    wide = df.agg(
        *[F.count(non_nan(col(c))).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(outlier_mask(col(c), method, bounds[c])).alias(f"o{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"o{i}").alias("outlier_count"),
            percent(F.col(f"o{i}"), F.col(f"n{i}")).alias("outlier_percentage"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


def detect_outliers(
    df: DataFrame, column: str, method: str = "iqr", row_id: str = ROW_ID, sample: int = 20
) -> dict:
    """Count and share of outliers, and the first ones in row order."""
    require_numeric(df, column, "outlier detection")
    bounds = fit_bounds(df, [column], method)
    counted = outlier_counts(df, [column], method, bounds).first()
    first = (
        df.where(outlier_mask(col(column), method, bounds[column]))
        .select(col(row_id).alias("row_id"), col(column).alias("value"))
        .orderBy("row_id")
        .limit(sample)
        .collect()
    )
    return {
        "column": column,
        "method": method,
        "outlier_count": counted["outlier_count"],
        "outlier_percentage": counted["outlier_percentage"],
        "outlier_values": [r["value"] for r in first],
        "outlier_indices": [r["row_id"] for r in first],
    }


def fit_outliers(df: DataFrame, column: str, method: str, action: str) -> Fitted:
    require_numeric(df, column, "outlier treatment")
    if action not in ACTIONS:
        raise ValueError(f"unknown outlier action '{action}'")
    return treated(column, method, action, fit_bounds(df, [column], method)[column])


def treated(column: str, method: str, action: str, bounds: dict) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        if action == "remove":
            return d.where(~outlier_mask(col(column), method, bounds))
        return d.withColumn(column, capped(col(column), bounds))

    return Fitted(
        "outlier_treatment", {"column": column, "method": method, "action": action}, {"bounds": bounds}, transform
    )


def capped(value: Column, bounds: dict) -> Column:
    """Value clipped to the bounds as double; missing stays missing, no spread means no change."""
    v = non_nan(value)
    if bounds["lower"] is None:
        return value.cast("double")
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(bounds["upper"])), F.lit(bounds["lower"])))


def remove_outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    return fit_outliers(df, column, method, "remove").apply(df)


def cap_outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    return fit_outliers(df, column, method, "cap").apply(df)
