"""Facts about columns and about the dataset, in shared passes over the data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

from datalathe.functions.kinds import ROW_ID, data_columns
from datalathe.operators.association import HIGH_CORRELATION, high_pairs
from datalathe.operators.measure import classified, measure, type_map
from datalathe.operators.profile import profiles_from
from datalathe.operators.quality import duplicate_columns, duplicate_rows
from datalathe.operators.types import CATEGORY_DTYPE_MAX_RATIO, DATETIME_MIN_PARSED
from datalathe.session import together

NUMBER_FACTS = ("mean", "median", "std", "variance", "minimum", "maximum", "range", "skewness", "kurtosis")

COLUMN_FACTS = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("effective_type", T.StringType()),
        T.StructField("missing_pct", T.DoubleType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("cardinality_ratio", T.DoubleType()),
        T.StructField("count", T.LongType()),
        *[T.StructField(n, T.DoubleType()) for n in NUMBER_FACTS],
        T.StructField("has_whitespace", T.BooleanType()),
        T.StructField("has_case_inconsistency", T.BooleanType()),
        T.StructField("is_constant", T.BooleanType()),
        T.StructField("is_low_variance", T.BooleanType()),
        T.StructField("is_datetime_convertible", T.BooleanType()),
        T.StructField("is_int_convertible", T.BooleanType()),
        T.StructField("is_category_beneficial", T.BooleanType()),
        T.StructField("outlier_pct", T.DoubleType()),
    ]
)

DATASET_FACTS = T.StructType(
    [
        T.StructField("duplicate_row_pct", T.DoubleType()),
        T.StructField("duplicate_row_count", T.LongType()),
        T.StructField("duplicate_column_count", T.LongType()),
        T.StructField("high_correlation_pair_count", T.LongType()),
    ]
)


@dataclass
class Facts:
    """Everything the reports need about one DataFrame, computed once."""

    df: DataFrame
    columns: list[str]
    types: dict[str, tuple[str, str, bool]]
    profiles: dict[str, dict]
    column_rows: list[tuple]
    dataset_row: tuple | None = None
    rows: int = 0
    extra: dict = field(default_factory=dict)

    def column_frame(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.column_rows, COLUMN_FACTS)

    def dataset_frame(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame([self.dataset_row], DATASET_FACTS)


def collect_facts(
    df: DataFrame,
    overrides: dict[str, str] | None = None,
    row_id: str | None = ROW_ID,
    columns: list[str] | None = None,
    dataset: bool = True,
) -> Facts:
    """Facts of the given columns and, unless told otherwise, of the whole dataset."""
    columns = columns or data_columns(df, row_id)
    m = measure(df, columns, row_id, numbers=True, flags=True, other=dataset_jobs(df, row_id) if dataset else None)
    types = type_map(classified(df, m, overrides))
    profiles = profiles_from(df, m, {c: t[1] for c, t in types.items()})
    flags = {
        c: {
            "has_whitespace": m.padded.get(c, False),
            "has_case_inconsistency": m.mixed.get(c, False),
            "is_datetime_convertible": (m.samples.get(c, {}).get("parsed") or 0.0) >= DATETIME_MIN_PARSED,
            "is_int_convertible": m.whole.get(c, False),
            "is_category_beneficial": c in m.texts
            and profiles[c]["cardinality_ratio"] < CATEGORY_DTYPE_MAX_RATIO,
        }
        for c in columns
    }
    rows = [_column_row(i, c, types[c][1], profiles[c], flags[c], m.outliers) for i, c in enumerate(columns)]
    return Facts(
        df, columns, types, profiles, rows, dataset_row(m.other) if dataset else None, m.rows, {"outliers": m.outliers}
    )


def _column_row(position, column, effective, p, flags, outliers) -> tuple:
    unique, ratio = p["unique_count"], p["cardinality_ratio"]
    # A statistic that was not computed counts as 0. The shape of a constant column is
    # undefined rather than 0, so it stays NULL and no condition on it holds.
    undefined = ("skewness", "kurtosis") if p.get("minimum") is not None and p["count"] >= 3 else ()
    numbers = [p.get(n) if p.get(n) is not None or n in undefined else 0.0 for n in NUMBER_FACTS]
    return (
        position, column, effective, p["missing_percentage"], p["missing_count"], unique, ratio, p["count"],
        *numbers,
        flags["has_whitespace"], flags["has_case_inconsistency"], unique == 1, unique > 1 and ratio < 0.01,
        flags["is_datetime_convertible"], flags["is_int_convertible"], flags["is_category_beneficial"],
        outliers[column]["outlier_percentage"] if column in outliers else 0.0,
    )


def dataset_jobs(df: DataFrame, row_id: str | None) -> dict:
    return {
        "duplicates": lambda: duplicate_rows(df, row_id).first(),
        "equal_columns": lambda: len(duplicate_columns(df, row_id)),
        "strong": lambda: high_pairs(df, HIGH_CORRELATION, row_id).count(),
    }


def dataset_row(done: dict) -> tuple:
    return (done["duplicates"]["percentage"], done["duplicates"]["count"], done["equal_columns"], done["strong"])


def column_facts(df: DataFrame, overrides=None, row_id: str | None = ROW_ID) -> DataFrame:
    """One row of facts per column."""
    return collect_facts(df, overrides, row_id, dataset=False).column_frame()


def dataset_facts(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    """One row: repeated rows and columns, and strongly correlated pairs."""
    done = together(df.sparkSession, dataset_jobs(df, row_id))
    return df.sparkSession.createDataFrame([dataset_row(done)], DATASET_FACTS)
