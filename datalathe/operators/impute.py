"""Missing-value treatment: strategies, preview and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from datalathe.functions.kinds import ROW_ID, is_numeric, kind_of, require_column
from datalathe.functions.ordering import BUCKET_ROWS, carry_fill
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import col, missing, non_nan, present
from datalathe.operators.neighbours import feature_columns, fill_from_neighbours, scales
from datalathe.operators.profile import summarize_columns, value_histogram
from datalathe.operators.steps import Fitted
from datalathe.session import cut_lineage, plain_result

# The strategies by name.
STRATEGIES = ("mean", "median", "mode", "constant", "forward_fill", "backward_fill", "drop_rows")
#: Strategies of this library's own; their fills come from other rows, as with forward and backward fill.
KNN, NEIGHBOURS = "knn", 5
FROM_ROWS = ("forward_fill", "backward_fill", KNN)


def validate_strategy(df: DataFrame, column: str, strategy: str) -> None:
    require_column(df, column)
    if strategy not in (*STRATEGIES, KNN):
        raise ValueError(f"unknown imputation strategy '{strategy}'")
    if strategy in ("mean", "median") and not is_numeric(df, column):
        kind = df.schema[column].dataType.simpleString()
        raise ValueError(f"column '{column}' holds {kind}: no {strategy} of it can be computed, that needs numbers")


def smallest_mode(df: DataFrame, column: str):
    """Most frequent value, the smallest of tied ones; counted map-side, found by one aggregate."""
    t = df.schema[column].dataType
    hist = value_histogram(df, [column], t.simpleString())
    return hist.agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("m")).first()["m"]


def fill_value(df: DataFrame, column: str, strategy: str, constant_value=None):
    """The single value a value-based strategy fills in; None leaves the column as it is."""
    if strategy == "mean":
        return df.agg(F.avg(non_nan(col(column))).alias("m")).first()["m"]
    if strategy == "median":
        return exact_quantiles(df, {column: col(column)}, (0.5,))[column][0]
    if strategy == "mode":
        return smallest_mode(df, column)
    if constant_value is None:
        raise ValueError("no constant_value to fill in was given")
    target = df.schema[column].dataType
    cast = df.sparkSession.range(1).select(F.lit(constant_value).try_cast(target).alias("v")).first()["v"]
    if cast is None:
        raise ValueError(f"'{constant_value}' cannot be stored in the {target.simpleString()} column '{column}'")
    return cast


def filled(df: DataFrame, column: str, value) -> Column:
    """The column with missing cells set to ``value``; a fractional fill widens integers to double."""
    c = present(df, column)
    t = df.schema[column].dataType
    if value is None:
        return col(column)
    if kind_of(df.schema[column]) == "integer" and isinstance(value, float):
        if value != int(value):
            return F.coalesce(c.cast("double"), F.lit(value))
        value = int(value)
    if isinstance(t, T.DecimalType) and isinstance(value, float):
        return F.coalesce(c.cast("double"), F.lit(value))
    return F.coalesce(c, F.lit(value).cast(t))


def fit_impute(
    df: DataFrame,
    column: str,
    strategy: str,
    constant_value=None,
    row_id: str = ROW_ID,
    bucket_rows: int = BUCKET_ROWS,
    features: list[str] | None = None,
    neighbours: int = NEIGHBOURS,
) -> Fitted:
    """``features`` and ``neighbours`` belong to the strategy ``knn``, whose fills come from the rows it was fitted on."""
    validate_strategy(df, column, strategy)
    params = {"column": column, "strategy": strategy, "constant_value": constant_value}
    if strategy == "drop_rows":
        return without_missing(column)
    if strategy == KNN:
        require_column(df, row_id)
        if neighbours < 1:
            raise ValueError("at least one neighbour is needed")
        names = feature_columns(df, column, features, row_id)
        by = scales(df, names)
        return Fitted(
            "impute",
            params | {"features": names, "neighbours": neighbours},
            {"scales": {c: list(s) for c, s in by.items()}},
            lambda d: fill_from_neighbours(d, df, column, by, neighbours, row_id),
        )
    if strategy in ("forward_fill", "backward_fill"):
        require_column(df, row_id)
        return Fitted(
            "impute",
            params,
            transform=lambda d: carry_fill(d, [column], row_id, strategy == "backward_fill", bucket_rows),
        )
    return filled_with(column, strategy, constant_value, fill_value(df, column, strategy, constant_value))


def without_missing(column: str) -> Fitted:
    params = {"column": column, "strategy": "drop_rows", "constant_value": None}
    return Fitted("impute", params, transform=lambda d: d.where(~missing(d, column)))


def filled_with(column: str, strategy: str, constant_value, value) -> Fitted:
    params = {"column": column, "strategy": strategy, "constant_value": constant_value}
    return Fitted("impute", params, {"value": value}, lambda d: d.withColumn(column, filled(d, column, value)))


def impute(df: DataFrame, column: str, strategy: str, constant_value=None, row_id: str = ROW_ID, **kw) -> DataFrame:
    return fit_impute(df, column, strategy, constant_value, row_id, **kw).apply(df)


@plain_result
def preview_imputation(
    df: DataFrame, column: str, strategy: str, constant_value=None, row_id: str = ROW_ID, sample: int = 5
) -> dict:
    """Summary before and after, and the first rows that were missing with their new value."""
    after = impute(df, column, strategy, constant_value, row_id)
    if strategy in FROM_ROWS:
        # Both summaries and the sample read the filled column; its shuffle runs once.
        after = cut_lineage(after.select(col(row_id), col(column)))
    marked = df.where(missing(df, column)).select(col(row_id).alias("row_id")).orderBy("row_id").limit(sample)
    ids = [r["row_id"] for r in marked.collect()]
    values: list = []
    if strategy != "drop_rows" and ids:
        found = after.where(col(row_id).isin(ids)).select(col(row_id).alias("r"), col(column).alias("v")).collect()
        by_id = {r["r"]: r["v"] for r in found}
        values = [by_id[i] for i in ids]
    return {
        "column": column,
        "strategy": strategy,
        "before": summarize_columns(df, {column: None}, column)[column],
        "after": summarize_columns(after, {column: None}, column)[column],
        "sample_rows": ids,
        "sample_before": ["NaN"] * len(ids),
        "sample_after": values,
    }


@plain_result
def compare_strategies(df: DataFrame, column: str, strategy_a: str, strategy_b: str, row_id: str = ROW_ID) -> dict:
    """Summaries of the original column and of two strategies.

    Strategies that fill one value share their passes over the data.
    """
    result = {"column": column, "strategy_a": strategy_a, "strategy_b": strategy_b}
    shared, single = {"before": col(column)}, {}
    for key, strategy in (("after_a", strategy_a), ("after_b", strategy_b)):
        validate_strategy(df, column, strategy)
        if strategy in ("mean", "median", "mode", "constant"):
            shared[key] = filled(df, column, fill_value(df, column, strategy))
        else:
            single[key] = strategy
    result.update(summarize_columns(df, shared, column))
    for key, strategy in single.items():
        treated = impute(df, column, strategy, None, row_id).select(col(row_id), col(column))
        treated = treated if strategy == "drop_rows" else cut_lineage(treated)  # the fill's shuffle runs once
        result[key] = summarize_columns(treated, {column: None}, column)[column]
    return result
