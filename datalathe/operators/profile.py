"""Column profiling: one pass of plain aggregates plus one value histogram.

The histogram ``(column, value, cnt)`` is counted map-side first, so a value that
holds a third of the rows travels as one row per task. Everything about distinct
values (unique count, mode, entropy) is then one more small aggregate over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from datalathe.functions.kinds import ROW_ID, data_columns, is_numeric, kind_of, require_column
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import (
    col,
    present,
    non_nan,
    number_sql,
    percent,
    q,
    round_dp,
    round_py,
    text,
    value_sql,
)

QUARTILES = (0.25, 0.5, 0.75)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("missing_percentage", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("cardinality_ratio", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("mode", T.StringType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("variance", T.DoubleType()),
        T.StructField("minimum", T.DoubleType()),
        T.StructField("maximum", T.DoubleType()),
        T.StructField("q1", T.DoubleType()),
        T.StructField("q3", T.DoubleType()),
        T.StructField("range", T.DoubleType()),
        T.StructField("skewness", T.DoubleType()),
        T.StructField("kurtosis", T.DoubleType()),
    ]
)


def count_aggs(df: DataFrame, columns: list[str]) -> list[Column]:
    """Map-side counts ``n<i>`` of the non-missing values of each column."""
    return [F.expr(f"count({value_sql(df, c)}) AS n{i}") for i, c in enumerate(columns)]


def tidy(wide: DataFrame, columns: list[str], fields) -> DataFrame:
    """One row per column from a single wide row; ``fields(i)`` is the SQL text of its fields."""
    entries = ", ".join(f"named_struct('column', {text(c)}, {_pairs(fields(i))})" for i, c in enumerate(columns))
    return wide.selectExpr(f"inline(array({entries}))")


def _pairs(fields: str) -> str:
    """``expr AS name, ...`` as the arguments of named_struct."""
    return ", ".join(f"'{name}', {expr}" for expr, name in (f.rsplit(" AS ", 1) for f in fields.split(", ")))


def base_counts(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, rows, count)`` for every column from a single map-side aggregate."""
    columns = columns or data_columns(df, row_id)
    wide = df.agg(F.expr("count(1) AS rows"), *count_aggs(df, columns))
    return tidy(wide, columns, lambda i: f"rows AS rows, n{i} AS count")


def _branches(df: DataFrame, columns: list[str]) -> list[tuple[list[str], str]]:
    """Columns that can share one unpivot, with the common type of their values."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        kind = kind_of(df.schema[c])
        t = df.schema[c].dataType
        if kind == "float":
            # Decimals keep their own branch: as doubles, distinct values could fall together.
            key = t.simpleString() if isinstance(t, T.DecimalType) else "double"
        elif kind == "integer":
            key = "bigint"
        elif kind == "category":
            key = "string"
        elif kind == "other":
            continue
        else:
            key = t.simpleString()
        groups.setdefault(key, []).append(c)
    return [(cs, key) for key, cs in groups.items()]


def value_histogram(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    """``(column, value, cnt)`` over non-missing values of columns of one type."""
    narrow = df.selectExpr(*[f"cast({value_sql(df, c)} AS {as_type}) AS {q(c)}" for c in columns])
    melted = narrow.unpivot([], [q(c) for c in columns], "column", "value")
    return melted.where("value IS NOT NULL").groupBy("column", "value").agg(F.expr("count(1) AS cnt"))


def summarize_histogram(hist: DataFrame) -> DataFrame:
    """unique_count, mode (smallest of the tied values) and entropy per column."""
    return hist.groupBy("column").agg(
        F.expr("count(1) AS unique_count"),
        F.expr("cast(min_by(value, struct(-cnt, value)) AS string) AS mode"),
        F.expr(
            "rint((log2(double(sum(cnt))) - sum(cnt * log2(double(cnt))) / sum(cnt)) * 10000D) / 10000D + 0D AS entropy"
        ),
    )


def distinct_summary(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, unique_count, mode, entropy)``; columns without any value are absent."""
    columns = columns or data_columns(df, row_id)
    parts = [summarize_histogram(value_histogram(df, cs, t)) for cs, t in _branches(df, columns)]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, unique_count long, mode string, entropy double")
    return reduce(DataFrame.unionByName, parts)


def base_profile(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """Counts, missing share, distinct values and cardinality of every column."""
    counts = base_counts(df, columns, row_id)
    distinct = distinct_summary(df, columns, row_id)
    unique = F.coalesce(F.col("unique_count"), F.lit(0))
    ratio = F.coalesce(unique / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))
    return counts.join(distinct, "column", "left").select(
        "column",
        "count",
        (F.col("rows") - F.col("count")).alias("missing_count"),
        percent(F.col("rows") - F.col("count"), F.col("rows")).alias("missing_percentage"),
        unique.alias("unique_count"),
        round_dp(ratio, 4).alias("cardinality_ratio"),
        "mode",
        "entropy",
    )


def entropy(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """Shannon entropy in bits at four decimals; NULL for a column without values."""
    counts = base_counts(df, columns, row_id)
    return counts.join(distinct_summary(df, columns, row_id), "column", "left").select("column", "entropy")


def moment_aggs(columns: list[str]) -> list[Column]:
    """Map-side aggregates ``m<i>`` behind :func:`numeric_moments`, one struct per column."""
    out = []
    for i, c in enumerate(columns):
        v = number_sql(c)
        out.append(
            F.expr(
                f"struct(count({v}) AS count, avg({v}) AS mean, stddev_samp({v}) AS std, var_samp({v}) AS variance, "
                f"min({v}) + 0D AS minimum, max({v}) + 0D AS maximum, max({v}) - min({v}) + 0D AS range, "
                f"if(count({v}) >= 3, skewness({v}) + 0D, NULL) AS skewness, "
                f"if(count({v}) >= 3, kurtosis({v}), NULL) AS kurtosis) AS m{i}"
            )
        )
    return out


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, spread, shape and range of numeric columns from one map-side aggregate."""
    wide = df.agg(*moment_aggs(columns))
    return tidy(wide, columns, lambda i: f"m{i} AS m").select("column", "m.*")


def profiles_from(df: DataFrame, m, effective: dict[str, str]) -> dict[str, dict]:
    """Profile fields per column from shared measurements; number statistics only where
    the effective type is numerical and the values are numbers."""
    out = {}
    for c in m.columns:
        count, unique = m.counts[c], m.unique(c)
        p = {
            "column": c,
            "dtype": df.schema[c].dataType.simpleString(),
            "count": count,
            "missing_count": m.rows - count,
            "missing_percentage": round_py((m.rows - count) / m.rows * 100, 2) if m.rows else 0.0,
            "unique_count": unique,
            "cardinality_ratio": round_py(unique / m.rows, 4) if m.rows else 0.0,
            "mode": m.distinct.get(c, {}).get("mode"),
            "entropy": m.distinct.get(c, {}).get("entropy"),
        }
        if c in m.numeric and effective[c] == "numerical":
            p.update(m.moments[c])
            p.update(zip(("q1", "median", "q3"), m.quartiles[c]))
            p["mode"] = None if p["mode"] is None else str(float(p["mode"]))
        out[c] = p
    return out


def profile(
    df: DataFrame,
    overrides: dict[str, str] | None = None,
    row_id: str | None = ROW_ID,
    columns: list[str] | None = None,
) -> DataFrame:
    """Full profile, one row per column."""
    from datalathe.operators.measure import classified, measure, type_map

    m = measure(df, columns or data_columns(df, row_id), row_id, numbers=True)
    effective = {c: t[1] for c, t in type_map(classified(df, m, overrides)).items()}
    rows = profiles_from(df, m, effective).values()
    return df.sparkSession.createDataFrame(
        [tuple(r.get(f.name) for f in PROFILE_SCHEMA.fields) for r in rows], PROFILE_SCHEMA
    )


def summarize_column(df: DataFrame, column: str) -> dict:
    """Mean, median and std (numeric columns only), missing count and row count."""
    return summarize_columns(df, {column: None}, column)[column]


def summarize_columns(df: DataFrame, values: dict, like: str) -> dict[str, dict]:
    """The same summary for several expressions over one DataFrame, in shared passes."""
    require_column(df, like)
    numeric = is_numeric(df, like)
    exprs = {k: (col(k) if v is None else v) for k, v in values.items()}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, e in enumerate(exprs.values()):
        v = non_nan(e) if numeric else e
        aggs.append(F.count(v).alias(f"n{i}"))
        if numeric:
            aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}")]
    row = df.agg(*aggs).first().asDict()
    medians = exact_quantiles(df, exprs, (0.5,)) if numeric else {}
    return {
        k: {
            "mean": row.get(f"mean{i}"),
            "median": medians[k][0] if numeric else None,
            "std": row.get(f"std{i}"),
            "missing_count": row["rows"] - row[f"n{i}"],
            "row_count": row["rows"],
        }
        for i, k in enumerate(exprs)
    }


def overview(
    df: DataFrame, overrides: dict[str, str] | None = None, row_id: str | None = ROW_ID, effective=None, known: dict | None = None
) -> DataFrame:
    """One row: size, missing cells, duplicate rows, columns per logical type, dtypes.

    ``memory_usage_bytes`` is the size of the values that are there, not of any engine's memory.
    ``known`` holds what is already measured: ``rows``, ``counts`` per column, ``duplicates``.
    """
    from datalathe.functions.kinds import LOGICAL_TYPES
    from datalathe.operators.quality import duplicate_rows
    from datalathe.operators.types import effective_types

    columns = data_columns(df, row_id)
    if effective is None:
        effective = {c: t[1] for c, t in effective_types(df, overrides, row_id).items()}
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    aggs = [F.sum(F.octet_length(col(c))).alias(f"b{columns.index(c)}") for c in texts]
    if known is None:
        aggs += [F.count(F.lit(1)).alias("rows"), *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]]
    found = df.agg(*aggs).first().asDict() if aggs else {}
    rows = found["rows"] if known is None else known["rows"]
    counts = {c: found[f"n{i}"] if known is None else known["counts"][c] for i, c in enumerate(columns)}
    sizes = [
        found[f"b{i}"] or 0 if c in texts else counts[c] * _WIDTH.get(type(df.schema[c].dataType), 8)
        for i, c in enumerate(columns)
    ]
    dup = duplicate_rows(df, row_id).first()["count"] if known is None else known["duplicates"]
    cells = rows * len(columns)
    gaps = cells - sum(counts.values())
    kinds = {t: sum(1 for v in effective.values() if v == t) for t in LOGICAL_TYPES}
    schema = (
        "rows long, columns long, memory_usage_bytes long, missing_values_total long, missing_percentage double, "
        "duplicate_rows long, feature_types map<string,long>, dtypes map<string,string>"
    )
    row = (
        rows,
        len(columns),
        sum(sizes),
        gaps,
        round_py(gaps / cells * 100, 2) if cells else 0.0,
        dup,
        kinds,
        {c: df.schema[c].dataType.simpleString() for c in columns},
    )
    return df.sparkSession.createDataFrame([row], schema)


# Bytes of one cell for the fixed-width types; others count as 8.
_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
