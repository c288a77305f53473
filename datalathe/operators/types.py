"""Logical type detection, user overrides and conversion hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import LOGICAL_TYPES, ROW_ID, data_columns, kind_of, require_column
from datalathe.functions.scalars import col, number_sql, parse_timestamp, q, text, tokens, word_count
from datalathe.operators.profile import base_counts, base_profile, distinct_summary, tidy

# Name pattern and thresholds of the detectors.
ID_NAME = r"(?i)(^id$|_id$|^id_|uuid|guid)"
ID_MIN_DISTINCT = 0.95
ID_MAX_WORDS = 1.5
CATEGORY_MAX_RATIO = 0.05
CATEGORY_DTYPE_MAX_RATIO = 0.5
DATETIME_MIN_PARSED = 0.9
DELIMITERS = ("|", ",", ";", "/")
MIN_SPLIT_RATIO = 0.5

# Row ids looked at first for the sample, and the factor by which that range grows.
PROBE_ROWS = 50_000
PROBE_GROWTH = 64


def text_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if kind_of(df.schema[c]) == "string"]


def first_values(df: DataFrame, columns: list[str], row_id: str | None = ROW_ID, n: int = 200) -> DataFrame:
    """``(column, value)``: the first ``n`` non-missing texts of each column in row order.

    Stored data lies in row order, so a filter on the row id lets Parquet skip all but
    the first row groups. The range grows only for columns that are nearly empty there.
    Within it each branch is a top-n: a task keeps at most ``n`` rows.
    """
    if row_id is None or row_id not in df.columns:
        return _union(_head(df, c, None, n) for c in columns)
    ends = df.agg(F.min(col(row_id)).alias("lo"), F.max(col(row_id)).alias("hi")).first()
    branches, waiting, width = [], list(columns), PROBE_ROWS
    while waiting:
        everything = ends["lo"] is None or ends["hi"] - ends["lo"] < width
        part = df if everything else df.where(col(row_id) < F.lit(ends["lo"] + width))
        ready = waiting
        if not everything:
            seen = part.agg(*[F.expr(f"count({q(c)}) AS n{i}") for i, c in enumerate(waiting)]).first()
            ready = [c for i, c in enumerate(waiting) if seen[f"n{i}"] >= n]
        branches += [_head(part, c, row_id, n) for c in ready]
        waiting = [c for c in waiting if c not in ready]
        width *= PROBE_GROWTH
    return _union(branches)


def _head(df: DataFrame, column: str, row_id: str | None, n: int) -> DataFrame:
    rows = df.where(col(column).isNotNull())
    if row_id is not None:
        rows = rows.select(col(column).alias("value"), col(row_id).alias("__pos")).orderBy("__pos")
    else:
        rows = rows.select(col(column).alias("value"))
    return rows.limit(n).select(F.lit(column).alias("column"), "value")


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_facts(
    df: DataFrame, columns: list[str], row_id: str | None = ROW_ID, sample_rows: int | None = None
) -> DataFrame:
    """``(column, mean_words, parsed)``: mean word count and share of dates of each text column.

    Every value counts. With ``sample_rows`` only that many first values do, which is
    cheaper where texts are long and rows of a kind are spread evenly.
    """
    if sample_rows is not None:
        return first_values(df, columns, row_id, sample_rows).groupBy("column").agg(*_text_aggs(F.col("value")))
    wide = df.agg(*[F.struct(*_text_aggs(col(c))).alias(f"t{i}") for i, c in enumerate(columns)])
    rows = [f"named_struct('column', {text(c)}, 'mean_words', t{i}.mean_words, 'parsed', t{i}.parsed)" for i, c in enumerate(columns)]
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def _text_aggs(c: Column) -> list[Column]:
    # All layouts have a year of four digits; without one the parsers need not run.
    dated = F.when(c.rlike(r"\d{4}") & (F.length(c) <= 64), parse_timestamp(c).isNotNull()).otherwise(F.lit(False))
    return [
        F.avg(word_count(c)).alias("mean_words"),
        F.avg(F.when(c.isNotNull(), dated.cast("double"))).alias("parsed"),
    ]


def detect_ids(
    df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID, sample_rows: int | None = None
) -> DataFrame:
    """``(column, is_id)``: near-unique single-token values, named like an id or fully unique."""
    columns = columns or data_columns(df, row_id)
    base = base_counts(df, columns, row_id).join(distinct_summary(df, columns, row_id), "column", "left")
    texts = text_columns(df, columns)
    if texts:
        base = base.join(text_facts(df, texts, row_id, sample_rows), "column", "left")
    else:
        base = base.withColumn("mean_words", F.lit(None).cast("double"))
    return base.select("column", _id_rule(df, columns).alias("is_id"))


def _id_rule(df: DataFrame, columns: list[str]) -> Column:
    ints = [c for c in columns if kind_of(df.schema[c]) == "integer"]
    texts = text_columns(df, columns)
    ratio = F.try_divide(F.col("unique_count"), F.col("count"))
    # An integer column with gaps counts as floating point, which is never an id.
    whole = F.col("column").isin(ints) & (F.col("count") == F.col("rows"))
    token = F.col("column").isin(texts) & (F.col("mean_words") <= ID_MAX_WORDS)
    named = F.col("column").rlike(ID_NAME)
    return F.coalesce(
        (whole | token) & (ratio > ID_MIN_DISTINCT) & (named | (ratio == 1.0)),
        F.lit(False),
    )


def delimiter_hits(columns: list[str]) -> list[Column]:
    """Map-side counts per text column: texts, and texts that contain each delimiter."""
    return [F.expr(f"count({q(c)}) AS texts{i}") for i, c in enumerate(columns)] + [
        F.expr(f"count_if(contains({q(c)}, '{d}')) AS hits{i}_{k}")
        for i, c in enumerate(columns)
        for k, d in enumerate(DELIMITERS)
    ]


def delimiter_scores(
    df: DataFrame, columns: list[str], min_split_ratio: float = MIN_SPLIT_RATIO, seen=None
) -> DataFrame:
    """``(column, delimiter, split_ratio, tokens, vocabulary, rows, score)`` of plausible delimiters.

    A first map-side pass drops delimiters that too few rows contain; only the rest
    are split, and tokens are counted before they are shuffled.
    """
    spark = df.sparkSession
    schema = (
        "column string, delimiter string, priority int, rows long, split_ratio double, "
        "tokens long, vocabulary long, score double"
    )
    if not columns:
        return spark.createDataFrame([], schema)
    if seen is None:
        seen = df.agg(*delimiter_hits(columns)).first()
    candidates = []
    for i, c in enumerate(columns):
        for k, d in enumerate(DELIMITERS):
            n, hits = seen[f"texts{i}"], seen[f"hits{i}_{k}"]
            if n and hits / n >= min_split_ratio:
                candidates.append((c, d, k, n, hits / n))
    if not candidates:
        return spark.createDataFrame([], schema)
    pieces = F.array(
        *[
            F.struct(F.lit(i).alias("cand"), tokens(col(c), d).alias("parts"))
            for i, (c, d, _, _, _) in enumerate(candidates)
        ]
    )
    exploded = df.select(F.inline(pieces)).select("cand", F.explode("parts").alias("token"))
    counted = exploded.groupBy("cand", "token").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counted.groupBy("cand").agg(F.sum("cnt").alias("tokens"), F.count(F.lit(1)).alias("vocabulary"))
    known = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(candidates)],
        "cand int, column string, delimiter string, priority int, rows long, split_ratio double",
    )
    repetition = 1.0 - F.col("vocabulary") / F.col("tokens")
    accepted = (repetition > 0.5) & (F.col("tokens") / F.col("rows") > 1.1)
    return (
        known.join(totals, "cand")
        .withColumn("score", F.when(accepted, F.col("split_ratio") * repetition))
        .drop("cand")
    )


def detect_delimiters(
    df: DataFrame,
    columns: list[str] | None = None,
    row_id: str | None = ROW_ID,
    min_split_ratio: float = MIN_SPLIT_RATIO,
    seen=None,
) -> DataFrame:
    """``(column, delimiter)``: the best delimiter of each multi-label text column, else NULL."""
    columns = columns or data_columns(df, row_id)
    scored = delimiter_scores(df, text_columns(df, columns), min_split_ratio, seen)
    best = scored.where("score > 0").groupBy("column").agg(
        F.min_by("delimiter", F.struct(-F.col("score"), F.col("priority"))).alias("delimiter")
    )
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return names.join(best, "column", "left").select("column", "delimiter")


def detect_delimiter(df: DataFrame, column: str) -> str | None:
    require_column(df, column)
    return detect_delimiters(df.select(col(column)), [column]).first()["delimiter"]


def detect_types(
    df: DataFrame,
    overrides: dict[str, str] | None = None,
    row_id: str | None = ROW_ID,
    columns: list[str] | None = None,
) -> DataFrame:
    """``(column, dtype, detected_type, effective_type, is_overridden)``; an override wins."""
    from datalathe.operators.measure import classified, measure

    return classified(df, measure(df, columns or data_columns(df, row_id), row_id), overrides)


def classify(df: DataFrame, measures: DataFrame, columns: list[str], overrides: dict[str, str]) -> DataFrame:
    """Types from one row of measures per column: rows, count, unique_count, mean_words, delimiter."""
    for t in overrides.values():
        check_logical_type(t)
    known = df.sparkSession.createDataFrame(
        [
            (i, c, df.schema[c].dataType.simpleString(), kind_of(df.schema[c]), overrides.get(c))
            for i, c in enumerate(columns)
        ],
        "position int, column string, dtype string, kind string, override string",
    )
    unique_ratio = F.coalesce(F.col("unique_count"), F.lit(0)) / F.greatest(F.col("rows"), F.lit(1))
    kind = F.col("kind")
    detected = (
        F.when(_id_rule(df, columns), "id")
        .when(kind == "boolean", "boolean")
        .when(kind == "datetime", "datetime")
        .when(kind.isin("integer", "float"), "numerical")
        .when(kind == "category", "categorical")
        .when((kind == "string") & F.col("delimiter").isNotNull(), "multi_label")
        .when((kind == "string") & (unique_ratio < CATEGORY_MAX_RATIO), "categorical")
        .when(kind == "string", "text")
        .otherwise("mixed")
    )
    return (
        measures.join(F.broadcast(known), "column")  # one row per column of the schema
        .withColumn("detected_type", detected)
        .orderBy("position")
        .select(
            "column",
            "dtype",
            "detected_type",
            F.coalesce("override", "detected_type").alias("effective_type"),
            F.col("override").isNotNull().alias("is_overridden"),
        )
    )


def effective_types(
    df: DataFrame,
    overrides: dict[str, str] | None = None,
    row_id: str | None = ROW_ID,
    columns: list[str] | None = None,
) -> dict[str, tuple[str, str, bool]]:
    """``column -> (detected, effective, is_overridden)``, one small row per column."""
    from datalathe.operators.measure import type_map

    return type_map(detect_types(df, overrides, row_id, columns))


def check_logical_type(logical_type: str) -> None:
    if logical_type not in LOGICAL_TYPES:
        raise ValueError(f"unknown logical type '{logical_type}', expected one of {', '.join(LOGICAL_TYPES)}")


def datetime_flags(
    df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID, sample_rows: int | None = None
) -> DataFrame:
    """``(column, is_datetime_convertible)``: nine in ten texts parse as dates."""
    columns = columns or data_columns(df, row_id)
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    texts = text_columns(df, columns)
    if not texts:
        return names.select("column", F.lit(False).alias("is_datetime_convertible"))
    return names.join(text_facts(df, texts, row_id, sample_rows), "column", "left").select(
        "column", F.coalesce(F.col("parsed") >= DATETIME_MIN_PARSED, F.lit(False)).alias("is_datetime_convertible")
    )


def whole_numbers(floats: list[str]) -> list[Column]:
    """Map-side flags: every value of the floating column is whole."""
    return [
        F.expr(f"bool_and({number_sql(c)} = rint({number_sql(c)})) AS whole{i}") for i, c in enumerate(floats)
    ]


def integer_flags(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, is_int_convertible)``: a floating column that holds whole numbers only."""
    columns = columns or data_columns(df, row_id)
    floats = [c for c in columns if kind_of(df.schema[c]) == "float"]
    wide = df.agg(F.expr("count(1) AS rows"), *whole_numbers(floats))
    return tidy(
        wide,
        columns,
        lambda i: (f"coalesce(whole{floats.index(columns[i])},false)" if columns[i] in floats else "false")
        + " AS is_int_convertible",
    )


def category_flags(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, is_category_beneficial)``: text whose distinct share is below one half."""
    columns = columns or data_columns(df, row_id)
    texts = text_columns(df, columns)
    return base_profile(df, columns, row_id).select(
        "column",
        (F.col("column").isin(texts) & (F.col("cardinality_ratio") < CATEGORY_DTYPE_MAX_RATIO)).alias(
            "is_category_beneficial"
        ),
    )
