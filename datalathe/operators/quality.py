"""Data-quality flags, duplicate rows and duplicate columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import ROW_ID, data_columns, kind_of, require_column
from datalathe.functions.scalars import WHITESPACE, col, percent, present, q, round_py, strip, text, value_sql
from datalathe.operators.profile import base_profile, tidy


def string_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    return [c for c in data_columns(df, row_id) if kind_of(df.schema[c]) == "string"]


def padded_texts(texts: list[str]) -> list[Column]:
    """Map-side flags: any value of the text column with surrounding whitespace."""
    blanks = text(WHITESPACE)
    return [
        F.expr(f"coalesce(bool_or({q(c)} <> btrim({q(c)}, {blanks})), false) AS padded{i}") for i, c in enumerate(texts)
    ]


def whitespace_flags(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, has_whitespace)``: any text with leading or trailing whitespace."""
    columns = columns or data_columns(df, row_id)
    texts = [c for c in columns if kind_of(df.schema[c]) == "string"]
    aggs = padded_texts(texts)
    wide = df.agg(*aggs) if aggs else df.agg(F.expr("count(1) AS rows"))
    return tidy(
        wide, columns, lambda i: (f"padded{texts.index(columns[i])}" if columns[i] in texts else "false") + " AS has_whitespace"
    )


def case_flags(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, has_case_inconsistency)``: one text written with different casing.

    Distinct spellings are counted first, then those that fold to one lower-cased value.
    """
    columns = columns or data_columns(df, row_id)
    texts = [c for c in columns if kind_of(df.schema[c]) == "string"]
    all_columns = _names(df, columns)
    if not texts:
        return all_columns.select("column", F.lit(False).alias("has_case_inconsistency"))
    melted = (
        df.select(*[col(c) for c in texts])
        .unpivot([], [col(c) for c in texts], "column", "value")
        .where("value IS NOT NULL")
        .select("column", strip(F.col("value")).alias("value"))
    )
    # Counts alone are merged, so texts are hashed and never sorted.
    spellings = melted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    folded = spellings.groupBy("column", F.lower("value").alias("folded")).agg(F.count(F.lit(1)).alias("spellings"))
    flags = folded.groupBy("column").agg((F.max("spellings") > 1).alias("mixed"))
    return all_columns.join(flags, "column", "left").select(
        "column", F.coalesce("mixed", F.lit(False)).alias("has_case_inconsistency")
    )


def _names(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))


def variation_flags(df: DataFrame, columns: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, is_constant, is_low_variance)`` from the base profile."""
    p = base_profile(df, columns, row_id)
    return p.select(
        "column",
        (F.col("unique_count") == 1).alias("is_constant"),
        ((F.col("unique_count") > 1) & (F.col("cardinality_ratio") < 0.01)).alias("is_low_variance"),
    )


# Most hashes that are broadcast; 8 bytes each.
BROADCAST_HASHES = 1_000_000


def _suspects(df: DataFrame, row_id: str | None) -> tuple[int, DataFrame | None, list[str]]:
    """Row count, the rows whose hash occurs again as ``v0, v1, ...`` with ``__id``, and the value names.

    A first pass shuffles one 64-bit hash per row and proves most rows unique. Missing
    values of either kind are NULL. No rows at all are suspect where every hash is unique.
    """
    columns = data_columns(df, row_id)
    names = [f"v{i}" for i in range(len(columns))]
    id_ = col(row_id) if row_id is not None and row_id in df.columns else F.lit(None).cast("long")
    rows = df.select(*[present(df, c).alias(n) for c, n in zip(columns, names)], id_.alias("__id"))
    hashed = rows.selectExpr("*", f"xxhash64({', '.join(names)}) AS __hash")
    by_hash = hashed.groupBy("__hash").agg(F.expr("count(1) AS cnt"))
    seen = by_hash.agg(F.expr("coalesce(sum(cnt), 0) AS rows"), F.expr("count_if(cnt > 1) AS repeated")).first()
    if seen["repeated"] == 0:
        return seen["rows"], None, names
    repeated = by_hash.where("cnt > 1").select("__hash")
    if seen["repeated"] <= BROADCAST_HASHES:
        repeated = F.broadcast(repeated)  # its number was counted above
    return seen["rows"], hashed.join(repeated, "__hash", "left_semi"), names


def duplicate_rows(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    """One row ``(count, percentage, rows)``: rows beyond the first of their kind.

    Only rows whose hash repeats are compared in full, merged map-side before they move.
    """
    rows, suspects, names = _suspects(df, row_id)
    if suspects is None:
        extra = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("count"))
    else:
        extra = suspects.groupBy(*names).agg(F.expr("count(1) AS cnt")).agg(F.expr("sum(cnt - 1) AS count"))
    total = F.lit(rows)
    return extra.select("count", percent(F.col("count"), total).alias("percentage"), total.alias("rows"))


def duplicate_rows_preview(df: DataFrame, row_id: str = ROW_ID, sample: int = 5) -> dict:
    """Counts, rows left after removal, and the first few rows that would go."""
    rows, suspects, names = _suspects(df, row_id)
    count, shown = 0, []
    if suspects is not None:
        groups = suspects.groupBy(*names).agg(F.count(F.lit(1)).alias("cnt"), F.min("__id").alias("first")).where("cnt > 1")
        count = groups.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0))).first()[0]
        g = groups.select("first", *[F.col(n).alias(f"g_{n}") for n in names])
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"g_{n}")) for n in names])
        first = suspects.join(g, same).where(F.col("__id") > F.col("first")).orderBy("__id").limit(sample)
        ids = [r["__id"] for r in first.select("__id").collect()]
        found = {r[row_id]: r.asDict() for r in df.where(col(row_id).isin(ids)).collect()}
        shown = [found[i] for i in ids]
    return {
        "duplicate_count": count,
        "duplicate_percentage": round_py(100.0 * count / rows, 2) if rows else 0.0,
        "rows_after_removal": rows - count,
        "sample_duplicate_rows": shown,
    }


def remove_duplicate_rows(df: DataFrame, keep: str = "first", row_id: str | None = ROW_ID) -> DataFrame:
    """Exact duplicates removed; the surviving row keeps its position, its missing values are NULL.

    Every data column is a grouping key, so the groups already are the result:
    one shuffle after map-side merging, no sort and no join.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not '{keep}'")
    plain = df.select(*[col(c) if c == row_id else present(df, c).alias(c, metadata=df.schema[c].metadata) for c in df.columns])
    if row_id is None or row_id not in df.columns:
        return plain.dropDuplicates()
    pick = F.min if keep == "first" else F.max
    names = [col(c) for c in data_columns(df, row_id)]
    kept = plain.groupBy(*names).agg(pick(col(row_id)).alias(row_id))
    return kept.select(*[col(c) for c in df.columns])


def duplicate_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[tuple[str, str]]:
    """Pairs of columns of one type that agree in every row, missing equal to missing.

    A fingerprint bound to the row's other values shortlists the candidates in one
    pass; one further pass compares them cell by cell.
    """
    columns = data_columns(df, row_id)
    whole = F.xxhash64(*[present(df, c) for c in columns])
    prints = df.select(whole.alias("__h"), *[present(df, c).alias(c) for c in columns]).agg(
        # A sum, as an exclusive or cancels where every row occurs twice.
        *[F.expr(f"sum(CAST(xxhash64(__h, {q(c)}) AS decimal(20, 0))) AS f{i}") for i, c in enumerate(columns)],
        *[F.expr(f"count({q(c)}) AS n{i}") for i, c in enumerate(columns)],
    ).first()
    shortlist: dict[tuple, list[str]] = {}
    for i, c in enumerate(columns):
        shortlist.setdefault((df.schema[c].dataType.simpleString(), prints[f"f{i}"], prints[f"n{i}"]), []).append(c)
    open_groups = [g for g in shortlist.values() if len(g) > 1]
    equal: dict[str, int] = {}
    class_no = 0
    while open_groups:
        checks = [(g[0], other) for g in open_groups for other in g[1:]]
        row = df.agg(
            *[
                F.expr(f"coalesce(bool_and({value_sql(df, a)} <=> {value_sql(df, b)}), true) AS e{i}")
                for i, (a, b) in enumerate(checks)
            ]
        ).first()
        same = {pair: row[i] for i, pair in enumerate(checks)}
        rest = []
        for g in open_groups:
            class_no += 1
            members = [g[0]] + [o for o in g[1:] if same[g[0], o]]
            if len(members) > 1:
                equal.update({m: class_no for m in members})
            left = [o for o in g[1:] if not same[g[0], o]]
            if len(left) > 1:
                rest.append(left)
        open_groups = rest
    return [
        (a, b)
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
        if a in equal and equal.get(b) == equal[a]
    ]


def duplicate_columns_frame(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    return df.sparkSession.createDataFrame(duplicate_columns(df, row_id), "column_a string, column_b string")


def remove_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the named columns; an unknown name is an error."""
    for c in columns:
        require_column(df, c)
    return df.drop(*columns)
