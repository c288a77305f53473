"""Measurements shared by type detection, profiles and facts: each pass runs once, passes overlap.

Only results of the size of the column list reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from datalathe.functions.kinds import is_numeric, kind_of
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import col
from datalathe.operators.outliers import iqr_bounds, outlier_counts
from datalathe.operators.profile import QUARTILES, count_aggs, distinct_summary, moment_aggs
from datalathe.operators.quality import case_flags, padded_texts
from datalathe.operators.types import (
    classify,
    delimiter_hits,
    detect_delimiters,
    text_columns,
    text_facts,
    whole_numbers,
)
from datalathe.session import together


@dataclass
class Measures:
    columns: list[str]
    texts: list[str]
    numeric: list[str]
    floats: list[str]
    rows: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    moments: dict[str, dict] = field(default_factory=dict)
    padded: dict[str, bool] = field(default_factory=dict)
    whole: dict[str, bool] = field(default_factory=dict)
    delimiters: dict[str, str | None] = field(default_factory=dict)
    distinct: dict[str, dict] = field(default_factory=dict)
    samples: dict[str, dict] = field(default_factory=dict)
    mixed: dict[str, bool] = field(default_factory=dict)
    quartiles: dict[str, list] = field(default_factory=dict)
    outliers: dict[str, dict] = field(default_factory=dict)
    other: dict = field(default_factory=dict)  # results of jobs run alongside

    def unique(self, column: str) -> int:
        return self.distinct.get(column, {"unique_count": 0})["unique_count"]


def measure(
    df: DataFrame,
    columns: list[str],
    row_id: str | None,
    numbers: bool = False,
    flags: bool = False,
    other: dict | None = None,
) -> Measures:
    """Counts, distinct values and text facts; with ``numbers`` also moments and
    quartiles, with ``flags`` also quality flags and outliers. ``other`` jobs run alongside."""
    texts = text_columns(df, columns)
    numeric = [c for c in columns if is_numeric(df, c)]
    floats = [c for c in numeric if kind_of(df.schema[c]) == "float"]
    m = Measures(columns, texts, numeric, floats)

    # One scan per kind of column: no column is read twice, and the generated code of
    # each scan stays small enough to be compiled.
    others = [c for c in columns if c not in texts and (c not in numeric or not numbers)]

    def scan_others() -> None:
        row = df.agg(F.expr("count(1) AS rows"), *count_aggs(df, others)).first()
        m.rows = row["rows"]
        m.counts.update({c: row[f"n{i}"] for i, c in enumerate(others)})

    def scan_numbers() -> None:
        aggs = moment_aggs(numeric) + (whole_numbers(floats) if flags else [])
        row = df.agg(*aggs).first()
        m.moments = {c: row[f"m{i}"].asDict() for i, c in enumerate(numeric)}
        m.counts.update({c: v["count"] for c, v in m.moments.items()})
        if flags:
            m.whole = {c: bool(row[f"whole{i}"]) for i, c in enumerate(floats)}

    def scan_texts() -> None:
        row = df.agg(*delimiter_hits(texts), *(padded_texts(texts) if flags else [])).first()
        m.counts.update({c: row[f"texts{i}"] for i, c in enumerate(texts)})
        if flags:
            m.padded = {c: row[f"padded{i}"] for i, c in enumerate(texts)}
        m.delimiters = {r[0]: r[1] for r in detect_delimiters(df, texts, row_id, seen=row).collect()}

    def distinct() -> None:
        m.distinct = {r["column"]: r.asDict() for r in distinct_summary(df, columns, row_id).collect()}

    def samples() -> None:
        m.samples = {r["column"]: r.asDict() for r in text_facts(df, texts, row_id).collect()}

    def mixed() -> None:
        m.mixed = {r[0]: r[1] for r in case_flags(df, texts, row_id).collect()}

    def quartiles() -> None:
        m.quartiles = exact_quantiles(df, {c: col(c) for c in numeric}, QUARTILES)
        if flags:
            bounds = {c: iqr_bounds(q[0], q[2]) for c, q in m.quartiles.items()}
            m.outliers = {r["column"]: r.asDict() for r in outlier_counts(df, numeric, "iqr", bounds).collect()}

    jobs = {"distinct": distinct, "others": scan_others}
    if texts:
        jobs["texts"] = scan_texts
        jobs["samples"] = samples
        if flags:
            jobs["mixed"] = mixed
    if numeric and numbers:
        jobs["quartiles"] = quartiles
        jobs["numbers"] = scan_numbers
    m.other = together(df.sparkSession, {**jobs, **(other or {})})
    return m


def classified(df: DataFrame, m: Measures, overrides: dict[str, str] | None) -> DataFrame:
    """``(column, dtype, detected_type, effective_type, is_overridden)`` from the measurements."""
    rows = [
        (c, m.rows, m.counts[c], m.unique(c), m.samples.get(c, {}).get("mean_words"), m.delimiters.get(c))
        for c in m.columns
    ]
    schema = "column string, rows long, count long, unique_count long, mean_words double, delimiter string"
    return classify(df, df.sparkSession.createDataFrame(rows, schema), m.columns, overrides or {})


def type_map(types: DataFrame) -> dict[str, tuple[str, str, bool]]:
    """``column -> (detected, effective, is_overridden)``, one small row per column."""
    return {r["column"]: (r["detected_type"], r["effective_type"], r["is_overridden"]) for r in types.collect()}
