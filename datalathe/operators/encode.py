"""Encoding of categorical and multi-label columns.

Value-to-code maps are learnt once and written to the shared folder, whatever their size;
the state of a fitted encoder names the table. A map of counted, moderate size is broadcast,
a larger one joins the rows by value. Columns made of values that differ only in case, or that
the table already has, get a numbered ending.

One-hot and multi-label encoding have two forms. ``columns`` makes a 0/1 column per value; its cells are rows times
values, and a plan cannot hold some ten thousands of columns. ``sparse`` makes one column of the same flags, their number
and the places of the ones in ascending order; which value stands at a place is a table, never the plan or the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from datalathe.functions.kinds import require_column
from datalathe.functions.ordering import assign_row_id
from datalathe.functions.scalars import col, present, q, text, tokens
from datalathe.operators.categorical import category_counts, label_counts
from datalathe.operators.steps import Fitted
from datalathe.operators.types import detect_delimiter
from datalathe.session import fresh_path

METHODS = ("one_hot", "label", "ordinal", "frequency", "binary", "multi_label")
FORMS = ("columns", "sparse")

# Largest map that is broadcast.
MAP_ROWS = 50_000


def _columns_of(frame: DataFrame, column: str, max_columns: int | None) -> list:
    """The sorted values of a one-column frame; each becomes a column, so they are schema, not data."""
    if max_columns is not None and frame.limit(max_columns + 1).count() > max_columns:
        raise ValueError(
            f"'{column}' would become more than {max_columns} columns; "
            "raise max_columns or use label, frequency or binary encoding"
        )
    return sorted(r[0] for r in frame.collect())


def _new_names(d: DataFrame, column: str, values: list) -> list[str]:
    """One name per value that no other column has, in any casing."""
    taken = {n.lower() for n in d.columns if n != column}
    out = []
    for v in values:
        name = wanted = f"{column}_{v}"
        k = 2
        while name.lower() in taken:
            name, k = f"{wanted}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class ValueMap:
    """A written table ``(__key, value)`` and its number of rows."""

    path: str
    rows: int
    map_rows: int

    def frame(self, spark: SparkSession) -> DataFrame:
        found = spark.read.parquet(self.path)
        return F.broadcast(found) if self.rows <= self.map_rows else found  # counted when it was written


def _written(frame: DataFrame, map_rows: int) -> ValueMap:
    path = fresh_path(frame.sparkSession, "datalathe-map")
    frame.write.parquet(path)
    return ValueMap(path, frame.sparkSession.read.parquet(path).count(), map_rows)


def _require_form(form: str) -> None:
    if form not in FORMS:
        raise ValueError(f"unknown form of encoding '{form}'")


def _bounded(codes: ValueMap, column: str, max_columns: int | None) -> ValueMap:
    if max_columns is not None and codes.rows > max_columns:
        raise ValueError(f"'{column}' would become more than {max_columns} flags; raise max_columns or use label, frequency or binary encoding")
    return codes


def fit_one_hot(
    df: DataFrame, column: str, max_columns: int | None = None, form: str = "columns", map_rows: int = MAP_ROWS
) -> Fitted:
    """A 0/1 flag per value. ``max_columns``, where given, turns a wider result into an error."""
    require_column(df, column)
    _require_form(form)
    if form == "sparse":
        return one_hot_sparse(column, _bounded(_code_map(df, column, map_rows), column, max_columns), max_columns)
    values = _columns_of(category_counts(df, column).select("value"), column, max_columns)
    t = df.schema[column].dataType
    spark = df.sparkSession
    keys = spark.createDataFrame([(v, i) for i, v in enumerate(values)], T.StructType([T.StructField("__key", t), T.StructField("__code", T.LongType())]))
    return one_hot(column, values, _written(keys, MAP_ROWS), max_columns)


def one_hot(column: str, values: list, codes: ValueMap, max_columns: int | None = None) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        kept = [q(n) for n in d.columns if n != column]
        new = [f"int(coalesce(__code = {i}, false)) AS {q(n)}" for i, n in enumerate(_new_names(d, column, values))]
        return _joined(d, column, codes).selectExpr(*kept, *new)

    params = {"column": column, "method": "one_hot", "max_columns": max_columns}
    return Fitted("encode", params, {"size": len(values), "map": codes.path}, transform)


def one_hot_sparse(column: str, codes: ValueMap, max_columns: int | None = None) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        return _with_places(_joined(d, column, codes), d, column, codes, F.array_compact(F.array(F.col("__code").cast("int"))))

    params = {"column": column, "method": "one_hot", "max_columns": max_columns, "form": "sparse"}
    return Fitted("encode", params, {"size": codes.rows, "map": codes.path}, transform)


def _with_places(joined: DataFrame, d: DataFrame, column: str, codes: ValueMap, places: Column) -> DataFrame:
    """The other columns of ``d``, and the flags as their number and the places of the ones."""
    (name,) = _new_names(d, column, ["flags"])
    flags = F.struct(F.lit(codes.rows).cast("int").alias("size"), places.alias("indices")).alias(name)
    return joined.select(*[col(n) for n in d.columns if n != column], flags)


def _code_map(df: DataFrame, column: str, map_rows: int) -> ValueMap:
    """``(__key, __code)`` with codes in the sorted order of the values."""
    return _coded(category_counts(df, column).select(F.col("value").alias("__key")), map_rows)


def _coded(keys: DataFrame, map_rows: int) -> ValueMap:
    found = _written(keys, map_rows)
    keys = keys.sparkSession.read.parquet(found.path)
    if found.rows > map_rows:
        return _written(assign_row_id(keys, ["__key"], "__code"), map_rows)
    # A counted number of values that one task sorts and numbers.
    path = fresh_path(keys.sparkSession, "datalathe-map")
    numbered = keys.coalesce(1).sortWithinPartitions("__key").withColumn("__code", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return ValueMap(path, found.rows, map_rows)


def _joined(d: DataFrame, column: str, mapping: ValueMap) -> DataFrame:
    return d.withColumn("__value", present(d, column)).join(mapping.frame(d.sparkSession), F.col("__value") == F.col("__key"), "left")


def _replaced(d: DataFrame, column: str, mapping: ValueMap, value: str) -> DataFrame:
    out = _joined(d, column, mapping)
    return out.select(*[F.col(value).alias(n) if n == column else col(n) for n in d.columns])


def fit_label(df: DataFrame, column: str, map_rows: int = MAP_ROWS) -> Fitted:
    require_column(df, column)
    return mapped({"column": column, "method": "label"}, _code_map(df, column, map_rows))


def mapped(params: dict, codes: ValueMap) -> Fitted:
    """Label, ordinal and frequency encoding by a written map."""
    column, new = params["column"], "__freq" if params["method"] == "frequency" else "__code"
    state = {"size": codes.rows, "map": codes.path}
    return Fitted("encode", params, state, lambda d: _replaced(d, column, codes, new))


def fit_ordinal(df: DataFrame, column: str, order: list[str] | None) -> Fitted:
    """Codes in the order the caller gives; values not listed become missing."""
    require_column(df, column)
    if not order:
        raise ValueError(f"codes of '{column}' follow the parameter order, which is empty")
    t = df.schema[column].dataType
    pairs = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], "__text string, __code long")
    pairs = pairs.select(F.col("__text").try_cast(t).alias("__key"), "__code").where("__key IS NOT NULL")
    if pairs.groupBy("__key").count().where("count > 1").count():
        raise ValueError(f"entries of 'order' become equal as {t.simpleString()}")
    return mapped({"column": column, "method": "ordinal", "order": list(order)}, _written(pairs, MAP_ROWS))


def fit_frequency(df: DataFrame, column: str, map_rows: int = MAP_ROWS) -> Fitted:
    """Each value becomes its number of occurrences."""
    require_column(df, column)
    counts = category_counts(df, column).select(F.col("value").alias("__key"), F.col("count").alias("__freq"))
    return mapped({"column": column, "method": "frequency"}, _written(counts, map_rows))


def fit_binary(df: DataFrame, column: str, map_rows: int = MAP_ROWS) -> Fitted:
    """The bits of the label code, lowest first, one column per bit."""
    require_column(df, column)
    return binary(column, _code_map(df, column, map_rows))


def binary(column: str, codes: ValueMap) -> Fitted:
    bits = max(1, (codes.rows - 1).bit_length()) if codes.rows else 1

    def transform(d: DataFrame) -> DataFrame:
        names = _new_names(d, column, [f"bin_{b}" for b in range(bits)])
        new = [
            F.shiftright(F.col("__code"), b).bitwiseAND(F.lit(1)).cast("int").alias(n) for b, n in enumerate(names)
        ]
        return _joined(d, column, codes).select(*[col(n) for n in d.columns if n != column], *new)

    return Fitted(
        "encode", {"column": column, "method": "binary"}, {"size": codes.rows, "bits": bits, "map": codes.path}, transform
    )


def fit_multi_label(
    df: DataFrame,
    column: str,
    delimiter: str | None = None,
    max_columns: int | None = None,
    form: str = "columns",
    map_rows: int = MAP_ROWS,
) -> Fitted:
    """A 0/1 flag per label; the resolved delimiter is recorded for replay."""
    require_column(df, column)
    _require_form(form)
    delimiter = delimiter or detect_delimiter(df, column)
    if delimiter is None:
        raise ValueError(f"no delimiter found for the multi-label column '{column}'")
    found = label_counts(df, column, delimiter)
    if form == "sparse":
        codes = _coded(found.select(F.col("label").alias("__key")), map_rows)
        return multi_label_sparse(column, delimiter, _bounded(codes, column, max_columns), max_columns)
    labels = _columns_of(found.select("label"), column, max_columns)
    return multi_label(column, delimiter, labels, max_columns)


def multi_label(column: str, delimiter: str, labels: list[str], max_columns: int | None = None) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        split = d.withColumn("__tokens", tokens(col(column).cast("string"), delimiter))
        kept = [q(n) for n in d.columns if n != column]
        names = _new_names(d, column, labels)
        new = [f"int(coalesce(array_contains(__tokens, {text(v)}), false)) AS {q(n)}" for v, n in zip(labels, names)]
        return split.selectExpr(*kept, *new)

    params = {"column": column, "method": "multi_label", "delimiter": delimiter, "max_columns": max_columns}
    return Fitted("encode", params, {"size": len(labels), "labels": labels}, transform)


def multi_label_sparse(column: str, delimiter: str, codes: ValueMap, max_columns: int | None = None) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        if d.isStreaming:
            raise ValueError("the sparse form of multi-label encoding groups the labels of a text, which a stream cannot do")
        rows = d.withColumn("__text", col(column).cast("string"))
        # Each text is taken apart once, however many rows hold it.
        texts = rows.select("__text").where("__text IS NOT NULL").distinct()
        each = texts.select("__text", F.explode(F.array_distinct(tokens(F.col("__text"), delimiter))).alias("__label"))
        known = each.join(codes.frame(d.sparkSession), F.col("__label") == F.col("__key"))
        places = known.groupBy("__text").agg(F.array_sort(F.collect_list(F.col("__code").cast("int"))).alias("__places"))
        empty = F.array().cast("array<int>")
        return _with_places(rows.join(places, "__text", "left"), d, column, codes, F.coalesce("__places", empty))

    params = {"column": column, "method": "multi_label", "delimiter": delimiter, "max_columns": max_columns, "form": "sparse"}
    return Fitted("encode", params, {"size": codes.rows, "map": codes.path}, transform)


def fit_encode(
    df: DataFrame, column: str, method: str, order: list[str] | None = None, delimiter: str | None = None, **kw
) -> Fitted:
    if method == "ordinal":
        return fit_ordinal(df, column, order)
    if method == "multi_label":
        return fit_multi_label(df, column, delimiter, **kw)
    simple = {"one_hot": fit_one_hot, "label": fit_label, "frequency": fit_frequency, "binary": fit_binary}
    if method not in simple:
        raise ValueError(f"unknown encoding method '{method}'")
    return simple[method](df, column, **kw)


def encode(df: DataFrame, column: str, method: str, **kw) -> DataFrame:
    return fit_encode(df, column, method, **kw).apply(df)
