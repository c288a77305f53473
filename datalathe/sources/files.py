"""CSV ingest with explicit row order, and CSV and Parquet export."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from datalathe.functions.kinds import ROW_ID, data_columns
from datalathe.functions.ordering import assign_row_id, densify
from datalathe.functions.scalars import col
from datalathe.session import cut_lineage
from datalathe.sources import quoted

# Texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_EXTRA, _FILE, _START, _MONO = "__extra", quoted.FILE, quoted.START, quoted.MONO
_MARK = "__no more fields__"


def read_csv(spark: SparkSession, path: str, row_id: str = ROW_ID, multi_line: bool | None = None) -> DataFrame:
    """A CSV file (or folder of part files) with inferred types and dense row ids in file order.

    Texts are read as they are, missing-value tokens become NULL, and every row of a column
    decides its type. Rows longer than the header, part files with different headers, or no
    rows at all, are errors. Rows are parsed and numbered once and written to the shared
    folder, so later reads never plan the file's splits anew. Line breaks inside quotes are
    found beforehand, and such input is still read split by split (``sources/quoted.py``). Only where
    lines end with a lone carriage return as well is it read file by file, as by ``multi_line=True``.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError("only .csv files can be ingested")
    odd, lone = _scan_lines(spark, path)
    whole_files = odd and lone if multi_line is None else multi_line
    options = {"header": True, "escape": '"', "multiLine": whole_files or odd, "enforceSchema": True}
    names = spark.read.options(**options).csv(path).columns
    if odd and multi_line is None and not lone:
        texts = _split_records(spark, path, names)
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
        # Spark keeps the text of rows with too few or too many fields in the extra column.
        raw = spark.read.options(**options | {"multiLine": whole_files}, columnNameOfCorruptRecord=_EXTRA).schema(schema).csv(path)
        texts = cut_lineage(
            raw.select(
                *_fields(names),
                F.col("_metadata.file_path").alias(_FILE),
                F.col("_metadata.file_block_start").alias(_START),
                F.monotonically_increasing_id().alias(_MONO),
            )
        )
    found = texts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_EXTRA).alias("extra"),
        *[a for i, n in enumerate(names) for a in _type_votes(col(n), i)],
    ).first()
    if found["extra"]:
        raise ValueError(f"{found['extra']} rows have more fields than the header")
    if not found["rows"]:
        raise ValueError("the CSV has no rows")
    typed = [_cast(col(n), i, found).alias(n) for i, n in enumerate(names)]
    return _numbered(texts, row_id).select(col(row_id), *typed)


def _fields(names: list[str]) -> list[Column]:
    """The texts of a row, and whether it has more fields than the header."""
    texts = [F.when(~col(n).isin(*NA_TOKENS), col(n)).alias(n) for n in names]
    return [*texts, _surplus(col(_EXTRA), len(names)).alias(_EXTRA)]


def _split_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Parsed rows of files whose quoted texts run over lines, every split by a task of its own."""
    text = quoted.lines(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
    options = {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": _EXTRA}
    place = [_FILE, _START, _MONO]

    def parsed(records: DataFrame) -> DataFrame:
        record = F.regexp_replace("record", "\r$", "")
        rows = records.select(F.from_csv(record, schema.toDDL(), options).alias("row"), *place)
        return rows.select("row.*", *place).select(*_fields(names), *place)

    for attempt in range(3):
        try:
            # Whole records are parsed at once; the pieces of those across a split's end are kept aside.
            cut = cut_lineage(quoted.records(text, quoted.split_starts(text)))
            break
        except Exception as failure:
            # Spark may plan a scan anew when executors come or go.
            if attempt == 2 or quoted.ChangedSplits.__name__ not in str(failure):
                raise
    pieces = cut_lineage(quoted.joined(cut.where("piece IS NOT NULL")))
    records = cut.where("piece IS NULL").drop("piece").unionByName(pieces)
    # One row per file: its header, and whether its lines end with a carriage return, which quoted breaks then lose too.
    header = F.regexp_replace("record", "\r$", "")
    headers = records.where(F.col(_MONO) < 0).select(F.col(_FILE).alias("of"), header.alias("header"), F.endswith("record", F.lit("\r")).alias("crlf"))
    headers = cut_lineage(headers)
    if len(headers.select("header").distinct().limit(2).collect()) > 1:
        raise ValueError("the part files have different headers")
    plain = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    below = records.where(F.col(_MONO) >= 0).join(headers, F.col(_FILE) == F.col("of"))
    return cut_lineage(parsed(below.select(plain.alias("record"), _FILE, _START, _MONO)))


def _surplus(record: Column, fields: int) -> Column:
    """Whether a row has more fields than the header, empty ones counted.

    A mark appended as one more field is found among the first ``fields + 1`` unless there are too many.
    """
    schema = ", ".join(f"f{i} string" for i in range(fields + 1))
    marked = F.from_csv(F.concat(F.rtrim(record, F.lit("\r\n")), F.lit(f",{_MARK}")), schema, {"escape": '"'})
    found = reduce(or_, [F.coalesce(marked[f"f{i}"] == _MARK, F.lit(False)) for i in range(fields + 1)])
    return record.isNotNull() & ~found


def _scan_lines(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether quotes run over line ends, and whether a carriage return stands alone; part files must have one header.

    A line with an odd number of quotes may open a text that a later line closes.
    """
    lines = quoted.lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lone = F.regexp_count("value", F.lit("\r(?!$)")) > 0
    found = lines.agg(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in (quotes % 2 == 1, lone)]).first()
    if not found[0]:
        first = lines.where(F.col(_START) == 0).groupBy(_FILE).agg(F.min_by("value", _MONO).alias("header"))
        if len(first.select(F.regexp_replace("header", "\r$", "")).distinct().limit(2).collect()) > 1:
            raise ValueError("the part files have different headers")
    return found[0], found[1]


def _type_votes(c: Column, i: int) -> list[Column]:
    return [
        F.count(c).alias(f"n{i}"),
        F.count_if(c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("long").isNotNull()).alias(f"l{i}"),
        F.count_if(_number(c).isNotNull()).alias(f"d{i}"),
        F.count_if(c.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"b{i}"),
    ]


def _number(c: Column) -> Column:
    # Java also reads "1d" and "1f" as numbers; here they are text.
    return F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c).try_cast("double")


def _cast(c: Column, i: int, found) -> Column:
    n = found[f"n{i}"]
    if n == found[f"l{i}"] and n:
        return c.cast("long")
    if n == found[f"d{i}"]:
        return _number(c)
    if n == found[f"b{i}"]:
        return F.lower(c) == "true"
    return c


def _numbered(texts: DataFrame, row_id: str) -> DataFrame:
    """Dense ids in (file, offset) order.

    Spark reads a split's lines in order inside one task but may order splits by size.
    A count per split, one row each, gives every split its first id.
    """
    splits = texts.groupBy(_FILE, _START).agg(F.min(_MONO).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # One row per split of the input: as many rows as the scan has tasks.
    before = F.sum("__rows").over(Window.orderBy(_FILE, _START).rowsBetween(Window.unboundedPreceding, -1))
    # Written out so its true size is known and Spark broadcasts it instead of moving the rows.
    splits = cut_lineage(splits.select(_FILE, _START, "__first", F.coalesce(before, F.lit(0)).alias("__before")))
    return texts.join(splits, [_FILE, _START]).withColumn(
        row_id, (F.col("__before") + F.col(_MONO) - F.col("__first")).cast("long")
    )


def with_row_id(df: DataFrame, order_by: list[str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    """Row ids for data that has none: by the given columns, else in reading order.

    The ids are written once, so every later use sees the same ones.
    """
    if order_by:
        return assign_row_id(df, order_by, row_id)
    return densify(cut_lineage(df.withColumn("__mono", F.monotonically_increasing_id())), row_id)


def _in_order(df: DataFrame, row_id: str | None, keep_order: bool) -> DataFrame:
    if row_id is None or row_id not in df.columns:
        return df
    ordered = df.orderBy(col(row_id)) if keep_order else df
    return ordered.select(*[col(c) for c in data_columns(df, row_id)])


def write_csv(df: DataFrame, path: str, row_id: str | None = ROW_ID, keep_order: bool = True) -> None:
    """Data columns with a header; part files are in row order unless that is waived."""
    out = _in_order(df, row_id, keep_order)
    # By default the CSV writer trims texts.
    out.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_parquet(df: DataFrame, path: str, row_id: str | None = ROW_ID, keep_order: bool = True) -> None:
    _in_order(df, row_id, keep_order).write.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
