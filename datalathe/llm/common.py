"""What the operators of this package share: tables, Arrow mapping and packed gathers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(column: str) -> Column:
    """The column's text as UTF-8 bytes, empty where it is null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")


def payloads(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow column of texts, empty for nulls; the column is not copied."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    for value in texts.cast(kind):
        yield value.as_py() or b""


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so what is made of them is never held for a whole batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def row_struct(df: DataFrame, name: str) -> Column:
    """All columns as one, so an operator can carry rows whatever their columns are called."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def with_fields(schema: StructType, fields: str) -> StructType:
    """The schema and further fields, given as SQL text; an output name the input already has is an error."""
    new = _parse_datatype_string(fields)
    clash = {f.name.lower() for f in schema} & {f.name.lower() for f in new}
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    return StructType([*schema.fields, *new.fields])


def map_arrow(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` for a function that yields one dict of columns per output batch."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            arrays = [_array(columns[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, kind)


#: Rows of a batch that Spark's Parquet reader decodes at once, and bytes of a row group, where whole texts are read and written.
READ_ROWS, ROW_GROUP = 512, 8 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller batches for this session's jobs from now on: whole texts stand in them, in the JVM and in Python.

    Arrow batches and those of the Parquet reader hold fewer rows, and written row groups fewer bytes: a task that
    writes holds a row group, one that reads a column of it, each as large arrays. A setting that is smaller already stays.
    """
    most = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": rows,
        "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS,
        "parquet.block.size": ROW_GROUP,
    }
    for setting, limit in most.items():
        # Arrow's setting has no limit at 0 and below.
        own = int(spark.conf.get(setting, "0"))
        spark.conf.set(setting, min(limit, own) if own > 0 else limit)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The stretches ``flat[starts[i]:starts[i] + lengths[i]]`` for each chosen i, one after the other."""
    n = lengths[chosen]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts[chosen] - (ends - n), n) + np.arange(ends[-1])]
