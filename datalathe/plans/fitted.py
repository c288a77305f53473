"""Steps fitted once, saved, and applied to other tables or to a stream.

A replay learns every statistic anew from the rows it is given; a fitted pipeline keeps what
it learnt. Its folder holds one JSON file of parameters and learnt values and one table per
value map, so a new session, or a stream that is restarted, applies exactly the same treatment.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from datalathe.functions.kinds import ROW_ID
from datalathe.operators import convert, encode, features, impute, layouts, outliers, scale, transforms
from datalathe.operators.steps import Fitted
from datalathe.plans.steps import execute, moves_rows, resolve
from datalathe.session import cut_lineage, shared_folder

#: Steps that look at other rows of their own table: run while fitting, and no part of what is applied later.
ROW_STEPS = ("remove_duplicate_rows",)


def _stateless(operation: str):
    return lambda p, s, spark: Fitted(operation, p, transform=lambda d: execute(d, operation, p))


def _restore_impute(p, s, spark):
    if p["strategy"] == "drop_rows":
        return impute.without_missing(p["column"])
    return impute.filled_with(p["column"], p["strategy"], p.get("constant_value"), _value(s["value"]))


def _restore_convert(p, s, spark):
    if p.get("layouts") == "infer":
        return layouts.by_layouts(p["column"], s["signatures"], s["orders"])
    return convert.to_type(p["column"], p["target_type"])


def _restore_encode(p, s, spark):
    sparse = p.get("form") == "sparse"
    if p["method"] == "multi_label" and not sparse:
        return encode.multi_label(p["column"], p["delimiter"], s["labels"], p.get("max_columns"))
    codes = encode.ValueMap(s["map"], s["size"], encode.MAP_ROWS)
    if p["method"] == "multi_label":
        return encode.multi_label_sparse(p["column"], p["delimiter"], codes, p.get("max_columns"))
    if p["method"] == "one_hot" and sparse:
        return encode.one_hot_sparse(p["column"], codes, p.get("max_columns"))
    if p["method"] == "one_hot":
        rows = spark.read.parquet(s["map"]).orderBy("__code").collect()  # each of them is a column
        return encode.one_hot(p["column"], [r["__key"] for r in rows], codes, p.get("max_columns"))
    return encode.binary(p["column"], codes) if p["method"] == "binary" else encode.mapped(p, codes)


#: How each operation is put together again from its parameters and what it learnt.
RESTORE = {
    "impute": _restore_impute,
    "convert_dtype": _restore_convert,
    "encode": _restore_encode,
    "transform": lambda p, s, spark: transforms.curved(p["column"], p["transform"], s.get("power")),
    "outlier_treatment": lambda p, s, spark: outliers.treated(p["column"], p["method"], p["action"], s["bounds"]),
    "scale": lambda p, s, spark: scale.scaled(p["column"], p["method"], s),
    "elapsed": lambda p, s, spark: features.elapsed_until(p["column"], p["unit"], s["until_micros"], p.get("until")),
    "bin": lambda p, s, spark: features.binned(p["column"], p["bins"], p["method"], s["edges"]),
    **{
        name: _stateless(name)
        for name in ("remove_duplicate_columns", "drop_column", "strip", "change_case", "date_parts", "text_size", "cyclic")
    },
}


def _fit(df: DataFrame, operation: str, p: dict, row_id: str) -> Fitted:
    column = p.get("column")
    if operation == "impute":
        if p["strategy"] in impute.FROM_ROWS:
            raise ValueError(f"{p['strategy']} fills from other rows of the same table; nothing learnt could fill new rows")
        return impute.fit_impute(df, column, p["strategy"], p.get("constant_value"), row_id)
    if operation == "convert_dtype":
        return convert.fit_convert(df, column, p["target_type"], p.get("layouts"))
    if operation == "encode":
        return encode.fit_encode(df, column, p["method"], **{k: p[k] for k in ("order", "delimiter", "max_columns", "form") if p.get(k) is not None})
    if operation == "transform":
        return transforms.fit_transform(df, column, p["transform"])
    if operation == "outlier_treatment":
        return outliers.fit_outliers(df, column, p["method"], p["action"])
    if operation == "scale":
        return scale.fit_scale(df, column, p["method"])
    if operation == "elapsed":
        return features.fit_elapsed(df, column, p.get("until"), p.get("unit", "days"))
    if operation == "bin":
        return features.fit_bin(df, column, p.get("bins", 10), p.get("method", "equal_width"))
    if operation not in RESTORE:
        raise ValueError(f"unknown operation '{operation}'")
    return RESTORE[operation](p, {}, df.sparkSession)


@dataclass(frozen=True)
class FittedPipeline:
    """Treatments in order. ``transform`` only builds expressions and joins with small or written maps."""

    treatments: tuple[Fitted, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """The treated rows of a table or of a stream with the columns the pipeline was fitted on."""
        for t in self.treatments:
            df = t.apply(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Write a new folder with everything the pipeline learnt; an existing pipeline is an error.

        The JSON file is written last, so a folder in which a write failed halfway is no pipeline.
        """
        path = path.rstrip("/")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pipeline")
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            raise ValueError(f"{path} holds a pipeline already")
        steps = []
        for i, t in enumerate(self.treatments):
            state = dict(t.state)
            if "value" in state:
                state["value"] = _tagged(state["value"])
            if "map" in state:
                spark.read.parquet(state["map"]).write.mode("overwrite").parquet(f"{path}/map{i}")
                state["map"] = f"map{i}"
            steps.append({"operation": t.operation, "params": t.params, "state": state})
        text = json.dumps(steps)
        spark.createDataFrame([(text,)], "steps string").coalesce(1).write.json(f"{path}/pipeline")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedPipeline:
        path = path.rstrip("/")
        text = spark.read.schema("steps string").json(f"{path}/pipeline").first()["steps"]
        out = []
        for s in json.loads(text):
            state = s["state"]
            if "map" in state:
                state["map"] = f"{path}/{state['map']}"
            out.append(RESTORE[s["operation"]](s["params"], state, spark))
        return FittedPipeline(tuple(out))


def fit_steps(df: DataFrame, steps: list[dict], row_id: str = ROW_ID) -> FittedPipeline:
    """Learn the recorded steps on a table, each on the result of those before it.

    Removing duplicate rows shapes what the later steps learn from, and is not applied to other rows. Forward
    and backward fill and filling from neighbours read rows of their own table and are errors. A step without
    operation is skipped.
    """
    out = []
    steps = [s for s in steps if s.get("operation") is not None]
    for i, step in enumerate(steps):
        operation = step["operation"]
        params = resolve(df, operation, step.get("operation_params"))
        if operation in ROW_STEPS:
            df = execute(df, operation, params, row_id)
        else:
            fitted = _fit(df, operation, params, row_id)
            out.append(fitted)
            df = fitted.apply(df)
        if i + 1 < len(steps) and moves_rows(step):
            df = cut_lineage(df)
    return FittedPipeline(tuple(out))


def treat_stream(
    pipeline: FittedPipeline, stream: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Start a query that writes the treated rows of ``stream`` to Parquet files below ``path``.

    The checkpoint makes a restarted query go on where the last one ended, and the sink's own log makes every
    batch count once. With ``available_now`` the query ends when it has taken in what there is.
    """
    if not stream.isStreaming:
        raise ValueError("treat_stream needs a streaming DataFrame; use transform for a table")
    name = path.rstrip("/").rsplit("/", 1)[-1]
    writer = (
        pipeline.transform(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or f"{shared_folder(stream.sparkSession).rstrip('/')}/datalathe-stream-{name}")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _tagged(value) -> dict:
    """A learnt value with its type, as JSON has neither dates nor decimals."""
    for kind, t in (("timestamp", datetime), ("date", date), ("decimal", Decimal)):
        if isinstance(value, t):
            return {"type": kind, "text": str(value) if kind == "decimal" else value.isoformat()}
    return {"type": "plain", "plain": value}


def _value(tagged):
    if not (isinstance(tagged, dict) and "type" in tagged):
        return tagged
    read = {"timestamp": datetime.fromisoformat, "date": date.fromisoformat, "decimal": Decimal}
    return tagged["plain"] if tagged["type"] == "plain" else read[tagged["type"]](tagged["text"])
