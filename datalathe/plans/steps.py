"""Recorded steps as data: one registry of operations, replay, and JSON or YAML export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from datalathe.functions.kinds import ROW_ID
from datalathe.operators import convert, encode, features, impute, outliers, quality, scale, transforms
from datalathe.session import cut_lineage


def _impute(df, p, row_id):
    own = {k: p[k] for k in ("features", "neighbours") if p.get(k) is not None}
    return impute.impute(df, p["column"], p["strategy"], p.get("constant_value"), row_id, **own)


def _encode(df, p, row_id):
    return encode.encode(df, p["column"], p["method"], **{k: p[k] for k in ("order", "delimiter", "max_columns", "form") if p.get(k) is not None})


OPERATIONS = {
    "impute": _impute,
    "remove_duplicate_rows": lambda df, p, r: quality.remove_duplicate_rows(df, p.get("keep", "first"), r),
    "remove_duplicate_columns": lambda df, p, r: quality.remove_columns(df, p["columns_to_drop"]),
    "convert_dtype": lambda df, p, r: convert.convert(df, p["column"], p["target_type"], p.get("layouts")),
    "transform": lambda df, p, r: transforms.apply_transform(df, p["column"], p["transform"]),
    "outlier_treatment": lambda df, p, r: outliers.fit_outliers(df, p["column"], p["method"], p["action"]).apply(df),
    "encode": _encode,
    "scale": lambda df, p, r: scale.scale(df, p["column"], p["method"]),
    "drop_column": lambda df, p, r: quality.remove_columns(df, [p["column"]]),
    "strip": lambda df, p, r: features.strip(df, p["column"]),
    "change_case": lambda df, p, r: features.change_case(df, p["column"], p.get("case", "lower")),
    "date_parts": lambda df, p, r: features.date_parts(df, p["column"], p.get("parts")),
    "elapsed": lambda df, p, r: features.fit_elapsed(df, p["column"], p.get("until"), p.get("unit", "days")).apply(df),
    "text_size": lambda df, p, r: features.text_size(df, p["column"]),
    "bin": lambda df, p, r: features.fit_bin(df, p["column"], p.get("bins", 10), p.get("method", "equal_width")).apply(df),
    "cyclic": lambda df, p, r: features.cyclic(df, p["column"], p["period"]),
}


def execute(df: DataFrame, operation: str, params: dict | None, row_id: str = ROW_ID) -> DataFrame:
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation '{operation}'")
    return OPERATIONS[operation](df, params or {}, row_id)


def resolve(df: DataFrame, operation: str, params: dict | None) -> dict:
    """Parameters as they are to be recorded: an automatic delimiter is replaced by the one found."""
    params = dict(params or {})
    if operation == "encode" and params.get("method") == "multi_label" and not params.get("delimiter"):
        from datalathe.operators.types import detect_delimiter

        params["delimiter"] = detect_delimiter(df, params["column"])
    return params


def moves_rows(step: dict) -> bool:
    p = step.get("operation_params") or {}
    by_join = step["operation"] == "encode" and (p.get("method") not in ("multi_label",) or p.get("form") == "sparse")
    return step["operation"] == "remove_duplicate_rows" or by_join or p.get("strategy") in ("forward_fill", "backward_fill")


def replay(df: DataFrame, steps: list[dict], row_id: str = ROW_ID, cut: bool = True) -> DataFrame:
    """Run the steps in order, learning statistics anew at each one.

    A step without operation is skipped. Rows a step has shuffled are written out when
    another step follows, so that step's statistics do not repeat the shuffle.
    """
    steps = [s for s in steps if s.get("operation") is not None]
    for i, step in enumerate(steps):
        df = execute(df, step["operation"], step.get("operation_params"), row_id)
        if cut and i + 1 < len(steps) and moves_rows(step):
            df = cut_lineage(df)
    return df


def steps_to_json(steps: list[dict]) -> str:
    return json.dumps(steps, indent=2)


def steps_to_yaml(steps: list[dict]) -> str:
    import yaml  # optional dependency, only for YAML export

    return yaml.safe_dump(steps, sort_keys=False, default_flow_style=False)


def steps_from_text(text: str) -> list[dict]:
    """Steps from exported JSON or YAML."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text)
