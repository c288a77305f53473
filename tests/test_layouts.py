"""Date layouts inferred from whole columns."""

import datetime

import pytest

from datalathe.operators.convert import convert, fit_convert
from datalathe.operators.layouts import infer_layouts
from datalathe.plans.steps import replay


def _found(df, column="x"):
    return {r["layout"]: (r["rows"], r["order"], r["status"]) for r in infer_layouts(df, [column]).collect()}


def _dates(df, column="x"):
    return [None if r[0] is None else r[0].isoformat()[:16] for r in convert(df, column, "datetime", "infer").orderBy("__row_id").select(column).collect()]


def test_order_is_decided_by_the_whole_column(column):
    day = column(["3/4/2024", "25/4/2024", None, ""], "string")
    assert _found(day) == {"d/M/yyyy": (2, "day_first", "decided")}
    assert _dates(day) == ["2024-04-03T00:00", "2024-04-25T00:00", None, None]
    month = column(["3/4/2024", "4/25/2024"], "string")
    assert _found(month) == {"M/d/yyyy": (2, "month_first", "decided")}
    assert _dates(month) == ["2024-03-04T00:00", "2024-04-25T00:00"]


def test_ambiguous_borrowed_and_mixed(column):
    assert _found(column(["3/4/2024", "3.4.2024"], "string")) == {
        "M/d/yyyy": (1, "month_first", "ambiguous"), "d.M.yyyy": (1, "day_first", "ambiguous"),
    }
    borrowed = column(["3/4/2024", "30-4-2024"], "string")
    assert _found(borrowed) == {"d/M/yyyy": (1, "day_first", "borrowed"), "d-M-yyyy": (1, "day_first", "decided")}
    mixed = column(["3/4/2024", "30/4/2024", "31/4/2024", "4/30/2024", "1/2/2024 9:05"], "string")
    assert {s for _, _, s in _found(mixed).values()} == {"mixed"}
    # A value that proves its order keeps it; a day that does not exist is missing.
    assert _dates(mixed) == ["2024-04-03T00:00", "2024-04-30T00:00", None, "2024-04-30T00:00", "2024-02-01T09:05"]


def test_layouts_with_one_reading(column):
    texts = [" 2024-02-29 ", "2024/2/29 7:08", "Feb 29, 2024", "february 29 2024", "29 Feb 2024", "29-Feb-2024 07:08:09", "20240229",
             "2024-02-29T07:08:09", "2024-02-29 07:08:09.5", "2024-02-30", "soon", "7:08", "29/2"]
    df = column(texts, "string")
    day, at = "2024-02-29T00:00", "2024-02-29T07:08"
    assert _dates(df) == [day, at, day, day, day, at, day, at, at, None, None, None, None]
    found = _found(df)
    assert found[None] == (3, None, "unknown") and found["iso"][0] == 1 and found["yyyy-M-d"] == (2, None, "certain")


def test_fitted_once_applied_elsewhere_and_replayed(column):
    df = column(["25/4/2024", "1/2/2024"], "string")
    fitted = fit_convert(df, "x", "datetime", "infer")
    assert fitted.state == {"signatures": ["9/9/9999"], "orders": {"/": "day_first"}}
    other = fitted.apply(column(["5/6/2024", "2024-01-01"], "string")).orderBy("__row_id").collect()
    assert [r["x"] for r in other] == [datetime.datetime(2024, 6, 5), None]
    step = {"operation": "convert_dtype", "operation_params": fitted.params}
    assert replay(df, [step]).schema["x"].dataType.typeName() == "timestamp"
    assert _dates(column([None, None], "string")) == [None, None]
    with pytest.raises(ValueError, match="dates only"):
        convert(df, "x", "float", "infer")
    with pytest.raises(KeyError):
        infer_layouts(df, ["y"])
