import math

import pytest

from datalathe.operators import features
from datalathe.plans.steps import OPERATIONS, execute, replay


def _rows(df, *names):
    return [tuple(r) for r in df.orderBy("__row_id").select(*names).collect()]


def test_clean_text(column):
    df = column([" a ", "B\t", None, ""], "string")
    assert _rows(execute(df, "strip", {"column": "x"}), "x") == [("a",), ("B",), (None,), ("",)]
    assert _rows(execute(df, "change_case", {"column": "x", "case": "title"}), "x")[1] == ("B\t",)
    with pytest.raises(ValueError):
        execute(df, "change_case", {"column": "x", "case": "odd"})
    with pytest.raises(ValueError):
        execute(column([1], "long"), "strip", {"column": "x"})


def test_dates(column):
    df = column(["2024-02-29", None, "2024-03-01"], "string")
    assert _rows(features.date_parts(df, "x", ["year", "day_of_week", "day_of_year"]), "x_year", "x_day_of_week", "x_day_of_year") == [
        (2024, 3, 60), (None, None, None), (2024, 4, 61),
    ]
    fitted = features.fit_elapsed(df, "x")
    assert _rows(fitted.apply(df), "x_days") == [(1.0,), (None,), (0.0,)]
    assert _rows(execute(df, "elapsed", {"column": "x", "until": "2024-03-02", "unit": "hours"}), "x_hours")[0] == (48.0,)
    # Fitted once, applied elsewhere: the end stays.
    assert _rows(fitted.apply(column(["2024-02-20"], "string")), "x_days") == [(10.0,)]


def test_sizes_and_ranges(column):
    df = column(["two words", None, ""], "string")
    assert _rows(features.text_size(df, "x"), "x_length", "x_words") == [(9, 2), (None, None), (0, 0)]
    numbers = column([0.0, 1.0, float("nan"), None, 9.9, 10.0])
    assert _rows(execute(numbers, "bin", {"column": "x", "bins": 2}), "x_bin") == [(0,), (0,), (None,), (None,), (1,), (1,)]
    assert _rows(execute(column([5.0, 5.0]), "bin", {"column": "x"}), "x_bin") == [(0,), (0,)]  # one range holds all
    assert _rows(execute(column([None, None]), "bin", {"column": "x"}), "x_bin") == [(None,), (None,)]
    turns = _rows(features.cyclic(column([0.0, 6.0, 12.0]), "x", 24), "x_sin", "x_cos")
    assert turns[1] == pytest.approx((1.0, 0.0), abs=1e-12) and turns[2] == pytest.approx((math.sin(math.pi), -1.0), abs=1e-12)


def test_steps_replay_and_never_overwrite(column):
    df = column([" A ", "b"], "string")
    out = replay(df, [{"operation": o, "operation_params": {"column": "x"}} for o in ("strip", "change_case", "text_size")])
    assert _rows(out, "x", "x_length") == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError, match="exist"):
        features.text_size(out, "x")
    assert len(OPERATIONS) == 16
