import pytest

from datalathe.operators.outliers import cap_outliers, detect_outliers, remove_outliers
from datalathe.operators.scale import scale

MASKED = [10, 11, 12, 13, 14, 12, 11, 13, 500]


def flagged(df, method):
    return detect_outliers(df, "x", method)["outlier_values"]


def test_iqr(column):
    assert flagged(column([10, 11, 12, 13, 14, 100], "long"), "iqr") == [100]
    assert flagged(column([10, 11, 12, 13, 14, 15], "long"), "iqr") == []
    assert flagged(column([-500, 10, 11, 12, 13, 14], "long"), "iqr") == [-500]


def test_zscores(column):
    clear = [10, 11, 12, 13, 14, 12, 11, 13, 10, 12, 11, 13, 14, 12, 5000]
    assert flagged(column(clear, "long"), "zscore") == [5000]
    assert flagged(column(MASKED, "long"), "zscore") == []
    assert flagged(column(MASKED, "long"), "modified_zscore") == [500]
    for method in ("zscore", "modified_zscore"):
        assert flagged(column([5, 5, 5, 5], "long"), method) == []


def test_report(column):
    r = detect_outliers(column([10, 11, 12, 100], "long"), "x", "iqr")
    assert (r["outlier_count"], r["outlier_percentage"], r["outlier_indices"]) == (1, 25.0, [3])
    with pytest.raises(ValueError):
        detect_outliers(column([1.0, 2.0]), "x", "distance")
    with pytest.raises(ValueError):
        detect_outliers(column(["a"], "string"), "x", "iqr")


def test_remove_and_cap(column, values):
    df = column([10, 11, 12, 13, 1000, None], "long")
    assert values(remove_outliers(df, "x", "iqr")) == [10, 11, 12, 13, None]
    capped = values(cap_outliers(df, "x", "iqr"))
    assert len(capped) == 6 and max(v for v in capped if v is not None) == 16.0 and capped[5] is None
    assert values(cap_outliers(column([10, 11, 12, 13, 14], "long"), "x", "iqr")) == [10, 11, 12, 13, 14]
    # without spread nothing is an outlier, so nothing is capped
    assert values(cap_outliers(column([5, 5, 5, 9], "long"), "x", "modified_zscore")) == [5, 5, 5, 9]


def test_scaling(column, values):
    df = column([10, 20, 30], "long")
    assert values(scale(df, "x", "minmax")) == [0.0, 0.5, 1.0]
    assert values(scale(df, "x", "standard")) == [-1.0, 0.0, 1.0]
    assert values(scale(df, "x", "robust")) == [-1.0, 0.0, 1.0]
    assert values(scale(df, "x", "maxabs")) == pytest.approx([1 / 3, 2 / 3, 1.0])
    assert values(scale(column([3.0, 4.0, None]), "x", "normalize")) == pytest.approx([0.6, 0.8, None])


def test_scaling_without_spread(column, values):
    flat = column([7.0, 7.0])
    assert values(scale(flat, "x", "minmax")) == [0.0, 0.0]
    assert values(scale(flat, "x", "standard")) == [0.0, 0.0]
    assert values(scale(flat, "x", "robust")) == [0.0, 0.0]
    assert values(scale(column([0.0, 0.0]), "x", "maxabs")) == [0.0, 0.0]
    with pytest.raises(ValueError):
        scale(column(["a"], "string"), "x", "minmax")
    with pytest.raises(ValueError):
        scale(flat, "x", "rank")
