import pytest

from datalathe.operators.impute import compare_strategies, fit_impute, impute, preview_imputation
from datalathe.operators.profile import summarize_column


def test_mean(column, values):
    assert values(impute(column([1.0, 2.0, None, 4.0]), "x", "mean"))[2] == pytest.approx(7 / 3)


def test_median_is_exact(column, values):
    assert values(impute(column([1.0, 2.0, None, 100.0]), "x", "median"))[2] == 2.0


def test_mode_takes_the_smallest_of_ties(column, values):
    assert values(impute(column(["a", "a", "b", None], "string"), "x", "mode")) == ["a", "a", "b", "a"]
    assert values(impute(column([3.0, 1.0, None]), "x", "mode")) == [3.0, 1.0, 1.0]
    assert values(impute(column([None, None]), "x", "mode")) == [None, None]


def test_constant(column, values):
    assert values(impute(column(["a", None, "c"], "string"), "x", "constant", "Unknown")) == ["a", "Unknown", "c"]
    assert values(impute(column([1, None], "long"), "x", "constant", "7")) == [1, 7]
    with pytest.raises(ValueError):
        impute(column(["a", None], "string"), "x", "constant")
    with pytest.raises(ValueError):
        impute(column([1.0, None]), "x", "constant", "Unknown")


@pytest.mark.parametrize("width", [1, 2, 3, 5, 1 << 20])
def test_fills_do_not_depend_on_buckets(column, values, width):
    data = [None, 1.0, None, None, None, None, None, None, 4.0, None, 5.0, None, None]
    forward = [None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 4.0, 4.0, 5.0, 5.0, 5.0]
    backward = [1.0, 1.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 5.0, 5.0, None, None]
    for partitions in (1, 8):
        df = column(data).repartition(partitions)
        width = max(width, 2)
        assert values(impute(df, "x", "forward_fill", bucket_rows=width)) == forward
        assert values(impute(df, "x", "backward_fill", bucket_rows=width)) == backward


def test_drop_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 10), (1, None, 20), (2, 3.0, 30)], "__row_id long, a double, b long")
    assert impute(df, "a", "drop_rows").count() == 2
    assert df.count() == 3


def test_numeric_strategies_reject_text(column):
    text = column(["a", "b", "c"], "string")
    for strategy in ("mean", "median"):
        with pytest.raises(ValueError, match="needs numbers"):
            impute(text, "x", strategy)
    assert impute(text, "x", "mode").count() == 3
    with pytest.raises(ValueError):
        impute(text, "x", "nearest")


def test_integer_mean_widens(column, values):
    assert values(impute(column([1, 2, None], "long"), "x", "mean")) == [1.0, 2.0, 1.5]


def test_nan_counts_as_missing(column, values):
    assert values(impute(column([1.0, float("nan"), 3.0]), "x", "mean")) == [1.0, 2.0, 3.0]


def test_fitted_value_applies_to_other_data(column, values):
    fitted = fit_impute(column([1.0, 3.0, None]), "x", "mean")
    assert fitted.state == {"value": 2.0}
    assert values(fitted.apply(column([None, 9.0]))) == [2.0, 9.0]


def test_summaries(column):
    s = summarize_column(column([1.0, 2.0, 3.0, None]), "x")
    assert (s["mean"], s["missing_count"], s["row_count"]) == (2.0, 1, 4)
    s = summarize_column(column(["a", "b", None], "string"), "x")
    assert (s["mean"], s["median"], s["missing_count"]) == (None, None, 1)


def test_preview_and_compare(column):
    df = column([1.0, None, None, 5.0])
    p = preview_imputation(df, "x", "forward_fill")
    assert p["before"]["missing_count"] == 2 and p["after"]["missing_count"] == 0
    assert p["sample_before"] == ["NaN", "NaN"] and p["sample_after"] == [1.0, 1.0]
    assert preview_imputation(df, "x", "drop_rows")["sample_after"] == []
    c = compare_strategies(df, "x", "mean", "drop_rows")
    assert c["after_a"]["row_count"] == 4 and c["after_b"]["row_count"] == 2
    with pytest.raises(ValueError):
        compare_strategies(df, "x", "mean", "constant")
