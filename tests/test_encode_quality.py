import pytest

from datalathe.operators import encode as E
from datalathe.operators import quality as Q
from datalathe.operators.categorical import category_frequencies, multi_label_profile
from datalathe.operators.convert import convert, preview_conversion


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("__row_id").select(*names).collect()]


def test_one_hot(column):
    out = E.encode(column(["b", None, "a"], "string"), "x", "one_hot")
    assert out.columns == ["__row_id", "x_a", "x_b"]
    assert rows(out, "x_a", "x_b") == [(0, 1), (0, 0), (1, 0)]
    numbers = E.encode(column([2, 1], "long"), "x", "one_hot")
    assert numbers.columns == ["__row_id", "x_1", "x_2"]
    with pytest.raises(ValueError, match="max_columns"):
        E.encode(column(["a", "b", "c"], "string"), "x", "one_hot", max_columns=2)


@pytest.mark.parametrize("map_rows", [50_000, 1])
def test_codes_and_counts(column, map_rows):
    df = column(["pear", None, "apple", "pear", "fig"], "string")
    assert rows(E.encode(df, "x", "label", map_rows=map_rows), "x") == [(2,), (None,), (0,), (2,), (1,)]
    assert rows(E.encode(df, "x", "frequency", map_rows=map_rows), "x") == [(2,), (None,), (1,), (2,), (1,)]
    binary = E.encode(df, "x", "binary", map_rows=map_rows)
    assert binary.columns == ["__row_id", "x_bin_0", "x_bin_1"]
    assert rows(binary, "x_bin_0", "x_bin_1") == [(0, 1), (None, None), (0, 0), (0, 1), (1, 0)]


def test_binary_of_one_category(column):
    assert rows(E.encode(column(["k", "k"], "string"), "x", "binary"), "x_bin_0") == [(0,), (0,)]


def test_ordinal(column):
    df = column(["Low", "High", "Odd", None], "string")
    assert rows(E.encode(df, "x", "ordinal", order=["Low", "High"]), "x") == [(0,), (1,), (None,), (None,)]
    with pytest.raises(ValueError):
        E.encode(df, "x", "ordinal")
    with pytest.raises(ValueError):
        E.encode(df, "x", "hashing")


def test_multi_label(column):
    df = column(["a|b", "b| c ", None, "a|", "a|b|c", "c|a"], "string")
    out = E.encode(df, "x", "multi_label")
    assert out.columns == ["__row_id", "x_a", "x_b", "x_c"]
    assert rows(out, "x_a", "x_b", "x_c") == [(1, 1, 0), (0, 1, 1), (0, 0, 0), (1, 0, 0), (1, 1, 1), (1, 0, 1)]
    fitted = E.fit_encode(df, "x", "multi_label")
    assert fitted.params["delimiter"] == "|"
    p = multi_label_profile(df, "x").collect()
    assert (p[0]["vocabulary_size"], p[0]["avg_labels_per_row"]) == (3, 2.2)
    assert [(r["label"], r["count"]) for r in p] == [("a", 4), ("b", 3), ("c", 3)]
    with pytest.raises(ValueError):
        E.encode(column(["one", "two"], "string"), "x", "multi_label")


def test_category_frequencies(column):
    f = category_frequencies(column(["b", "a", "b", None, "c"], "string"), "x", 2).collect()
    assert [tuple(r) for r in f] == [("b", 2, 50.0, 3), ("a", 1, 25.0, 3)]


@pytest.fixture
def repeated(spark):
    data = [(0, 1, None), (1, 2, "x"), (2, 1, None), (3, 2, "x"), (4, 2, "x"), (5, 3, "x")]
    return spark.createDataFrame(data, "__row_id long, a long, b string").repartition(3)


def test_duplicate_rows(repeated):
    d = Q.duplicate_rows(repeated).first()
    assert (d["count"], d["percentage"], d["rows"]) == (3, 50.0, 6)
    assert [r[0] for r in rows(Q.remove_duplicate_rows(repeated), "__row_id")] == [0, 1, 5]
    assert [r[0] for r in rows(Q.remove_duplicate_rows(repeated, "last"), "__row_id")] == [2, 4, 5]
    p = Q.duplicate_rows_preview(repeated)
    assert p["rows_after_removal"] == 3 and [r["__row_id"] for r in p["sample_duplicate_rows"]] == [2, 3, 4]
    with pytest.raises(ValueError):
        Q.remove_duplicate_rows(repeated, "middle")


def test_duplicate_rows_of_empty_data(repeated):
    d = Q.duplicate_rows(repeated.limit(0)).first()
    assert (d["count"], d["percentage"]) == (0, 0.0)


def test_duplicate_columns(spark):
    data = [(i, i, float(i), i if i != 3 else None, i, str(i), i) for i in range(6)]
    df = spark.createDataFrame(data, "__row_id long, a long, b double, c long, d long, e string, f int")
    assert Q.duplicate_columns(df) == [("a", "d")]
    nulls = spark.createDataFrame([(0, None, None), (1, 1, 1), (2, 1, 1)], "__row_id long, a long, b long")
    assert Q.duplicate_columns(nulls) == [("a", "b")]
    with pytest.raises(KeyError):
        Q.remove_columns(df, ["a", "z"])
    assert Q.remove_columns(df, ["a", "e"]).columns == ["__row_id", "b", "c", "d", "f"]


def test_conversion(column, values):
    texts = column(["1.0", "2.5", "x", "1d", " 3 ", None], "string")
    assert values(convert(texts, "x", "float")) == [1.0, 2.5, None, None, 3.0, None]
    assert values(convert(texts, "x", "integer")) == [1, 2, None, None, 3, None]
    assert values(convert(column([0.5, 1.5, 2.5, None]), "x", "integer")) == [0, 2, 2, None]
    assert values(convert(column([1, None], "long"), "x", "string")) == ["1", None]
    days = convert(column(["2024-01-05", "01/06/2024", "soon", "2024-01-07 10:30:00"], "string"), "x", "datetime")
    assert [v and v.isoformat() for v in values(days)] == [
        "2024-01-05T00:00:00", "2024-01-06T00:00:00", None, "2024-01-07T10:30:00",
    ]
    tagged = convert(column(["a", "b"], "string"), "x", "category")
    assert tagged.schema["x"].metadata == {"logical_type": "categorical"}
    with pytest.raises(ValueError):
        convert(texts, "x", "complex")


def test_conversion_preview(column):
    p = preview_conversion(column(["1", "Unknown", None, "2"], "string"), "x", "float")
    assert (p["before_missing"], p["after_missing"], p["newly_invalid_count"]) == (1, 2, 1)
    assert (p["sample_before"], p["sample_after"]) == (["1", "Unknown", "2"], [1.0, None, 2.0])
    assert (p["before_dtype"], p["after_dtype"]) == ("string", "double")


def test_names_never_collide(spark, tmp_path):
    df = spark.createDataFrame([(0, "web", 1), (1, "WEB", 2), (2, "Web", 3)], "__row_id long, x string, x_web int")
    out = E.encode(df, "x", "one_hot")
    names = [n.lower() for n in out.columns]
    assert len(set(names)) == len(names) == 5
    out.write.parquet(str(tmp_path / "t"))
    assert [r["x_web"] for r in out.orderBy("__row_id").collect()] == [1, 2, 3]


def test_ordinal_entries_stay_apart(column):
    df = column([1, 2], "long")
    with pytest.raises(ValueError, match="become equal"):
        E.encode(df, "x", "ordinal", order=["1", "01"])
    assert rows(E.encode(df, "x", "ordinal", order=["2", "1"]), "x") == [(1,), (0,)]


def test_state_is_plain_data_at_any_size(column, spark):
    df = column(["b", "a", None], "string")
    for map_rows in (50_000, 1):
        fitted = E.fit_encode(df, "x", "label", map_rows=map_rows)
        assert fitted.state["size"] == 2
        assert sorted(spark.read.parquet(fitted.state["map"]).select("__key", "__code").collect()) == [("a", 0), ("b", 1)]


def test_missing_values_of_both_kinds_are_equal(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, None), (2, 1.0)], "__row_id long, x double")
    assert Q.duplicate_rows(df).first()["count"] == 1
    assert rows(Q.remove_duplicate_rows(df), "__row_id", "x") == [(0, None), (2, 1.0)]
    preview = Q.duplicate_rows_preview(df)
    assert preview["duplicate_count"] == 1 and preview["sample_duplicate_rows"][0]["__row_id"] == 1


def test_awkward_names(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "__row_id long, `a.b` long, `c``d` long")
    assert Q.duplicate_rows_preview(df)["duplicate_count"] == 1
    assert convert(df, "a.b", "category").schema["a.b"].metadata == {"logical_type": "categorical"}
    assert E.encode(df, "c`d", "label").columns == df.columns


def test_category_keeps_its_values(column):
    df = convert(column([10, 2, 9], "long"), "x", "category")
    assert rows(df, "x") == [(10,), (2,), (9,)]
    assert rows(E.encode(df, "x", "label"), "x") == [(2,), (0,), (1,)]


def test_doubled_rows_do_not_hide_equal_columns(spark):
    values = [(i, i * 7 % 5, i * 3 % 4, i * 7 % 5) for i in range(20)]
    df = spark.createDataFrame([(k, *v[1:]) for k, v in enumerate(values + values)], "__row_id long, a long, b long, c long")
    assert Q.duplicate_columns(df) == [("a", "c")]


@pytest.mark.parametrize("map_rows", [50_000, 1])
@pytest.mark.parametrize("method, kept", [("one_hot", {}), ("multi_label", {"delimiter": "|"})])
def test_sparse_flags_are_those_of_the_columns(spark, method, kept, map_rows):
    texts = ["b|a", None, "c", "b | a|b", "", "|", "é|B", "b|a", "c"]
    df = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(texts)], "__row_id long, x string, x_flags int").repartition(3)
    wide = E.encode(df, "x", method, **kept)
    names = [c for c in wide.columns if c not in df.columns]
    expected = [(r["x_flags"], len(names), [i for i, c in enumerate(names) if r[c]]) for r in wide.collect()]
    found = E.encode(df, "x", method, form="sparse", map_rows=map_rows, **kept)
    assert found.columns == ["__row_id", "x_flags", "x_flags_2"]
    assert sorted((r["x_flags"], r["x_flags_2"]["size"], r["x_flags_2"]["indices"]) for r in found.collect()) == sorted(expected)
    with pytest.raises(ValueError, match="max_columns"):
        E.encode(df, "x", method, form="sparse", max_columns=2, **kept)
    with pytest.raises(ValueError, match="form"):
        E.encode(df, "x", method, form="dense", **kept)


@pytest.mark.parametrize("method, kept", [("one_hot", {}), ("multi_label", {"delimiter": "|"})])
def test_sparse_flags_need_no_column_per_value(spark, method, kept):
    """More values than a plan could hold as columns, and a loaded fit that gives the same."""
    n = 120_000
    df = spark.range(n).selectExpr("id AS __row_id", "concat('v', lpad(id, 9, '0'), '|all') AS x")
    out = E.encode(df, "x", method, form="sparse", **kept)
    assert len(out.columns) == 2
    odd = out.where("__row_id % 40000 = 7").orderBy("__row_id").collect()
    extra = [0] if method == "multi_label" else []
    expected = [(n + len(extra), extra + [i + len(extra)]) for i in (7, 40007, 80007)]
    assert [(r["x_flags"]["size"], r["x_flags"]["indices"]) for r in odd] == expected


def test_sparse_flags_of_a_loaded_fit(spark, tmp_path):
    from datalathe.plans.fitted import FittedPipeline, fit_steps

    df = spark.createDataFrame([(0, "b", "u|v"), (1, None, "v"), (2, "a", None)], "__row_id long, x string, y string")
    steps = [
        {"operation": "encode", "operation_params": {"column": "x", "method": "one_hot", "form": "sparse"}},
        {"operation": "encode", "operation_params": {"column": "y", "method": "multi_label", "delimiter": "|", "form": "sparse"}},
    ]
    fit_steps(df, steps).save(spark, str(tmp_path / "fit"))
    other = spark.createDataFrame([(0, "a", "v|w"), (1, "z", "v|u")], "__row_id long, x string, y string")
    out = FittedPipeline.load(spark, str(tmp_path / "fit")).transform(other)
    assert [[r["x_flags"]["indices"], r["y_flags"]["indices"]] for r in out.orderBy("__row_id").collect()] == [[[0], [1]], [[], [0, 1]]]
