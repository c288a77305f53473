import datetime

import numpy as np
import pytest

from datalathe.operators import types
from datalathe.operators.profile import distinct_summary, entropy, overview, profile
from datalathe.operators.quality import case_flags, variation_flags, whitespace_flags


def detected(df, overrides=None):
    return {c: t[1] for c, t in types.effective_types(df, overrides).items()}


@pytest.fixture
def mixed(spark):
    rows = [
        (
            i, i, f"C{i:04d}", float(i % 7), "yes" if i % 3 else "no", bool(i % 2), datetime.datetime(2024, 1, 1 + i % 28),
            f"some words about row {i}", "a|b" if i % 2 else "b|c|a", None, [1.0],
        )
        for i in range(300)
    ]
    schema = (
        "__row_id long, order_id long, code string, level double, answer string, flag boolean, day timestamp, "
        "note string, tags string, nothing string, vector array<double>"
    )
    return spark.createDataFrame(rows, schema)


def test_logical_types(mixed):
    assert detected(mixed) == {
        "order_id": "id", "code": "id", "level": "numerical", "answer": "categorical", "flag": "boolean",
        "day": "datetime", "note": "text", "tags": "multi_label", "nothing": "categorical", "vector": "mixed",
    }


def test_override_wins(mixed):
    t = types.effective_types(mixed, {"answer": "text"})
    assert t["answer"] == ("categorical", "text", True) and t["level"] == ("numerical", "numerical", False)
    with pytest.raises(ValueError):
        types.effective_types(mixed, {"answer": "ordinal"})


def test_integer_with_gaps_is_no_id(spark):
    df = spark.createDataFrame([(i, i if i else None) for i in range(50)], "__row_id long, user_id long")
    assert detected(df) == {"user_id": "numerical"}


def test_id_by_name_needs_near_uniqueness(spark):
    rows = [(i, i // 2 if i < 4 else i, i // 2 if i < 4 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "__row_id long, user_id long, amount long")
    assert detected(df) == {"user_id": "id", "amount": "numerical"}


def test_samples_look_beyond_empty_beginnings(spark, monkeypatch):
    monkeypatch.setattr(types, "PROBE_ROWS", 4)
    monkeypatch.setattr(types, "PROBE_GROWTH", 3)
    rows = [(i, f"t{i}", f"s{i}" if i >= 500 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "__row_id long, a string, b string").repartition(5)
    got = types.first_values(df, ["a", "b"], n=50).collect()
    assert {r["value"] for r in got if r["column"] == "a"} == {f"t{i}" for i in range(50)}
    assert {r["value"] for r in got if r["column"] == "b"} == {f"s{i}" for i in range(500, 550)}


@pytest.mark.parametrize(
    "texts, expected",
    [
        (["Action|Comedy", "Drama|Action", "Comedy|Drama", "Action|Drama", "Drama|Comedy|Action"], "|"),
        (["a;b", "b;a", "a;b", "b;a"], ";"),
        (["a/b,c", "b/a,c", "a/b,c", "b/a,c"], ","),  # equal split ratio; more repetition wins
        (["1 Main St, Springfield", "2 Oak Ave, Shelbyville", "3 Elm Rd, Ogdenville"], None),
        (["plain", "words", "only"], None),
        ([None, None], None),
    ],
)
def test_delimiters(column, texts, expected):
    assert types.detect_delimiter(column(texts, "string"), "x") == expected


@pytest.mark.parametrize(
    "texts, convertible",
    [
        (["2024-01-05", "2024-02-10", "2024-03-15"], True),
        (["01/05/2024", "02/10/2024"], True),
        (["Jan 5, 2024", "5 Jan 2024", "20240105"], True),
        (["2024-01-05"] * 9 + ["soon"], True),
        (["2024-01-05"] * 8 + ["soon", "later"], False),
        (["10", "20"], False),
        (["12:30", "May"], False),
    ],
)
def test_datetime_detection(column, texts, convertible):
    assert types.datetime_flags(column(texts, "string")).first()["is_datetime_convertible"] is convertible


def test_whole_numbers(column):
    assert types.integer_flags(column([1.0, 2.0, None])).first()["is_int_convertible"] is True
    assert types.integer_flags(column([1.0, 2.5])).first()["is_int_convertible"] is False
    assert types.integer_flags(column([None, None])).first()["is_int_convertible"] is False
    assert types.integer_flags(column([1, 2], "long")).first()["is_int_convertible"] is False


def test_profile_values(column):
    p = profile(column([1.0, 2.0, 2.0, 3.0, None, float("nan"), 10.0])).first()
    assert (p["count"], p["missing_count"], p["missing_percentage"]) == (5, 2, 28.57)
    assert (p["unique_count"], p["cardinality_ratio"]) == (4, 0.5714)
    assert (p["mean"], p["median"], p["mode"], p["q1"], p["q3"]) == (3.6, 2.0, "2.0", 2.0, 3.0)
    assert (p["minimum"], p["maximum"], p["range"]) == (1.0, 10.0, 9.0)
    x = np.array([1.0, 2.0, 2.0, 3.0, 10.0])
    z = (x - x.mean()) / x.std()
    assert p["variance"] == pytest.approx(x.var(ddof=1)) and p["skewness"] == pytest.approx((z**3).mean())
    assert p["kurtosis"] == pytest.approx((z**4).mean() - 3)


def test_profile_edges(column):
    one = profile(column([4.0])).first()
    assert (one["std"], one["skewness"], one["median"]) == (None, None, 4.0)
    none = profile(column([None, None]), {"x": "numerical"}).first()
    assert (none["mean"], none["mode"], none["unique_count"]) == (None, None, 0)
    flat = profile(column([5.0, 5.0, 5.0])).first()
    assert (flat["variance"], flat["skewness"]) == (0.0, None)
    text = profile(column(["b", "a", "b"], "string"), {"x": "numerical"}).first()
    assert (text["mean"], text["mode"]) == (None, "b")


def test_entropy(column):
    assert entropy(column(["a", "a", "b", "b"], "string")).first()["entropy"] == 1.0
    assert entropy(column(["a", "a"], "string")).first()["entropy"] == 0.0
    assert entropy(column([None], "string")).first()["entropy"] is None


def test_distinct_values_of_large_integers(column):
    big = 2**60
    assert distinct_summary(column([big, big + 1, big + 1], "long")).first()["unique_count"] == 2


def test_overview(mixed):
    o = overview(mixed).first()
    assert (o["rows"], o["columns"], o["missing_values_total"], o["duplicate_rows"]) == (300, 10, 300, 0)
    assert o["missing_percentage"] == 10.0 and o["feature_types"]["id"] == 2
    assert o["dtypes"]["vector"] == "array<double>"


def test_text_flags(column):
    def one(fn, texts):
        return fn(column(texts, "string")).first()[1]

    assert one(whitespace_flags, ["a", "b\t"]) is True and one(whitespace_flags, ["a b", None]) is False
    assert one(case_flags, ["Yes", "yes "]) is True and one(case_flags, ["yes", " yes"]) is False
    assert one(case_flags, [None]) is False


def test_variation_flags(column):
    f = variation_flags(column(["k", "k", None], "string")).first()
    assert (f["is_constant"], f["is_low_variance"]) == (True, False)
    f = variation_flags(column([float(i % 2) for i in range(500)])).first()
    assert (f["is_constant"], f["is_low_variance"]) == (False, True)


def test_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, 3.0, "b")], "__row_id long, `a.b` double, `it's` string")
    p = {r["column"]: r for r in profile(df).collect()}
    assert p["a.b"]["mean"] == 2.0 and p["it's"]["unique_count"] == 2
