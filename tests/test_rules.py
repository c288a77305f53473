import json

import pytest

from datalathe.plans.reports import inspect_column
from datalathe.rules.catalog import BUILT_IN
from datalathe.rules.engine import health_score, read_rules, recommendations, rules_frame, usable_rules
from datalathe.rules.facts import column_facts, dataset_facts


@pytest.fixture(scope="module")
def data(spark):
    rows = [
        (i, i + 1000, None if i % 4 == 0 else float((i % 50) ** 2), float(i % 6), "k", "Yes" if i % 2 else "yes ", f"2024-01-{1 + i % 28:02d}")
        for i in range(600)
    ]
    rows += [(600 + i, *rows[i][1:]) for i in range(30)]
    return spark.createDataFrame(rows, "__row_id long, number long, amount double, wheel double, const string, answer string, day string")


def ids(df, **kw):
    return {(r["column"], r["rule_id"]) for r in recommendations(df, **kw).collect()}


def test_recommendations(data):
    got = ids(data)
    assert ("amount", "missing_moderate_numerical") in got and ("const", "constant_column") in got
    assert {("answer", "whitespace_issues"), ("answer", "case_inconsistency"), ("answer", "encoding_low_cardinality")} <= got
    assert {("wheel", "float_to_int"), ("wheel", "fe_cyclic_encoding"), ("wheel", "not_normally_distributed")} <= got
    assert ("day", "object_to_datetime_categorical") in got
    assert ("(entire dataset)", "duplicate_rows_present") in got
    assert not any(rule.startswith("missing") for column, rule in got if column == "answer")


def test_override_changes_the_rules_that_apply(data):
    got = {rule for column, rule in ids(data, overrides={"answer": "text"}) if column == "answer"}
    assert {"whitespace_issues_text", "fe_text_length"} <= got and "encoding_low_cardinality" not in got
    # A text column called numerical has no statistics; they count as 0.
    got = {rule for column, rule in ids(data, overrides={"answer": "numerical"}) if column == "answer"}
    assert {"not_normally_distributed", "scaling_normal_no_outliers"} <= got


def test_shape_of_constant_is_undefined(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(9)], "__row_id long, x double")
    got = {rule for column, rule in ids(df) if column == "x"}
    assert "not_normally_distributed" not in got and "constant_column" in got
    assert column_facts(df).first()["skewness"] is None


def test_booleans_are_skipped_for_outliers(spark):
    df = spark.createDataFrame([(i, bool(i % 2), i % 3) for i in range(9)], "__row_id long, b boolean, n long")
    assert {r["column"]: r["outlier_pct"] for r in column_facts(df).collect()} == {"b": 0.0, "n": 0.0}


def test_dataset_facts(spark):
    df = spark.createDataFrame([(i, i, i, -i, i % 2) for i in range(8)], "__row_id long, a long, b long, c long, d long")
    f = dataset_facts(df).first()
    assert (f["duplicate_row_count"], f["duplicate_column_count"], f["high_correlation_pair_count"]) == (0, 1, 3)


def test_health(data):
    h = health_score(data)
    assert 0 <= h["score"] < 100 and {b["factor"] for b in h["breakdown"]} == {"Missing data", "Duplicate rows", "Active recommendations"}
    assert h["score"] == pytest.approx(100 - sum(b["penalty"] for b in h["breakdown"]), abs=0.15)


def test_catalog_is_complete_and_resolves(spark):
    assert len(BUILT_IN) == len({r["id"] for r in BUILT_IN}) == 42
    assert rules_frame(spark).count() == 42
    assert sum(r["learning_content"] is not None for r in BUILT_IN) == 3


def test_custom_rules(spark, data, tmp_path):
    own = [
        {"id": "big", "category": "x", "severity": "low", "applies_to": "any", "condition": "unique_count > 500", "recommendation": "r", "reason": "w"},
        {"id": "bad", "category": "x", "severity": "low", "applies_to": "any", "condition": "no_such_fact > 1", "recommendation": "r", "reason": "w"},
        {"id": "odd", "category": "x", "severity": "low", "applies_to": "any", "condition": "unique_count >", "recommendation": "r", "reason": "w"},
    ]
    (tmp_path / "rules.json").write_text(json.dumps(own))
    (tmp_path / "more.yaml").write_text("- {id: again, category: x, severity: high, applies_to: dataset, condition: duplicate_row_count > 0, recommendation: r, reason: w}\n")
    rules = read_rules(str(tmp_path))
    assert [r["id"] for r in usable_rules(spark, rules)] == ["again", "big"]
    assert ids(data, rules=rules) == {("number", "big"), ("(entire dataset)", "again")}


def test_repeated_id_lends_its_learning_content(spark):
    base = dict(BUILT_IN[0], id="twice", learning_content=None)
    extra = dict(base, learning_content={"concept": "c", "why_it_matters": "w"})
    assert [r["learning_content"]["concept"] for r in usable_rules(spark, [base, extra])] == ["c"]


def test_inspector(data):
    r = inspect_column(data, "amount")
    assert r["effective_type"] == "numerical" and r["profile"]["missing_count"] == 158
    assert r["outlier_summary"]["outlier_percentage"] >= 0 and len(r["top_correlated_columns"]) == 2
    assert r["possible_transformations"]
    assert {t["operation"] for t in inspect_column(data, "const")["possible_transformations"]} == {"encode"}
    with pytest.raises(KeyError):
        inspect_column(data, "nope")
