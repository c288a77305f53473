"""Fills from nearest rows against brute force, with a hot point, ties, and gaps among the features."""

import math
import random

import pytest

from datalathe.operators import neighbours
from datalathe.operators.impute import compare_strategies, fit_impute, impute, preview_imputation
from datalathe.plans.steps import replay
from datalathe.sources.versions import VersionStore

SCHEMA = "__row_id long, x double, t string, a double, b long, c double, r long"


def _rows(n=600, seed=2):
    """A third of the rows share one point; ``c`` is constant, ``r`` is a column named like one of the operator's own."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = (1.5, 7) if i % 3 == 0 else (round(rnd.gauss(0, 5), rnd.choice([0, 3])), rnd.randint(-20, 20))
        x = None if rnd.random() < 0.2 else rnd.choice([float("nan"), 1.25 * i, float(i % 5), 2.0])
        t = None if rnd.random() < 0.2 else rnd.choice("pqrs")
        rows.append((i * 3, x, t, None if rnd.random() < 0.1 else a, None if rnd.random() < 0.1 else b, 4.0, i))
    return rows


def _gap(v):
    return v is None or (isinstance(v, float) and math.isnan(v))


def _brute(rows, target, k, source=None):
    source = source or rows
    scales = []
    for j in (3, 4):
        held = [float(r[j]) for r in source if not _gap(r[j])]
        mean = math.fsum(held) / len(held)
        scales.append((j, mean, math.sqrt(math.fsum((v - mean) ** 2 for v in held) / len(held))))
    at = lambda r: [0.0 if _gap(r[j]) else (r[j] - m) / s for j, m, s in scales]
    donors = [(r[0], r[target], at(r)) for r in source if not _gap(r[target])]
    out = {}
    for r in rows:
        if not _gap(r[target]):
            out[r[0]] = r[target]
            continue
        z = at(r)
        near = sorted((round(sum((p - q) ** 2 for p, q in zip(z, d[2])), 9), d[0], d[1]) for d in donors)[:k]
        values = [v for _, _, v in near]
        out[r[0]] = sum(values) / len(values) if target == 1 else min(values, key=lambda v: (-values.count(v), v))
    return out


def _found(df, column):
    return {r["__row_id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"SAMPLE": 40, "BLOCK": 7, "ASKED": 3, "AROUND": 2}, {"SAMPLE": 2, "PIVOTS": 1}])
def test_fills_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neighbours, name, value)
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    after = impute(df, "x", "knn", features=["a", "b", "c"])
    assert after.columns == df.columns and after.count() == df.count()
    assert _found(after, "x") == pytest.approx(_brute(rows, 1, 5))
    assert _found(impute(df, "t", "knn", features=["a", "b"], neighbours=3), "t") == _brute(rows, 2, 3)


def test_a_fit_fills_other_rows_from_the_rows_it_was_fitted_on(spark):
    rows, others = _rows(200), _rows(80, seed=9)
    fitted = fit_impute(spark.createDataFrame(rows, SCHEMA), "x", "knn", features=["a", "b"])
    assert set(fitted.state["scales"]) == {"a", "b"} and fitted.params["neighbours"] == 5
    assert _found(fitted.apply(spark.createDataFrame(others, SCHEMA)), "x") == pytest.approx(_brute(others, 1, 5, rows))


def test_rows_without_donors_features_or_gaps(spark):
    none = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 2.0)], "__row_id long, x double, a double")
    assert [r["x"] for r in impute(none, "x", "knn").collect()] == [None, None]
    flat = spark.createDataFrame([(1, None, 1.0), (2, 4.0, 1.0), (3, 8.0, 1.0), (4, 9.0, 1.0)], "__row_id long, x double, a double")
    assert _found(impute(flat, "x", "knn", neighbours=2), "x") == {1: 6.0, 2: 4.0, 3: 8.0, 4: 9.0}
    whole = flat.where("x IS NOT NULL")
    assert sorted(impute(whole, "x", "knn").collect()) == sorted(whole.collect())
    assert impute(whole.limit(0), "x", "knn").count() == 0
    for wrong in ({"features": ["x"]}, {"features": []}, {"neighbours": 0}):
        with pytest.raises(ValueError):
            impute(flat, "x", "knn", **wrong)
    with pytest.raises(ValueError):
        impute(flat.select("__row_id", "x"), "x", "knn")


def test_preview_comparison_and_replay(spark, tmp_path):
    rows = _rows(90)
    df = spark.createDataFrame(rows, SCHEMA)
    expected = _brute(rows, 1, 5)
    step = {"version_num": 2, "operation": "impute", "operation_params": {"column": "x", "strategy": "knn", "features": ["a", "b"]}}
    assert _found(replay(df, [step]), "x") == pytest.approx(expected)
    shown = preview_imputation(df.select("__row_id", "x", "a", "b"), "x", "knn", sample=4)
    assert shown["sample_after"] == pytest.approx([expected[i] for i in shown["sample_rows"]]) and shown["after"]["missing_count"] == 0
    compared = compare_strategies(df.select("__row_id", "x", "a", "b"), "x", "knn", "mean")
    assert compared["after_a"]["mean"] == pytest.approx(sum(expected.values()) / len(expected))
    store = VersionStore(spark, str(tmp_path / "store"))
    name = store.add(df, "rows.csv")
    store.apply(name, "impute", step["operation_params"])
    assert _found(store.get(name), "x") == pytest.approx(expected)


def test_a_hot_point_is_not_joined_with_all_rows(spark, monkeypatch):
    """Each question reads few blocks however many donors share its point."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = [(i, None if i % 10 == 0 else float(i), 1.0 if i % 2 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "__row_id long, x double, a double")
    counted, packed = [], neighbours._packed_questions

    def counting(met, size):
        counted.append(met.count())
        return packed(met, size)

    monkeypatch.setattr(neighbours, "_packed_questions", counting)
    filled = impute(df, "x", "knn")
    assert filled.where("x IS NULL").count() == 0
    assert counted[0] <= 400 * 12
