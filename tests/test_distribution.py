import hashlib
import math

import numpy as np
import pytest

from datalathe.operators import distribution as D
from datalathe.operators import transforms as T


def test_histogram_equals_numpy(column):
    rng = np.random.default_rng(11)
    for data in (rng.normal(size=500), np.round(rng.random(400), 1), np.array([7.0, 7.0]), np.arange(31.0)):
        counts, edges = np.histogram(data, bins=30)
        got = D.histogram(column([float(v) for v in data] + [None]), "x").orderBy("bin").collect()
        assert [r["count"] for r in got] == list(counts)
        assert [r["lower_edge"] for r in got] == pytest.approx(list(np.round(edges[:-1], 4)))


def test_histogram_without_values(column):
    got = D.histogram(column([None]), "x").orderBy("bin").collect()
    assert sum(r["count"] for r in got) == 0 and got[0]["lower_edge"] == 0.0 and got[-1]["upper_edge"] == 1.0


def test_boxplot_and_scatter(spark, column):
    b = D.boxplot(column([3.0, 1.0, None, 2.0]), "x")
    assert (b["q1"], b["median"], b["q3"], b["minimum"], b["maximum"], b["values"]) == (1.5, 2.0, 2.5, 1.0, 3.0, [3.0, 1.0, 2.0])
    df = spark.createDataFrame([(i, float(i), None if i % 2 else float(-i)) for i in range(40)], "__row_id long, x double, y double")
    a = sorted(r["row_id"] for r in D.scatter(df, "x", "y", n=8).collect())
    again = sorted(r["row_id"] for r in D.scatter(df.repartition(7), "x", "y", n=8).collect())
    assert a == again and len(a) == 8 and all(i % 2 == 0 for i in a)


def test_shapiro_against_published_example():
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # example of the 1965 paper
    w, p = D.shapiro_wilk(np.array(weights))
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.0067, abs=2e-4)


def test_shapiro_separates_shapes():
    rng = np.random.default_rng(1)
    w, p = D.shapiro_wilk(rng.normal(size=2000))
    assert w > 0.99 and p > 0.01
    w, p = D.shapiro_wilk(rng.exponential(size=2000))
    assert w < 0.9 and p < 1e-10
    for n in (3, 4, 5, 6, 11, 12):
        w, p = D.shapiro_wilk(rng.normal(size=n))
        assert 0 < w <= 1 and 0 <= p <= 1


def test_normality(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), 1.0 if i < 2 else None) for i, (a, b) in enumerate(zip(rng.normal(size=900), rng.exponential(size=900)))]
    df = spark.createDataFrame(rows, "__row_id long, n double, e double, few double")
    got = {r["column"]: r for r in D.normality(df, ["n", "e", "few"]).collect()}
    assert got["n"]["is_normal"] and not got["e"]["is_normal"]
    assert (got["few"]["statistic"], got["few"]["sample_size"]) == (None, 2)
    assert D.distribution(df, "n")["normality_test"]["is_normal"]
    jb = {r["column"]: r for r in D.jarque_bera(df, ["n", "e"]).collect()}
    assert jb["n"]["p_value"] > 0.01 and jb["e"]["p_value"] < 1e-6


def test_normality_takes_the_first_rows_in_hash_order_without_sorting_all(spark, capsys):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), None if i % 3 else float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=700), rng.exponential(size=700)))]
    df = spark.createDataFrame(rows, "__row_id long, n double, e double").repartition(5)
    order = sorted(rows, key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
    tested = D.normality(df, ["n", "e"], rows=60)
    got = {r["column"]: (r["sample_size"], r["statistic"]) for r in tested.collect()}
    for k, c in ((1, "n"), (2, "e")):
        first = [r[k] for r in order if r[k] is not None][:60]
        assert got[c] == (60, pytest.approx(D.shapiro_wilk(np.array(first))[0], rel=1e-12))
    capsys.readouterr()
    tested.explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def likelihood(kind, x, p):
    if kind == "box_cox":
        y, slope = (np.log(x) if p == 0 else (x**p - 1) / p), np.log(x).sum()
    else:
        y = np.where(x >= 0, ((np.abs(x) + 1) ** p - 1) / p, -((np.abs(x) + 1) ** (2 - p) - 1) / (2 - p))
        slope = (np.sign(x) * np.log1p(np.abs(x))).sum()
    return (p - 1) * slope - len(x) / 2 * math.log(y.var())


def golden(fn, lo, hi):
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    for _ in range(80):
        if fn(a) > fn(b):
            hi, b = b, a
            a = hi - g * (hi - lo)
        else:
            lo, a = a, b
            b = lo + g * (hi - lo)
    return (lo + hi) / 2


@pytest.mark.parametrize("kind", ["box_cox", "yeo_johnson"])
def test_powers_maximise_the_likelihood(column, kind):
    rng = np.random.default_rng(4)
    sets = [rng.exponential(20, 700) + 0.01, rng.normal(50, 4, 700), rng.lognormal(3, 0.4, 500)]
    if kind == "yeo_johnson":
        sets = [rng.exponential(20, 700) - 5, -rng.exponential(3, 600)]
    for x in sets:
        fitted = T.fit_transform(column([float(v) for v in x] + [None]), "x", kind)
        best = golden(lambda p: likelihood(kind, x, p), -6, 8)
        assert fitted.state["power"] == pytest.approx(best, abs=2e-6)


def test_transforms(column, values):
    df = column([1.0, math.e, None])
    assert values(T.apply_transform(df, "x", "log")) == pytest.approx([0.0, 1.0, None])
    assert values(T.apply_transform(column([0.0, 4.0]), "x", "sqrt")) == [0.0, 2.0]
    assert values(T.apply_transform(df, "x", "none")) == [1.0, math.e, None]
    out = values(T.apply_transform(column([1.0, 2.0, 9.0, None]), "x", "yeo_johnson"))
    assert out[3] is None and out[0] < out[1] < out[2]
    for bad, transform in (([0.0, 1.0], "log"), ([-1.0], "sqrt"), ([0.0, 2.0], "box_cox"), ([3.0, 3.0], "box_cox"), ([1.0], "cube")):
        with pytest.raises(ValueError):
            T.apply_transform(column(bad), "x", transform)
    p = T.preview_transform(column([1.0, 2.0, 4.0, 30.0]), "x", "log")
    assert p["after_skewness"] < p["before_skewness"] and sum(p["after_histogram"]["counts"]) == 4
