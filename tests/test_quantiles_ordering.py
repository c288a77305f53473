import numpy as np
import pytest
from pyspark.sql import functions as F

from datalathe.functions import quantiles
from datalathe.functions.ordering import running_total
from datalathe.functions.quantiles import exact_quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize("budget", [1_000_000, 40])
def test_quantiles_equal_numpy(spark, budget):
    rng = np.random.default_rng(7)
    skewed = np.round(rng.exponential(20, 60_000), 2)
    hot = np.where(rng.random(60_000) < 0.4, 17.25, rng.normal(17, 5, 60_000))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(skewed, hot)], "a double, b double").repartition(7)
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, PROBS, budget)
    assert got["a"] == list(np.quantile(skewed, PROBS))
    assert got["b"] == list(np.quantile(hot, PROBS))


@pytest.mark.parametrize("budget", [1_000_000, 60, 0])
def test_quantiles_of_many_columns_equal_numpy(spark, budget):
    rng = np.random.default_rng(3)
    n = 3000
    kinds = [
        rng.normal(0, 1e-9, n), rng.exponential(3, n), np.round(rng.normal(0, 4, n)), np.where(rng.random(n) < 0.4, 7.5, rng.normal(7, 1, n)),
        10.0 ** rng.uniform(-300, 300, n), -(10.0 ** rng.uniform(-300, 300, n)), np.full(n, -2.25), 1e15 + rng.integers(0, 3, n),
        np.where(rng.random(n) < 0.3, -np.inf, np.where(rng.random(n) < 0.2, np.inf, rng.normal(size=n))), np.zeros(n), rng.integers(-3, 3, n) * (1e308 / 3),
        np.concatenate([np.full(n - 1, 5e-324), [1.7e308]]),
    ]
    data = np.column_stack([*kinds, *[rng.permutation(k) for k in kinds]])
    names = [f"c{i}" for i in range(data.shape[1])]
    rows = [tuple(None if (i + j) % 50 == 0 else float("nan") if (i + j) % 71 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    df = df.withColumn("none", F.lit(None).cast("double")).withColumn("big", F.when(~F.isnan("c2"), F.lit(2**60) + F.col("c2").cast("long")))
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, probs, budget)
    for j, c in enumerate(names):
        held = [r[j] for r in rows if r[j] is not None and not np.isnan(r[j])]
        with np.errstate(invalid="ignore"):
            expected = [sorted(held)[int(p * (len(held) - 1))] if np.isinf(held).any() else np.quantile(held, p) for p in probs]
        if np.isinf(held).any():
            assert [got[c][0], got[c][4]] == [expected[0], expected[4]]
        else:
            assert got[c] == expected, c
    assert got["none"] == [None] * 5
    assert got["big"][0] == float(2**60 + int(min(r[2] for r in rows if r[2] is not None and r[2] == r[2])))


def test_the_plan_of_many_columns_does_not_grow_with_them(spark, monkeypatch):
    rounds = []
    real = quantiles._digit_round
    monkeypatch.setattr(quantiles, "_digit_round", lambda *a: rounds.append(1) or real(*a))
    sizes = []
    for k in (20, 60):
        df = spark.range(5000).select(*[((F.col("id") * (i + 3)) % 997).cast("double").alias(f"c{i}") for i in range(k)])
        exact_quantiles(df, {c: F.col(c) for c in df.columns}, (0.25, 0.5, 0.75), budget=0)
        sizes.append(len(rounds))
        rounds.clear()
    # One search for each block of columns, and no more rounds in it.
    assert sizes[0] <= 2 * 3 and sizes[1] <= 4 * 3


def test_quantiles_of_few_values(column):
    for data in ([5.0], [1.0, 2.0], [3.0, 3.0, 3.0], [1.0, None, 9.0, 2.0]):
        present = [v for v in data if v is not None]
        assert exact_quantiles(column(data), {"x": F.col("x")}, (0.25, 0.5, 0.9))["x"] == pytest.approx(
            list(np.quantile(present, (0.25, 0.5, 0.9)))
        )
    assert exact_quantiles(column([None]), {"x": F.col("x")}, (0.5,))["x"] == [None]


@pytest.mark.parametrize("bounded", [True, False])
def test_running_total(spark, bounded):
    rows = [(g, float(v), v % 5 + 1) for g in (0, 1, 2) for v in range(200)]
    df = spark.createDataFrame(rows, "g int, v double, w long").repartition(5)
    got = {(r["g"], r["v"]): r["before"] for r in running_total(df, "g", "v", "w", bounded).collect()}
    for g, v, _ in rows:
        assert got[g, v] == sum(w for h, u, w in rows if h == g and u < v)
