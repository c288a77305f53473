import math

import numpy as np
import pandas as pd
import pytest

from datalathe.operators import association as A


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    n = 800
    a = rng.normal(size=n)
    f = pd.DataFrame(
        {
            "a": a,
            "b": np.round(a + rng.normal(size=n), 1),
            "c": rng.integers(0, 5, n).astype(float),
            "hot": np.where(rng.random(n) < 0.5, 1.0, np.round(rng.normal(size=n), 2)),
        }
    )
    f.loc[rng.random(n) < 0.2, "b"] = np.nan
    f.loc[rng.random(n) < 0.1, "c"] = np.nan
    return f


@pytest.fixture(scope="module")
def frame(spark, numbers):
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in numbers.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, hot double").repartition(6)


def tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())


def raw(df, fn, **kw):
    cols = ["a", "b", "c", "hot"]
    return {(r[0], r[1]): r[2] for r in fn(df, cols, **kw).collect()}


def complete(numbers, a, b):
    both = numbers[[a, b]].dropna()
    return both[a].to_numpy(), both[b].to_numpy()


def test_pearson(frame, numbers):
    got = raw(frame, A.pearson)
    for (a, b), r in got.items():
        x, y = complete(numbers, a, b)
        assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


@pytest.mark.parametrize("leaf", [1_000_000, 10])
def test_spearman(frame, numbers, leaf, monkeypatch):
    monkeypatch.setattr(A, "LEAF_POINTS", leaf)
    got = raw(frame, A.spearman)
    for (a, b), r in got.items():
        x, y = (pd.Series(v).rank().to_numpy() for v in complete(numbers, a, b))
        assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


@pytest.mark.parametrize("leaf, blocks", [(1_000_000, 400), (150, 4)])
def test_kendall(frame, numbers, leaf, blocks):
    got = raw(frame, A.kendall, leaf=leaf, blocks=blocks)
    for (a, b), r in got.items():
        assert r == pytest.approx(tau_b(*complete(numbers, a, b)), abs=1e-12)


def test_discordant_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60):
        x, y, w = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 5, n)
        expected = sum(
            w[i] * w[j] for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j]
        )
        assert A.discordant(x, y, w) == expected


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2), (2.0, 5.0, 4), (3.0, 5.0, 6)], "x double, flat double, y int")
    for method in A.METHODS:
        got = {(r[0], r[1]): r[2] for r in A.correlations(df, method, row_id=None).collect()}
        assert got == {("x", "flat"): None, ("x", "y"): 1.0, ("flat", "y"): None}
    assert A.correlations(df.select("x"), row_id=None).count() == 0
    assert A.correlation_matrix(df.select("x"), row_id=None)["matrix"] == []
    m = A.correlation_matrix(df, row_id=None)["matrix"]
    assert m == [[1.0, None, 1.0], [None, None, None], [1.0, None, 1.0]]
    with pytest.raises(ValueError):
        A.correlations(df, "distance")


def test_high_and_top(spark):
    df = spark.createDataFrame([(float(i), float(-i), float(i % 3)) for i in range(20)], "x double, y double, z double")
    assert [tuple(r) for r in A.high_pairs(df, row_id=None).collect()] == [("x", "y", -1.0)]
    top = A.top_correlated(df, "x", row_id=None).collect()
    assert [r["column"] for r in top] == ["y", "z"]


def cramer(x, y):
    t = pd.crosstab(pd.Series(x), pd.Series(y)).to_numpy(dtype=float)
    n, (r, k) = t.sum(), t.shape
    e = np.outer(t.sum(1), t.sum(0)) / n
    d = np.abs(t - e)
    if r == 2 and k == 2:
        d = d - np.minimum(0.5, d)
    phi2 = max(0, (d**2 / e).sum() / n - (k - 1) * (r - 1) / (n - 1))
    den = min(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1
    return 0.0 if den <= 0 else math.sqrt(phi2 / den)


def test_cramers_v(spark):
    rng = np.random.default_rng(9)
    n = 300
    a = rng.choice(list("pqr"), n)
    b = np.where(rng.random(n) < 0.6, a, rng.choice(list("pqrs"), n))
    c, d = rng.choice(["u", "v"], n), None
    d = np.where(rng.random(n) < 0.8, c, "u")
    df = spark.createDataFrame(
        [tuple(map(str, t)) + ("same",) for t in zip(a, b, c, d)], "a string, b string, c string, d string, e string"
    )
    got = {(r[0], r[1]): r[2] for r in A.cramers_v(df, ["a", "b", "c", "d", "e"]).collect()}
    data = dict(a=a, b=b, c=c, d=d, e=np.array(["same"] * n))
    for (p, q), v in got.items():
        assert v == pytest.approx(cramer(data[p], data[q]), abs=1e-9), (p, q)
    m = A.categorical_matrix(df, ["a", "b"])["matrix"]
    assert m[0][0] == 1.0 and m[0][1] == m[1][0] == round(got["a", "b"], 3)


@pytest.mark.parametrize("gaps", [False, True])
def test_two_hundred_columns_are_one_scan(spark, tmp_path, monkeypatch, gaps):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 200)) + rng.normal(size=(60, 1))
    if gaps:
        data[rng.random(data.shape) < 0.1] = np.nan
    data[:, 7] = 3.0
    names = [f"c{i:03d}" for i in range(200)]
    spark.createDataFrame(pd.DataFrame(data, columns=names)).write.parquet(str(tmp_path / "wide"))
    scans, collect = [], type(spark.range(1)).collect
    plans = lambda d: scans.append(d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")) or collect(d)
    monkeypatch.setattr(type(spark.range(1)), "collect", plans)
    monkeypatch.setattr(A, "_about_own_means", lambda *a: pytest.fail("a well centred pair was summed again"))
    found = A.pearson(spark.read.parquet(str(tmp_path / "wide")), names)
    assert sum(scans) == 1
    expected = pd.DataFrame(data, columns=names).corr()
    got = {(r[0], r[1]): r[2] for r in found.collect()}
    assert len(got) == 19_900
    for (a, b), r in got.items():
        e = expected.loc[a, b]
        assert (r is None) if np.isnan(e) else r == pytest.approx(e, abs=1e-9)


@pytest.mark.parametrize("width", [4, 14])
def test_a_side_close_together_far_from_its_mean(spark, width):
    """One rule at every width: equal ends over the pair's own rows make a side constant, nothing else does."""
    rng = np.random.default_rng(6)
    n = 500
    here = np.arange(n) % 5 == 0
    data = {
        "near": np.where(here, 1e6 + 1e-6 * rng.integers(0, 9, n), 3e7 * rng.normal(size=n)), "gappy": np.where(here, rng.normal(size=n), np.nan),
        "flat": np.where(here, 3.0, rng.normal(size=n)), "other": rng.normal(size=n),
    }
    data |= {f"c{i}": rng.normal(size=n) for i in range(width - 4)}
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(3)
    got = {(r[0], r[1]): r[2] for r in A.pearson(df, list(data)).collect()}
    assert got["gappy", "flat"] is None
    assert got["near", "gappy"] == pytest.approx(np.corrcoef(data["near"][here] - 1e6, data["gappy"][here])[0, 1], abs=1e-6)
    assert got["gappy", "other"] == pytest.approx(np.corrcoef(data["gappy"][here], data["other"][here])[0, 1], abs=1e-9)
    assert got["flat", "other"] == pytest.approx(np.corrcoef(data["flat"], data["other"])[0, 1], abs=1e-9)


@pytest.mark.parametrize("points", [1_000_000, 50])
def test_spearman_of_forty_columns_joins_ranks_once(spark, monkeypatch, points):
    monkeypatch.setattr(A, "LEAF_POINTS", points)
    rng = np.random.default_rng(2)
    data = np.round(rng.normal(size=(120, 40)) + rng.normal(size=(120, 1)), 1)
    data[:, 3] = -0.0
    data[::2, 3] = 1.0
    names = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame(data, columns=names)).repartition(3)
    values = df.select(*[df[c].alias(f"v{i}") for i, c in enumerate(names)])
    plan = A._ranked(values, points > 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == (0 if points > 50 else 1)
    got = {(r[0], r[1]): r[2] for r in A.spearman(df, names).collect()}
    expected = pd.DataFrame(data, columns=names).rank().corr()
    assert len(got) == 780
    for (a, b), r in got.items():
        assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_points_of_a_large_group_are_written_twice_at_most_and_counted_exactly(spark, monkeypatch):
    rng = np.random.default_rng(12)
    n = 3000
    x, y = rng.integers(0, 900, n).astype(float), np.round(rng.normal(size=n), 2)
    x[:700], y[500:900] = 5.0, 0.5  # hot values
    points = {}
    for a, b in zip(x.tolist(), y.tolist()):
        points[a, b] = points.get((a, b), 0) + 1
    rows = [(0, a, b, w) for (a, b), w in points.items()] + [(1, float(i), float(-i), 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "pair int, x double, y double, w long").repartition(3)
    written, cut = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda d: (written.append((out := cut(d)).count()), out)[1])
    found = {r["pair"]: r["d"] for r in A.discordant_pairs(frame, leaf=400, blocks=3).collect()}
    px, py, w = (np.array(v) for v in zip(*[r[1:] for r in rows if r[0] == 0]))
    assert found == {0: A.discordant(px, py, w), 1: 4.0 * 40 * 39 / 2}
    assert len(written) > 2 and max(written[:2]) <= 2 * len(points)
