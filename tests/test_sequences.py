"""As-of joins, rolling statistics and profiles per group against brute force, with hot keys and rows cut into many ranges."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from datalathe.operators.asof import asof_join, elapsed_since
from datalathe.operators.grouped import grouped_profile
from datalathe.operators.rolling import rolling


def _tables(spark, seed=3, n=400):
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.05 else ("hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}")
    time = lambda: None if rng.random() < 0.05 else float("nan") if rng.random() < 0.03 else float(rng.randrange(120))
    left = [(i, key(), time()) for i in range(n)]
    right = [(key(), time(), None if rng.random() < 0.1 else rng.randrange(50)) for _ in range(n // 3)]
    return left, right


def _brute(left, right, forward):
    out = {}
    order = lambda v: -1 if v is None else v  # noqa: E731  (NULL is the least)
    for i, k, t in left:
        met = [] if t is None or math.isnan(t) or k is None else [
            (s, v) for j, s, v in right if j == k and s is not None and not math.isnan(s) and (s >= t if forward else s <= t)
        ]
        best = (min if forward else max)(met, key=lambda m: (m[0], order(m[1])), default=(None, None))
        out[i] = best
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("parts", [1, 4, 23])
def test_asof_equals_brute_force(spark, direction, parts):
    left, right = _tables(spark)
    l = spark.createDataFrame(left, "id long, k string, t double")
    r = spark.createDataFrame(right, "k string, t double, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so the hot key is cut by many borders
    try:
        found = asof_join(l, r, ["k"], "t", ["t", "v"], "_r", direction).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(found) == len(left)
    assert {x["id"]: (x["t_r"], x["v_r"]) for x in found} == _brute(left, right, direction == "forward")


def test_asof_awkward_tables(spark):
    l = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, None, None)], "id long, `k.x` string, t long")
    none = l.limit(0)
    assert asof_join(none, l, ["k.x"], "t", ["id"]).collect() == []
    assert [r["id_asof"] for r in asof_join(l, none, ["k.x"], "t", ["id"]).collect()] == [None] * 3
    # Rows that repeat stay, key types may differ in width, and several keys work together.
    r = spark.createDataFrame([("a", 1, 7), ("a", 1, 9)], "`k.x` string, t int, v int")
    assert sorted(x["v_asof"] or 0 for x in asof_join(l, r, ["k.x", "t"], "t", ["v"]).collect()) == [0, 9, 9]
    with pytest.raises(ValueError, match="exist"):
        asof_join(l.withColumn("v_asof", F.lit(1)), r, ["k.x"], "t", ["v"])
    with pytest.raises(ValueError, match="direction"):
        asof_join(l, r, ["k.x"], "t", ["v"], direction="both")
    with pytest.raises(KeyError):
        asof_join(l, r, ["nothing"], "t", ["v"])


def test_elapsed_since(spark):
    l = spark.createDataFrame([(1, "a", "2024-01-03"), (2, "a", "2024-01-01"), (3, "b", "2024-01-09")], "id long, k string, d string")
    l = l.withColumn("d", F.to_date("d"))
    found = elapsed_since(l, l.where("id = 2"), ["k"], "d", "gone", "hours")
    assert {r["id"]: r["gone"] for r in found.collect()} == {1: 48.0, 2: 0.0, 3: None}
    with pytest.raises(ValueError, match="unit"):
        elapsed_since(l, l, ["k"], "d", "gone", "weeks")


@pytest.mark.parametrize("rows, width", [(1, 4), (2, 3), (3, 5), (7, 7), (10, 4), (64, 16)])
@pytest.mark.parametrize("gaps", [False, True])
def test_rolling_equals_brute_force(spark, rows, width, gaps):
    rng = random.Random(rows * 31 + gaps)
    values = [rng.choice([None, float("nan"), rng.randrange(100) / 4.0, rng.randrange(100) / 4.0]) for _ in range(83)]
    ids = sorted(rng.sample(range(10_000), 83)) if gaps else list(range(5, 88))
    df = spark.createDataFrame(list(zip(ids, values)), "__row_id long, x double").repartition(5)
    made = rolling(df, "x", rows, ("mean", "sum", "min", "max", "count"), least=2, width=width)
    found = {r["__row_id"]: r for r in made.collect()}
    assert sorted(found) == ids
    for i, at in enumerate(ids):
        window = [v for v in values[max(0, i - rows + 1) : i + 1] if v is not None and not math.isnan(v)]
        r = found[at]
        assert r["x_rolling_count"] == len(window)
        if len(window) < 2:
            assert [r[f"x_rolling_{s}"] for s in ("mean", "sum", "min", "max")] == [None] * 4
        else:
            assert (r["x_rolling_sum"], r["x_rolling_min"], r["x_rolling_max"]) == (sum(window), min(window), max(window))
            assert r["x_rolling_mean"] == pytest.approx(sum(window) / len(window))


def test_rolling_plan_and_errors(spark):
    df = spark.range(40).selectExpr("id AS __row_id", "id AS x")
    plan = rolling(df, "x", 3)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__bucket" in line for line in windows)  # no window over all rows
    assert rolling(df.limit(0), "x", 3).collect() == []
    assert rolling(df, "x", 3, ("min",)).schema["x_rolling_min"].dataType.typeName() == "long"
    for bad in ({"rows": 0}, {"rows": 2, "statistics": ("median",)}, {"rows": 2, "least": 0}):
        with pytest.raises(ValueError):
            rolling(df, "x", **bad)
    with pytest.raises(ValueError, match="exist"):
        rolling(df.withColumn("x_rolling_min", F.lit(1)), "x", 3, ("min",))


def _quantile(values, q):
    values, place = sorted(values), (len(values) - 1) * q
    a, b = values[math.floor(place)], values[math.ceil(place)]
    return a + (b - a) * (place - math.floor(place))


def test_grouped_profile_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (i, "lone" if i == 0 else rng.choice(["half"] * 6 + [None, "a", "b", "c"]), rng.choice([None, float("nan"), rng.randrange(40) / 2, -0.0, 0.0]),
         rng.choice([None, "x", "y", "Z"]), rng.choice([None, 2**53, 2**53 + 1]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "__row_id long, k string, v double, t string, big long")
    found = {(r["k"], r["column"]): r for r in grouped_profile(df, ["k"]).collect()}
    keys = {r[1] for r in rows}
    assert set(found) == {(k, c) for k in keys for c in ("v", "t", "big")}
    for k in keys:
        mine = [r for r in rows if r[1] == k]
        for at, c in ((2, "v"), (3, "t"), (4, "big")):
            have = [r[at] for r in mine if r[at] is not None and r[at] == r[at]]
            r = found[k, c]
            assert (r["rows"], r["missing_count"], r["unique_count"]) == (len(mine), len(mine) - len(have), len(set(have)))
            if not have:
                assert r["mode"] is None and r["median"] is None
                continue
            mode = min(set(have), key=lambda v: (-have.count(v), v))
            assert {"t": str, "v": float, "big": int}[c](r["mode"]) == mode
            if c == "t":
                assert r["mean"] is None and r["q1"] is None
                continue
            assert [r["q1"], r["median"], r["q3"]] == pytest.approx([_quantile(have, q) for q in (0.25, 0.5, 0.75)])
            assert [r["mean"], r["minimum"], r["maximum"]] == pytest.approx([sum(have) / len(have), min(have), max(have)])
            assert r["std"] == (pytest.approx(statistics.stdev(map(float, have))) if len(have) > 1 else None)


def test_grouped_profile_awkward(spark):
    df = spark.createDataFrame([(1, None, 1.5), (1, None, None), (2, "b", None)], "`a.b` long, c string, v double")
    found = {(r["a.b"], r["c"]): r for r in grouped_profile(df, ["a.b", "c"], row_id=None).collect()}
    assert (found[1, None]["rows"], found[1, None]["median"], found[2, "b"]["unique_count"]) == (2, 1.5, 0)
    assert grouped_profile(df.limit(0), ["c"], ["v"]).collect() == []
    with pytest.raises(ValueError):
        grouped_profile(df, [], ["v"])
    with pytest.raises(ValueError, match="may not"):
        grouped_profile(df.withColumnRenamed("c", "rows"), ["rows"], ["v"])
