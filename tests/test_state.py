import glob
import math
import random
import statistics
from collections import Counter

import pytest

from datalathe.operators.state import column_counts, merged, profile_of
from datalathe.session import fresh_path
from datalathe.sources.versions import VersionStore

SCHEMA = "__row_id long, x double, `odd name` string, k long"


def made(n, seed, start=0):
    rng = random.Random(seed)
    # A third of the values is one value; gaps, NaN and empty texts are there as well.
    x = lambda: rng.choice([7.0, None, float("nan"), rng.random() * 10, rng.randrange(5) * 1.0, -0.0])
    return [(start + i, x(), rng.choice(["", "a", "b", None]), rng.choice([5, 5, rng.randrange(100)])) for i in range(n)]


def brute(rows):
    out = {}
    for k, c in ((1, "x"), (2, "odd name"), (3, "k")):
        v = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        counts = Counter(v)
        mode = min(counts, key=lambda u: (-counts[u], u)) if v else None
        out[c] = {"rows": len(rows), "missing_count": len(rows) - len(v), "unique_count": len(counts), "mode": mode}
        if k != 2 and len(v) > 2:
            q = statistics.quantiles(v, n=4, method="inclusive")
            m = statistics.fmean(v)
            s2 = sum((u - m) ** 2 for u in v)
            out[c] |= {"mean": m, "std": math.sqrt(s2 / (len(v) - 1)), "q1": q[0], "median": q[1], "q3": q[2], "maximum": max(v)}
            out[c]["skewness"] = math.sqrt(len(v)) * sum((u - m) ** 3 for u in v) / s2**1.5
    return out


def check(df, rows):
    found = {r["column"]: r.asDict() for r in df.collect()}
    for c, expected in brute(rows).items():
        for name, value in expected.items():
            got = found[c][name]
            if name == "mode" and value is not None and c != "odd name":
                got = float(got)
            assert got == (pytest.approx(value) if isinstance(value, float) else value), (c, name)


def test_profile_of_appended_parts_equals_the_whole(spark):
    rows = made(300, 1)
    parts = [rows[:150], rows[150:220], rows[220:]]
    store = VersionStore(spark, fresh_path(spark, "store"))
    d = store.add(spark.createDataFrame(parts[0], SCHEMA), "t.csv")
    check(store.profile(d), parts[0])
    old = glob.glob(store._state(d)["versions"][1]["path"].removeprefix("file:") + "/*.parquet")
    kept = {f: open(f, "rb").read() for f in old}
    for f in old:  # unreadable from here on: neither append nor profile may look at them
        with open(f, "wb") as file:
            file.write(b"broken")
    store.append(d, spark.createDataFrame(parts[1], SCHEMA))
    check(store.profile(d), parts[0] + parts[1])
    store.append(d, spark.createDataFrame(parts[2], SCHEMA).drop("__row_id"))
    check(store.profile(d), rows)
    check(store.profile(d, 2), parts[0] + parts[1])
    for f, content in kept.items():
        with open(f, "wb") as file:
            file.write(content)
    whole = store.get(d)
    assert sorted(r[0] for r in whole.select("__row_id").collect()) == list(range(300))
    check(profile_of(column_counts(whole, ["x", "odd name", "k"]), ["x", "odd name", "k"], 300), rows)
    # Undone and changed versions have states of their own; nothing that is named is pruned.
    store.undo(d)
    check(store.profile(d), parts[0] + parts[1])
    store.apply(d, "drop_column", {"column": "k"})
    assert store.prune(d) >= 1 and store.get(d).count() == 220
    assert [r["column"] for r in store.profile(d).orderBy("column").collect()] == ["odd name", "x"]
    store.restore(d, 2)
    check(store.profile(d), parts[0] + parts[1])


def test_awkward_parts(spark):
    store = VersionStore(spark, fresh_path(spark, "store"))
    empty = spark.createDataFrame([], SCHEMA)
    d = store.add(empty, "t.csv")
    first = store.profile(d).collect()
    assert {(r["rows"], r["unique_count"], r["mode"], r["mean"]) for r in first} == {(0, 0, None, None)}
    rows = [(0, None, None, 1), (1, None, None, 1)]
    store.append(d, spark.createDataFrame(rows, SCHEMA))
    store.append(d, empty)
    found = {r["column"]: r for r in store.profile(d).collect()}
    assert found["x"]["missing_count"] == 2 and found["k"]["median"] == 1.0
    # One value only: a spread of zero, and no shape.
    assert found["k"]["std"] == 0.0 and found["k"]["skewness"] is None
    with pytest.raises(ValueError):
        store.append(d, empty.drop("k"))
    with pytest.raises(ValueError):
        store.profile(d, 9)
    # Repeated parts count twice.
    counts = column_counts(spark.createDataFrame(rows, SCHEMA), ["k"])
    assert merged([counts, counts]).first()["cnt"] == 4
