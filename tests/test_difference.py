import json
import random
from collections import Counter

import pytest

from datalathe.operators.difference import difference
from datalathe.session import fresh_path
from datalathe.sources import versions
from datalathe.sources.versions import VersionStore

SCHEMA = "__row_id long, a double, b string"


def brute(before, after):
    out = []
    for i in {r[0] for r in before + after}:
        old, new = (Counter(r for r in side if r[0] == i) for side in (before, after))
        gone, come = list((old - new).elements()), list((new - old).elements())
        if len(gone) == len(come) == 1 and i is not None:
            out += [("changed", i, c, gone[0][k], come[0][k], 1) for k, c in ((1, "a"), (2, "b")) if gone[0][k] != come[0][k]]
        else:
            out += [(name, i, None, None, None, len(side)) for name, side in (("deleted", gone), ("inserted", come)) if side]
    return sorted(out, key=str)


def found(before, after):
    number = lambda column, v: v if v is None or column != "a" else float(v)
    rows = difference(before, after).collect()
    return sorted(((r[0], r[1], r[2], number(r[2], r[3]), number(r[2], r[4]), r[5]) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_difference_equals_brute_force(spark, seed):
    rng = random.Random(seed)

    def rows():
        # A third of the rows stands under one id, and rows without id are there as well.
        return [
            (rng.choice([None, 7, 7, *range(40)][:3] + list(range(40))), rng.choice([None, 1.0, 2.0]), rng.choice([None, "", "x"]))
            for _ in range(60)
        ] + [(7, 1.0, rng.choice("xy")) for _ in range(30)]

    before, after = rows(), rows()
    a, b = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)
    assert found(a, b) == brute(before, after)
    assert found(a, a) == []
    assert found(a.limit(0), b) == brute([], after) and found(a, b.limit(0)) == brute(before, [])


def test_difference_of_columns(spark):
    a = spark.createDataFrame([(1, 1.0, "x", 5), (2, float("nan"), None, 6)], "__row_id long, a double, b string, k int")
    b = spark.createDataFrame([(1, 1.0, "5", "x"), (2, None, "7", "y")], "__row_id long, a double, k string, `new one` string")
    got = {tuple(r) for r in difference(a, b).collect()}
    assert got == {
        ("column_dropped", None, "b", "string", None, None),
        ("column_added", None, "new one", None, "string", None),
        ("column_retyped", None, "k", "int", "string", None),
        ("changed", 2, "k", "6", "7", 1),
    }
    with pytest.raises(KeyError):
        difference(a, b, "missing")


def test_stored_versions_differ(spark):
    store = VersionStore(spark, fresh_path(spark, "store"))
    d = store.add(spark.createDataFrame([(0, 1.0, "x"), (1, None, "y")], SCHEMA), "t.csv")
    store.apply(d, "impute", {"column": "a", "strategy": "constant", "constant_value": 4})
    assert [tuple(r) for r in store.diff(d, 1, 2).collect()] == [("changed", 1, "a", None, "4.0", 1)]
    assert [r["change"] for r in store.diff(d, 2, 2).collect()] == []


@pytest.fixture
def stored(spark, monkeypatch):
    monkeypatch.setattr(versions, "SNAPSHOT_EVERY", 10)
    store = VersionStore(spark, fresh_path(spark, "store"))
    return store, store.add(spark.createDataFrame([(0, 1.0, "x")], SCHEMA), "t.csv")


def put(store, path, text):
    target, fs = store._fs(path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def test_a_torn_entry_is_no_state(spark, stored):
    store, d = stored
    store.set_override(d, "b", "text")
    put(store, f"{store.root}/{d}/log/0000000002.json", json.dumps({"dataset_id": d, "seq": 2, "action": "override"})[:30])
    put(store, f"{store.root}/{d}/log/.half-written", "{")
    assert store.overrides(d) == {"b": "text"}
    store.set_override(d, "a", "numerical")  # takes the torn entry's place
    assert store.overrides(d) == {"b": "text", "a": "numerical"}


def test_two_writers_from_one_state(spark, stored):
    store, d = stored
    state = store._state(d)
    df = store.get(d)
    store.update(d, df, "first", state=dict(state))
    with pytest.raises(RuntimeError):
        store.update(d, df, "second", state=dict(state))
    assert [h["description"] for h in store.history_rows(d)] == ["Initial upload", "first"]


def test_state_reads_one_snapshot_and_the_tail(spark, stored):
    store, d = stored
    df = store.get(d)
    expected = []
    for i in range(12):
        store.update(d, df, f"edit {i}", "strip", {"column": "b", "i": i})
        store.set_override(d, "b", ("text", "categorical")[i % 2])
        expected.append(i)
    store.undo(d)
    store.update(d, df, "other")
    folded = store._state(d)
    log, snapshots = (store._numbered(f"{store.root}/{d}/{part}") for part in ("log", "snapshots"))
    assert sorted(snapshots) == [9, 19] and len(log) == 27
    # Entries that a snapshot holds are not read again.
    for seq in range(20):
        put(store, log[seq], "{")
    assert store._state(d) == folded
    steps = store.steps(d)
    assert [s["operation_params"]["i"] for s in steps[:-1]] == expected[:-1]
    assert steps[-1]["description"] == "other" and store.overrides(d) == {"b": "categorical"}
