import pytest

from datalathe.plans.reports import store_dashboard
from datalathe.plans.steps import execute, replay, steps_from_text, steps_to_json, steps_to_yaml
from datalathe.session import fresh_path
from datalathe.sources.files import read_csv, with_row_id, write_csv, write_parquet
from datalathe.sources.versions import VersionStore


def step(operation, **params):
    return {"operation": operation, "operation_params": params}


def test_operations(spark, column, values):
    assert values(execute(column([1.0, 2.0, None, 4.0]), "impute", {"column": "x", "strategy": "mean"}))[2] == pytest.approx(7 / 3)
    two = spark.createDataFrame([(0, 1, 3), (1, 2, 4)], "__row_id long, a long, b long")
    assert execute(two, "drop_column", {"column": "b"}).columns == ["__row_id", "a"]
    assert execute(two, "remove_duplicate_columns", {"columns_to_drop": ["b"]}).columns == ["__row_id", "a"]
    assert execute(column([1, 1, 2], "long"), "remove_duplicate_rows", {}).count() == 2
    text = column(["1.0", "2.0", "3.0"], "string")
    assert execute(text, "convert_dtype", {"column": "x", "target_type": "float"}).schema["x"].dataType.simpleString() == "double"
    assert values(execute(column([10, 20, 30], "long"), "scale", {"column": "x", "method": "minmax"})) == [0.0, 0.5, 1.0]
    for operation, params in (("pivot", {}), ("encode", {"column": "x", "method": "hashing"})):
        with pytest.raises(ValueError):
            execute(text, operation, params)


def test_replay(spark, column, values):
    df = spark.createDataFrame([(0, 1.0, 10), (1, 2.0, 20), (2, None, 30), (3, 4.0, 40)], "__row_id long, a double, b long")
    out = replay(df, [step("impute", column="a", strategy="median"), step("drop_column", column="b")])
    assert out.columns == ["__row_id", "a"] and values(out, "a") == [1.0, 2.0, 2.0, 4.0]
    assert df.where("a IS NULL").count() == 1
    assert values(replay(column([1, 2, 3], "long"), [])) == [1, 2, 3]
    assert values(replay(column([1, 2, 3], "long"), [{"operation": None, "operation_params": None}])) == [1, 2, 3]
    order = [step("convert_dtype", column="x", target_type="float"), step("scale", column="x", method="minmax")]
    assert values(replay(column(["10", "20", "30"], "string"), order)) == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        replay(column(["10", "20"], "string"), order[::-1])


def test_step_export_keeps_order():
    steps = [{"version_num": 2, "operation": "scale", "operation_params": {"column": "x", "method": "robust"}, "description": "d"}]
    assert steps_from_text(steps_to_json(steps)) == steps
    text = steps_to_yaml(steps)
    assert steps_from_text(text) == steps and text.index("version_num") < text.index("operation")


@pytest.fixture
def store(spark):
    return VersionStore(spark, fresh_path(spark, "store"))


def test_versions(spark, column, values, store):
    d = store.add(column([1.0, None, 3.0, 3.0]), "numbers.csv")
    for bad in (store.undo, store.redo):
        with pytest.raises(ValueError):
            bad(d)
    store.apply(d, "impute", {"column": "x", "strategy": "mean"})
    store.apply(d, "scale", {"column": "x", "method": "minmax"})
    assert store.get(d).count() == 4 and [h["is_current"] for h in store.history_rows(d)] == [False, False, True]
    assert None in values(store.restore(d, 1)) and None not in values(store.redo(d))
    assert [s["version_num"] for s in store.steps(d)] == [2]
    store.apply(d, "drop_column", {"column": "x"})  # drops the undone version 3
    assert [h["operation"] for h in store.history_rows(d)] == [None, "impute", "drop_column"]
    assert values(store.undo(d))[1] == pytest.approx(7 / 3)
    with pytest.raises(ValueError):
        store.restore(d, 9)
    listed = store.list_datasets().first()
    assert (listed["dataset_id"], listed["current_version"], listed["total_versions"]) == (d, 2, 3)
    store.delete(d)
    assert not store.exists(d)
    with pytest.raises(KeyError):
        store.get(d)


def test_reorder_becomes_the_lineage(spark, column, values, store):
    d = store.add(column(["10", "30", "30", None], "string"), "t.csv")
    store.apply(d, "convert_dtype", {"column": "x", "target_type": "float"})
    store.apply(d, "impute", {"column": "x", "strategy": "mean"})
    store.apply(d, "scale", {"column": "x", "method": "minmax"})
    out = store.reorder(d, [2, 4, 3])
    assert values(out) == pytest.approx([0.0, 1.0, 1.0, 2 / 3])
    assert [s["version_num"] for s in store.steps(d)] == [2, 4, 3]
    assert store.replay_check(d, strict=True)["matches_current"]
    with pytest.raises(ValueError):
        store.reorder(d, [2, 9])
    with pytest.raises(ValueError):
        store.reorder(d, [3, 2])


def test_overrides_and_dashboard(spark, column, store):
    d = store.add(column(["a|b", "b|a", "a|b"], "string"), "t.csv")
    store.set_override(d, "x", "text")
    assert store.overrides(d) == {"x": "text"}
    with pytest.raises(KeyError):
        store.set_override(d, "y", "text")
    store.apply(d, "encode", {"column": "x", "method": "multi_label"})
    assert store.steps(d)[0]["operation_params"]["delimiter"] == "|"
    board = store_dashboard(store, d)
    assert board["step_count"] == 1 and board["overview"]["columns"] == 2 and board["health"]["score"] < 100
    store.clear_override(d, "x")
    assert store.overrides(d) == {}


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_types_and_order(spark, tmp_path):
    body = "n,f,b,t,gap,odd\n" + "".join(f'{i},{i}.5,{"True" if i % 2 else "False"},"a, ""{i}""",NA,{i if i else "x"}\n' for i in range(300))
    df = read_csv(spark, write(tmp_path / "x.csv", body))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "bigint", "double", "boolean", "string", "double", "string"]
    got = df.orderBy("__row_id").collect()
    assert [r["__row_id"] for r in got] == list(range(300)) == [r["n"] for r in got]
    assert got[5]["t"] == 'a, "5"' and got[5]["gap"] is None


def test_csv_splits_are_numbered_in_file_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        folder = tmp_path / "parts.csv"
        folder.mkdir()
        for p, (lo, hi) in enumerate(((0, 40), (40, 900), (900, 1000))):
            write(folder / f"part-{p}.csv", "n,t\n" + "".join(f"{i},row {i}\n" for i in range(lo, hi)))
        got = read_csv(spark, str(folder)).orderBy("__row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["n"] for r in got] == list(range(1000)) == [r["__row_id"] for r in got]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path / "x.txt", "a\n1\n"))
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path / "empty.csv", "a,b\n"))
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path / "long.csv", "a,b\n1,2,3\n"))
    short = read_csv(spark, write(tmp_path / "short.csv", "a,b\n1\n2,3\n"))
    assert [(r["a"], r["b"]) for r in short.orderBy("a").collect()] == [(1, None), (2, 3)]


def test_exports(spark, column, tmp_path):
    df = column([" a", None, 'q"'], "string").selectExpr("*", "__row_id AS n").repartition(3)
    write_csv(df, str(tmp_path / "out.csv"))
    back = read_csv(spark, str(tmp_path / "out.csv"))
    assert [r["x"] for r in back.orderBy("__row_id").collect()] == [" a", None, 'q"']
    write_parquet(df, str(tmp_path / "out.parquet"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).columns == ["x", "n"]


def test_row_ids(spark):
    df = spark.range(500).selectExpr("(id * 7919) % 503 AS v").repartition(6)
    got = with_row_id(df, ["v"]).orderBy("__row_id").collect()
    assert [r["__row_id"] for r in got] == list(range(500)) and [r["v"] for r in got] == sorted(r["v"] for r in got)
    assert sorted(r["__row_id"] for r in with_row_id(df).collect()) == list(range(500))


def test_two_writers_cannot_overwrite_each_other(spark, column, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    dataset = store.add(column([1.0, None]), "x.csv")
    state = store._state(dataset)
    store.apply(dataset, "impute", {"column": "x", "strategy": "mean"})
    with pytest.raises(RuntimeError, match="another writer"):
        store.update(dataset, column([5.0]), "late", "scale", {"column": "x"}, state=state)
    assert store.get(dataset).count() == 2


def test_undone_versions_stay_readable_until_pruned(spark, column, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    dataset = store.add(column([1.0, None]), "x.csv")
    old = store.apply(dataset, "impute", {"column": "x", "strategy": "mean"})
    store.undo(dataset)
    store.apply(dataset, "impute", {"column": "x", "strategy": "drop_rows"})
    assert old.count() == 2
    assert store.prune(dataset) == 1
