import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import pytest

from datalathe.plans.fitted import FittedPipeline, fit_steps, treat_stream
from datalathe.plans.steps import replay
from datalathe.session import fresh_path


def step(operation, **params):
    return {"operation": operation, "operation_params": params}


STEPS = [
    step("remove_duplicate_rows"),
    step("impute", column="n", strategy="median"),
    step("impute", column="d", strategy="mode"),
    step("outlier_treatment", column="n", method="iqr", action="cap"),
    step("transform", column="n", transform="yeo_johnson"),
    step("scale", column="n", method="standard"),
    step("convert_dtype", column="s", target_type="datetime", layouts="infer"),
    step("elapsed", column="s"),
    step("bin", column="m", bins=3),
    step("encode", column="t", method="label"),
    step("encode", column="u", method="one_hot"),
    step("encode", column="v", method="binary"),
    step("encode", column="w", method="multi_label"),
    step("encode", column="x", method="frequency"),
    step("encode", column="y", method="ordinal", order=["lo", "hi"]),
    step("strip", column="z"),
    step("drop_column", column="gone"),
]
SCHEMA = (
    "__row_id long, n double, d date, s string, m long, t string, u string, v string, w string, x string, "
    "y string, z string, gone int"
)


def rows(count, start=0):
    return [
        (
            i, None if i % 5 == 0 else float(i % 17) * (50 if i % 31 == 0 else 1), None if i % 4 == 0 else dt.date(2020, 1, 1 + i % 3),
            f"{13 + i % 9}/02/2021", i % 10, "ab"[i % 2], "pqr"[i % 3], "efghi"[i % 5], "k|l" if i % 2 else "l", f"x{i % 6}",
            ("lo", "hi")[i % 2], f" z{i} ", 1,
        )
        for i in range(start, start + count)
    ]


def content(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def fitted(spark):
    train = spark.createDataFrame(rows(200), SCHEMA)
    pipeline = fit_steps(train, STEPS)
    path = fresh_path(spark, "fitted")
    pipeline.save(spark, path)
    return train, pipeline, path


def test_loaded_pipeline_gives_the_same(spark, fitted):
    train, pipeline, path = fitted
    loaded = FittedPipeline.load(spark, path)
    assert content(loaded.transform(train)) == content(pipeline.transform(train)) == content(replay(train, STEPS))
    # New rows are treated with what was learnt, whatever they hold themselves, and an unseen value is missing.
    new = spark.createDataFrame([(900, None, None, "31/12/2020", 500, "zz", "q", "e", "k", "x1", "hi", "  ", 3)], SCHEMA)
    out = loaded.transform(new).first()
    assert out["t"] is None and out["u_q"] == 1 and out["d"] == dt.date(2020, 1, 1) and out["m_bin"] == 2
    assert out["s"] == dt.datetime(2020, 12, 31) and out["n"] is not None and out["z"] == "" and "gone" not in out
    with pytest.raises(ValueError):
        pipeline.save(spark, path)
    assert loaded.transform(train.limit(0)).columns == pipeline.transform(train).columns


def test_steps_that_cannot_be_kept(spark, fitted):
    train = fitted[0]
    for strategy in ("forward_fill", "backward_fill", "knn"):
        with pytest.raises(ValueError):
            fit_steps(train, [step("impute", column="n", strategy=strategy)])
    with pytest.raises(ValueError):
        fit_steps(train, [step("pivot", column="n")])
    with pytest.raises(ValueError):
        treat_stream(fitted[1], train, "/unused")
    assert fit_steps(train, [{"operation": None, "operation_params": None}]).treatments == ()


def test_stream_equals_batch_and_goes_on_from_its_checkpoint(spark, fitted):
    _, _, path = fitted
    pipeline = FittedPipeline.load(spark, path)
    source, sink, checkpoint = (fresh_path(spark, name) for name in ("source", "sink", "checkpoint"))
    arrived = []

    def arrive(count, start):
        part = spark.createDataFrame(rows(count, start), SCHEMA)
        part.repartition(3).write.mode("append").parquet(source)
        arrived.append(part)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        treat_stream(pipeline, stream, sink, checkpoint).awaitTermination()
        return spark.read.parquet(sink)

    assert content(arrive(60, 1000)) == content(pipeline.transform(arrived[0]))
    # The second query, a new one, takes in the new files only.
    assert content(arrive(40, 2000)) == content(pipeline.transform(arrived[0].unionAll(arrived[1])))


def test_loaded_in_a_new_session(spark, fitted, tmp_path):
    """Another process, which knows the folder alone."""
    train, pipeline, path = fitted
    train.write.parquet(str(tmp_path / "train"))
    code = (
        "from datalathe.session import local_session\n"
        "from datalathe.plans.fitted import FittedPipeline\n"
        "s = local_session('other', cores=2)\n"
        f"d = FittedPipeline.load(s, {path!r}).transform(s.read.parquet({str(tmp_path / 'train')!r}))\n"
        f"d.write.parquet({str(tmp_path / 'out')!r})\n"
    )
    root = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=env)
    assert content(spark.read.parquet(str(tmp_path / "out"))) == content(pipeline.transform(train))
