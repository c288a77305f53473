"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import wraps
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: The run-time setting that names the shared folder where ``spark.checkpoint.dir`` is not set.
SHARED_DIR = "datalathe.shared.dir"
_FOLDER_LOCK = threading.Lock()
_SCOPE: ContextVar[list | None] = ContextVar("scratch", default=None)


def local_session(app: str = "datalathe", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else ``datalathe.shared.dir``.

    Spark refuses to change the former on a running session, so where neither is set *and*
    the master is local, a machine-local folder is made once and kept under the latter; a
    cluster without a shared folder is an error.
    """
    with _FOLDER_LOCK:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_DIR, None)
        if folder:
            return folder
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="datalathe-")
        spark.conf.set(SHARED_DIR, folder)
        return folder


def cut_lineage(df):
    """The same rows read back from a Parquet table in the shared folder.

    Computed once, survives the loss of executors, and keeps column pruning for what
    follows. The cluster's retention of that folder decides how long the files stay.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "datalathe-cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, tasks: dict[str, Callable[[], Any]], workers: int = 8) -> dict[str, Any]:
    """Run independent small jobs at the same time, so their scheduling gaps overlap."""
    if len(tasks) == 1:
        return {name: task() for name, task in tasks.items()}
    with ThreadPoolExecutor(max_workers=workers) as pool:
        running = {
            name: pool.submit(copy_context().run, inheritable_thread_target(spark)(task)) for name, task in tasks.items()
        }
        return {name: future.result() for name, future in running.items()}


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder nobody else writes to."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, on leaving, the tables that operators wrote to the shared folder within.

    For calls whose results are plain values: a DataFrame made inside may read such a table later.
    """
    token = _SCOPE.set([])
    try:
        yield
    finally:
        paths = _SCOPE.get()
        _SCOPE.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def plain_result(function):
    """For functions of a DataFrame that return plain values: what they write meanwhile is deleted."""

    @wraps(function)
    def run(df, *args, **kwargs):
        with scratch(df.sparkSession):
            return function(df, *args, **kwargs)

    return run
