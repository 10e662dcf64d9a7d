"""Lineage cuts that survive the loss of executors.

Intermediate tables go to the reliable folder named by ``spark.checkpoint.dir``.
A local session without that setting (tests, laptop) gets a temporary folder; a
cluster session without it, one of several processes on a machine included, is
refused, because a folder on one machine would not be visible to the others.

Tables stay as long as results that are still lazy may read them. A step that ends in a
table of its own goes through :func:`settled`, which deletes what the step stored on the
way, also when it fails; :func:`discard` deletes all that a session has stored.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_STORED: dict[str, list[str]] = {}
# Paths given out in each step that is open, by thread; the innermost step is last.
_OPEN = threading.local()
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ledgerweave-")
    return _LOCAL_ROOTS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    for paths in getattr(_OPEN, "steps", ())[-1:]:
        paths.append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    context = spark.sparkContext
    configuration = context._jsc.hadoopConfiguration()
    deleted = 0
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        deleted += path.getFileSystem(configuration).delete(path, True)
    known = set(paths)
    stored = _STORED.get(context.applicationId, [])
    stored[:] = [path for path in stored if path not in known]
    return deleted


def discard(spark: SparkSession) -> int:
    """Deletes every table the session has stored, in whatever store it lies, and says how
    many there were. Results that read them must have been written before."""
    return _delete(spark, list(_STORED.get(spark.sparkContext.applicationId, ())))


def delete(table: DataFrame) -> None:
    """Deletes a table that :func:`durable` returned, once nothing lazy reads it."""
    _delete(table.sparkSession, [_PATHS.pop(table)])


def settled(
    spark: SparkSession, label: str, step: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """The result of ``step`` as a table, which alone is left of all that the step stored:
    nothing lazy can read the rest any more. A step that fails leaves nothing.

    Steps may hold steps. Tables that a step stores from threads of its own are not its
    own, and stay. Losing an executor is no failure; Spark runs the lost tasks again while
    all tables still stand."""
    if not hasattr(_OPEN, "steps"):
        _OPEN.steps = []
    paths: list[str] = []
    _OPEN.steps.append(paths)
    try:
        result = durable(step(), label, partition_by)
        kept = paths.pop()
    finally:
        _OPEN.steps.pop()
        _delete(spark, paths)
    for outer in _OPEN.steps[-1:]:
        outer.append(kept)
    return result


def durable(
    df: DataFrame, label: str, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table
