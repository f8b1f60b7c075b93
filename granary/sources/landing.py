"""Landing zone: results that several branches of a plan read, or that later jobs read again, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

_LANDED: dict[str, list[str]] = {}
_STORED: dict[str, dict[tuple, object]] = {}
Made = TypeVar("Made")
#: Rows of a task whose work on each row is long.
ROWS_A_TASK = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what spark.checkpoint.dir names. Unset, a temporary one, on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="granary-"))
    return sc.getCheckpointDir()


def landed(df: DataFrame, label: str = "landed") -> DataFrame:
    """df, computed once, written to the shared folder and read again; it stays until purge()."""
    spark = df.sparkSession
    path = landing_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def landing_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which purge() deletes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _LANDED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(spark: SparkSession, label: str, paths: list[str], make: Callable[[], Made]) -> Made:
    """What make() gives, made once in an application for each state of the files at `paths`, until purge()."""
    known = _STORED.setdefault(spark.sparkContext.applicationId, {})
    key = (label, *(fingerprint(spark, p) for p in paths))
    if key not in known:
        known[key] = make()
    return known[key]  # type: ignore[return-value]


def purge(spark: SparkSession) -> int:
    """Deletes what was landed and stored in this application; call it once nothing reads it any more. Returns how many."""
    jvm, n = spark.sparkContext._jvm, 0
    _STORED.pop(spark.sparkContext.applicationId, None)
    for name in _LANDED.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def fingerprint(spark: SparkSession, path: str) -> tuple[str, int, int, int]:
    """What tells one state of a file or folder of files from another: its path, files, bytes and latest change."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return path, len(found), sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


def spread(df: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """df dealt to all cores where it has fewer partitions than that: a small file that is one task's work. With
    rows_a_task, dealt to as many tasks as keep each at about that, so that a task doesn't grow with the table."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows_a_task:
        tasks = max(tasks, -(-df.count() // rows_a_task))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
