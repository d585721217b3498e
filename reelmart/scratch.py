"""Intermediate tables written to the cluster's shared checkpoint folder.

A written table cuts the lineage, survives the loss of executors, and is read back column by column
with its real size known to the optimizer.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
# Folders found to be shared, by application.
_shared_roots: set[tuple[str, str]] = set()
# Rows per core that try a folder out.
_TRIES = 4
# Folders to delete at the end of the surrounding cleared_scratch block, if there is one.
_to_clear: ContextVar[list[str] | None] = ContextVar("to_clear", default=None)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Only a ``local`` session may leave the setting empty: all its tasks share one machine, so a
    temporary folder of that machine is enough; it is removed when Python ends. On a cluster of several
    machines a folder of the local file system must be one that all of them share, as a mounted one is:
    it is tried out once, and refused if the driver and the executors do not see each other's files.
    """
    root = spark.conf.get(_SETTING, None)
    context = spark.sparkContext
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
        if context.applicationId not in _local_folders:
            folder = tempfile.mkdtemp(prefix="reelmart-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _local_folders[context.applicationId] = folder
        root = _local_folders[context.applicationId]
    elif not context.master.startswith("local") and (context.applicationId, root) not in _shared_roots:
        if _is_machine_local(spark, root) and not _is_shared(spark, root):
            raise ValueError(f"{_SETTING} is on a local file system that not all machines share: {root}")
        _shared_roots.add((context.applicationId, root))
    folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    to_clear = _to_clear.get()
    if to_clear is not None:
        to_clear.append(folder)
    return folder


def _is_machine_local(spark: SparkSession, folder: str) -> bool:
    """Whether the folder's file system, by its scheme or as the default, is the machine's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


def _is_shared(spark: SparkSession, root: str) -> bool:
    """Whether the driver and the executors at hand see what any of them writes below the folder.

    Tasks on every core write a row each. A file that an executor leaves on a disk of its own is missing
    when the driver commits the write, or when another executor reads it.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # Spark makes the folder on the driver when it starts; one that is mounted is there before.
    if not files.exists(path.getParent()):
        return False
    tasks = _TRIES * spark.sparkContext.defaultParallelism
    rows = spark.range(0, tasks, 1, tasks)
    try:
        rows.write.parquet(path.toString())
        return spark.read.schema(rows.schema).parquet(path.toString()).count() == tasks
    except Exception as failure:
        raise ValueError(f"{_SETTING} is on a local file system that cannot be shared: {root}") from failure
    finally:
        files.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a scratch parquet table, read back under the same schema."""
    return measured(df)[0]


def measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``written`` with aggregates of its rows, taken by the write itself."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    if not measures:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), {}
    taken = Observation()
    df.observe(taken, *(c.alias(name) for name, c in measures.items())).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), taken.get


@contextmanager
def cleared_scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch folders handed out within the block when the block ends.

    For a job that has saved its results by then; frames that still read scratch tables do not
    outlive the block.
    """
    token = _to_clear.set([])
    try:
        yield
    finally:
        folders = _to_clear.get()
        _to_clear.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
