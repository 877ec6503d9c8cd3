"""Shared scratch space: lineage cuts and intermediate tables.

Everything goes below ``spark.checkpoint.dir`` as the session has it, which on
a cluster is a folder all executors see.  Only a local session without that
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker is handed at once by ``bounded_batches``.
BATCH_BYTES = 1 << 21
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from the session."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="cohortloom-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for one intermediate table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended; the caller's setting comes back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python workers ``BATCH_BYTES`` at a time, unless the session has a bound of its own.

    Spark's default is 10,000 rows of any length: of texts or sets that is tens of
    MB, which a task holds several times outside the heap, and its worker once more.
    """
    if spark.conf.get(_BATCHES, None) is not None:
        yield
        return
    spark.conf.set(_BATCHES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCHES)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Later reads survive lost executors without recomputing the lineage, and a
    columnar copy lets Spark prune the columns each consumer needs.  The
    shuffle files behind a written table serve nobody and are dropped.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_folder(spark).rstrip("/")
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if root.rsplit(":", 1)[-1].lstrip("/") not in folder:
            raise ValueError(f"{folder} is not below {root}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
