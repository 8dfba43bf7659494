"""Where intermediate tables go: the folder the cluster shares, never a worker's own disk."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folder of the run whose intermediate tables are freed together, below the shared folder.
_run: ContextVar[str] = ContextVar("run", default="")
_local_scratch: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a single-machine session (``local[...]``) that names none gets a temporary one, which
    is removed with the Python process.
    """
    global _local_scratch
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="scoreloom-")
    return _local_scratch.name


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{_run.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_tables(spark: SparkSession) -> Iterator[str]:
    """Free every table that is stored inside the block when the block ends.

    Lazy results read those tables, so write or collect them before. Without the block tables stay until whoever owns the
    shared folder clears it.
    """
    run = f"run-{uuid.uuid4().hex}/"
    token = _run.set(run)
    try:
        yield run
    finally:
        _run.reset(token)
        delete_path(spark, f"{shared_folder(spark)}/{run}")


def delete_path(spark: SparkSession, name: str) -> None:
    """Remove a stored table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a method that HotSpot compiles at most; larger ones are interpreted.
COMPILED_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def wide_projections(spark: SparkSession) -> Iterator[None]:
    """For what runs inside the block Spark cuts the code of wide projections into methods that the JVM compiles.

    By default all expressions of a stage go into one method, which beyond a certain size is only interpreted, for every row.
    """
    before = spark.conf.get(_METHOD_LIMIT, None)
    spark.conf.set(_METHOD_LIMIT, str(min(COMPILED_BYTES, int(before or COMPILED_BYTES))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_METHOD_LIMIT)
        else:
            spark.conf.set(_METHOD_LIMIT, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts a plan that has grown wide or is about to be scanned several times. The table outlives
    lost executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
