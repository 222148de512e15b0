"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Folders that the innermost running staged() function has written.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir (a temporary folder only where none is set and Spark is local)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return f"{base.rstrip('/')}/stratalog-{uuid.uuid4().hex}"


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most so many bytes (or one row), so Python workers and off-heap buffers stay small."""
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def stage(df: DataFrame, name: str = "stage", *, most: int = 8 << 20) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    with batch_bytes(spark, most):
        df.write.parquet(path)
    held = _written.get()
    if held is not None:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result is a staged table; what it staged on the way is deleted when the result stands."""

    @wraps(f)
    def run(*args, **options) -> DataFrame:
        held: list[str] = []
        token = _written.set(held)
        try:
            out = f(*args, **options)
            if getattr(out, "_staged_at", None) not in held:
                out = stage(out, "result")
        finally:
            _written.reset(token)
        remove(out.sparkSession, [p for p in held if p != out._staged_at])
        outer = _written.get()
        if outer is not None:
            outer.append(out._staged_at)
        return out

    return run


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders through Hadoop's file system, as they were written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {p.rsplit("/", 1)[0] for p in paths}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def drop_stage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, [df._staged_at])


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go: Spark deletes them when the driver has collected what names them, which
    a driver with little to do otherwise puts off while executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()
