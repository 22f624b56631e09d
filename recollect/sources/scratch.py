"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own name of the folder.
SHARED = "spark.checkpoint.dir"
#: Spark's own name of the switch by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none (a local test), a temporary folder of this
    machine is set; a cluster must name one.
    """
    named = spark.conf.get(SHARED, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set(SHARED, named)
    return named.rstrip("/")


class _Made(threading.local):
    """Paths that this thread of the driver has named and that may still be there: those of queries in other threads are theirs."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _made.paths.append(f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def mark() -> int:
    """A point in the list of fresh paths, for ``sweep``."""
    return len(_made.paths)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what this thread has written to the shared folder since a mark, once no result that reads it is needed."""
    gone = [p for p in _made.paths[since:] if p not in keep]
    _made.paths[since:] = [p for p in _made.paths[since:] if p in keep]
    for path in gone:
        drop_path(spark, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when it ends, not when the driver next collects garbage: nothing reads them after a write."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_path(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none where it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(p)] if files.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later result reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Give a complete folder its name; one that a failed move left there goes first."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(b.getParent())
    files.delete(b, True)
    if not files.rename(a, b):
        raise OSError(f"{path} can't be moved to {to}")


def unspool(*tables: DataFrame) -> None:
    """Delete spooled tables that no later result reads."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """A table of few files and under ``small`` bytes over all cores, for work that its one part would do alone; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < small and len(df.inputFiles()) < cores else df
