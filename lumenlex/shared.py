"""Storage that every executor and the driver can see, and lineage cuts that survive lost executors."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a local master alone, a temporary one if the session names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
        named = f"file://{tempfile.mkdtemp(prefix='lumenlex-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; later stages read it from there, not from executors.

    Partitions stay as they are, and so does the order inside them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a job writes and reads again."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Hands memory that is free in this process to the system; Arrow's pool and malloc would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # malloc_trim is glibc's alone
        ctypes.CDLL(None).malloc_trim(0)


def giving_back[T](run: Callable[[Iterator], Iterator[T]]) -> Callable[[Iterator], Iterator[T]]:
    """run, a pass over batches, that gives back at its end what it has freed: a worker stays while later stages run in the JVM."""

    @functools.wraps(run)
    def passed(batches: Iterator) -> Iterator[T]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return passed


class Tables:
    """Tables of one job in the shared folder, each written once, and deleted when the job says so."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes the files of tables that nothing will read again; others than written ones are left alone."""
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path is not None:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
