"""Cutting long plans at a copy in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder and read it from there; the copy outlives lost executors.

    Spark deletes the copy once nothing refers to it.
    """
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Spark reads this bound when a frame is run, not when it is made.
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _least(before: str, most: int) -> str:
    # below 1 there is no bound
    return str(most if int(before) < 1 else min(most, int(before)))


@contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """While frames are written, workers are handed at most so many rows at a time; a batch is held on both sides at once."""
    before = spark.conf.get(ROWS_A_BATCH)
    spark.conf.set(ROWS_A_BATCH, _least(before, most))
    try:
        yield
    finally:
        spark.conf.set(ROWS_A_BATCH, before)


def few_rows_a_batch(frame: DataFrame, most: int) -> DataFrame:
    """The same frame in a session of its own, where workers are handed at most so many rows at a time.

    So what is made of it keeps the bound, whoever runs it and when. The session has the other settings of the frame's
    own as they are now, and shares its context and copies.
    """
    spark = frame.sparkSession
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) and own.conf.get(name, None) != value:
            own.conf.set(name, value)
    own.conf.set(ROWS_A_BATCH, _least(spark.conf.get(ROWS_A_BATCH), most))
    view = f"frame_{uuid.uuid4().hex}"
    frame.createGlobalTempView(view)
    try:
        return own.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)


def one_file_a_batch(spark: SparkSession):
    """While a copy of what workers read from whole files is written, they are handed one file at a time.

    Else a batch holds all files of a task, as many bytes as a partition has.
    """
    return rows_a_batch(spark, 1)


def freed(run: Callable) -> Callable:
    """A function for mapInArrow that hands memory back to the system at its end; its worker lives on beside later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and copies that nothing refers to any more, before a loop makes many more.

    Spark does so whenever the driver happens to collect its garbage; a driver with little to do may wait for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the one that `spark.checkpoint.dir` names, or in local mode a temporary one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cuadra-checkpoint-"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path names a folder of whatever store it lies in."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isDirectory()
