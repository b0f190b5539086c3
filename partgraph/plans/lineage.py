"""Checkpoints in the session's shared folder, and settings that hold for a loop only."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the session's ``spark.checkpoint.dir``.

    One is made here only where the session has none and runs in one process
    (local tests); on a cluster, which can't share it, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="partgraph-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with an eager checkpoint, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_cut(df: DataFrame) -> DataFrame:
    """``cut`` of what was cached first: made once rather than twice, and planned by its true size.

    A checkpoint keeps the planner's estimate, for a join the product of its sides.
    In a loop of joins that number's digits double each time, until planning alone
    takes minutes; a cached frame's size is counted.
    """
    held = df.persist()
    try:
        held.count()
        return cut(held.select("*"))
    finally:
        held.unpersist()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing holds any more; it waits for the driver's collector else."""
    gc.collect()
    spark._jvm.System.gc()


def discard(path: str, spark: SparkSession) -> None:
    """Delete a folder of intermediate rows below ``shared_folder`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """SQL settings (dots written as double underscores) that are put back afterwards, also on error."""
    names = {k.replace("__", "."): str(v) for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
