"""Cutting lineage of intermediates that several plans share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

OWN_FOLDER = "/tmp/checkpoints"  # of local sessions that name none
SIDE_BY_SIDE = 8  # plans that are made and run at a time


def _has_folder(spark: SparkSession) -> bool:
    """Whether checkpoints have a folder; the session names it, a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return True
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return True
    if context.master.startswith("local"):
        context.setCheckpointDir(OWN_FOLDER)
        return True
    return False


def shared_folder(spark: SparkSession) -> str:
    """The session's own part of the checkpoint folder, which driver and executors share."""
    if not _has_folder(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and write it to the checkpoint folder, so the plans that share it start from there.

    On a cluster the folder is the shared one of ``spark.checkpoint.dir``; without that setting this is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Compute ``df`` once over all cores and write it as Parquet to the checkpoint folder; plans that share it read the columns they need.

    A small file is one task however much work its rows are, so the rows are dealt out first, and what follows
    starts from as many files as there are cores to read them.
    """
    path = f"{shared_folder(df.sparkSession)}/spread-{uuid.uuid4().hex}"
    void = {f.name for f in df.schema if f.dataType.simpleString() == "void"}  # Parquet has no such type
    kept = df.drop(*void)
    kept.repartition(cores(df.sparkSession)).write.parquet(path)
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns])


def cores(spark: SparkSession) -> int:
    """The tasks that run at a time."""
    return max(spark.sparkContext.defaultParallelism, 1)


def threaded(task: Callable[..., T]) -> Callable[..., T]:
    """``task`` for another thread, with the job properties of this one."""
    return inheritable_thread_target(SparkSession.active())(task)


def pool() -> ThreadPoolExecutor:
    """Threads for plans that do not wait for one another; while one is made or ends in a few tasks, others keep the cores busy.

    Tasks start in the order of their submission, so one may wait for those submitted before it.
    """
    return ThreadPoolExecutor(SIDE_BY_SIDE)


def together(*tasks: Callable[[], T]) -> list[T]:
    """The results of functions that run side by side; the error of the first one that failed."""
    with pool() as threads:
        return [f.result() for f in [threads.submit(threaded(task)) for task in tasks]]
