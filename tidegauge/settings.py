"""Limits that decide which plan is used, and the checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A series longer than this is worked on in blocks of this many rows, so that no
# window, sort or array ever holds more than one block of it.
BLOCK_ROWS = 65_536
# Per-series statistics are broadcast only up to this many rows.
BROADCAST_ROWS = 200_000
# Rows of whole recordings that a task takes; the copies and sorts of a chain of windows then stay in its memory.
TASK_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private one only for local sessions."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidegauge-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_place(df: DataFrame) -> DataFrame:
    """Like `cut`; windows, aggregates and joins on the keys that the rows lie by need no shuffle afterwards.

    An adaptive plan doesn't say how its rows lie, so this one isn't.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of results that nothing can read any more; it does so when its driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the number of rows is known and small."""
    return F.broadcast(df) if rows is not None and rows <= limit else df
