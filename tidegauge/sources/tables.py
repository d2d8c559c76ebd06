"""Parquet tables read as recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalar import finite, long_form
from tidegauge.functions.series import Series, ordered_index, sizes
from tidegauge.settings import BLOCK_ROWS, TASK_ROWS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def recordings(df: DataFrame, recording: Column, order: list[str], lead: Column, signals: dict[str, Column],
               clock: Column | None = None, rate_hz: float | None = None, keep: dict[str, Column] | None = None,
               block: int = BLOCK_ROWS) -> Series:
    """Wide series keyed by recording_id: idx, t and one column per signal.

    Either a clock in seconds is given, and t counts from its first value, or
    the declared rate sets t = idx / rate.
    """
    cols = [recording.cast("string").alias("recording_id"), *[F.col(c).alias("_o_" + c) for c in order],
            lead.cast("double").alias("_lead"), *[finite(c).alias(n) for n, c in signals.items()],
            *[c.alias(n) for n, c in (keep or {}).items()]]
    if clock is not None:
        cols.append(clock.alias("_clock"))
    base = df.select(*cols)
    longest, groups, rows = sizes(base, ["recording_id"])
    if longest <= block and rows > TASK_ROWS:
        # The one shuffle of a chain of windows: its tasks grow in number with the rows, not in size.
        base = base.repartition(-(-rows // TASK_ROWS), "recording_id")
    out = ordered_index(base, ["recording_id"], ["_o_" + c for c in order], F.col("_lead"), longest, groups, block)
    s = Series(out.drop("_lead", *["_o_" + c for c in order]), ("recording_id",), longest, groups, block)
    if clock is None:
        return s.with_column("t", F.col("idx") / F.lit(float(rate_hz)))
    s = s.stats({"_t0": F.min_by("_clock", F.when(F.col("_clock").isNotNull(), F.col("idx")))})
    return s.on(s.df.withColumn("t", F.col("_clock") - F.col("_t0")).drop("_clock", "_t0"))


def as_long(s: Series, signals: list[str], keep=("idx", "t")) -> Series:
    """(recording_id, signal, idx, t, value); the layout of the wide rows is kept."""
    df = long_form(s.df, signals, [*s.keys, *keep])
    return Series(df, (*s.keys, "signal"), s.longest, s.groups * len(signals), s.block)
