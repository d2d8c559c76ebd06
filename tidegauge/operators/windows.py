"""Fully observed reference windows of wide recordings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions.series import Series


def complete(signals: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in signals])


def with_runs(s: Series, signals: list[str]) -> Series:
    """full, run_start and run_rows: the run of fully observed rows around each row."""
    s = s.with_column("full", complete(signals))
    gap = F.when(~F.col("full"), F.col("idx"))
    s = s.scan(last={"_b": gap}, first={"_a": gap}).stats({"_n": F.count(F.lit(1))})
    start = F.coalesce(F.col("_b") + 1, F.lit(0).cast("long"))
    rows = F.coalesce(F.col("_a"), F.col("_n")) - start
    return s.on(s.df.withColumn("run_start", F.when(F.col("full"), start)).withColumn("run_rows", F.when(F.col("full"), rows))
                .drop("_b", "_a", "_n"))


def longest_run(s: Series, signals: list[str]) -> DataFrame:
    """Rows of the longest complete run per recording, 0 without any."""
    return with_runs(s, signals).summary({"longest_run": F.coalesce(F.max("run_rows"), F.lit(0))})


def complete_window(s: Series, signals: list[str], length: int) -> Series:
    """First longest complete run, cut to its first ``length`` rows, renumbered from 0.

    With fewer than min(length, 32) complete rows in all, the first ``length``
    complete rows are taken wherever they are.
    """
    keep = list(s.df.columns)
    s = with_runs(s, signals)
    best = F.max(F.when(F.col("full"), F.struct(F.col("run_rows").alias("r"), (-F.col("run_start")).alias("s"))))
    s = s.stats({"_best": best, "_full": F.sum(F.col("full").cast("int"))})
    s = s.scan(total={"_seen": F.col("full").cast("int")})
    start = -F.col("_best")["s"]
    few = F.col("_full") < min(length, 32)
    new = F.when(few, F.col("_seen") - 1).otherwise(F.col("idx") - start)
    inside = F.col("full") & F.when(few, F.col("_seen") <= length).otherwise(
        (F.col("run_start") == start) & (F.col("idx") < start + length))
    out = s.df.filter(inside).withColumn("idx", new.cast("long"))
    return Series(out.select(*keep), s.keys, min(s.longest, length), s.groups, s.block)


def fixed_windows(s: Series, signals: list[str], seconds: float = 6.0, min_rows: int = 32, per_recording: int = 1) -> DataFrame:
    """Complete stretches of a fixed duration: the first few per recording, with their rows."""
    keys = list(s.keys)
    s = with_runs(s, signals)
    s = s.scan(last={"_open": F.when(F.col("full") & (F.col("idx") == F.col("run_start")), F.col("t"))},
               first={"_close": F.when(F.col("full") & (F.col("idx") == F.col("run_start") + F.col("run_rows") - 1), F.col("t"))})
    no = F.floor((F.col("t") - F.col("_open")) / seconds)
    rows = s.df.filter("full").withColumn("_no", no).filter(F.col("_close") - F.col("_open") >= (F.col("_no") + 1) * seconds)
    wins = rows.groupBy(*keys, "run_start", "_no").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("rows"), F.min("t").alias("from_t"), F.max("t").alias("to_t"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("first_idx"))
    return (wins.filter(F.col("rows") >= min_rows).withColumn("window", rank.cast("long"))
            .filter(F.col("window") <= per_recording).drop("run_start", "_no"))
