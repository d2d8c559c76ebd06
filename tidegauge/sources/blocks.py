"""Recordings inside a longer table: contiguous runs of an identifier."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.domains import RECORDING_COLUMNS
from tidegauge.functions.series import Series
from tidegauge.settings import small

UNKNOWN = "(unknown)"


def identifier_columns(names: list[str]) -> list[str]:
    """Identifier columns present, finest unit first."""
    bare = lambda n: re.sub("[^a-z0-9]", "", n.lower())
    plain = {bare(n): n for n in names}
    return [plain[k] for k in dict.fromkeys(map(bare, RECORDING_COLUMNS)) if k in plain]


def detect_blocks(s: Series, names: list[str], min_rows: int = 30, max_blocks: int = 150) -> DataFrame:
    """(source keys, column, block, start, stop, label) of the first identifier that splits the source well.

    It must give 2 to 150 runs with a median of at least 30 rows, 80 % of them
    that long. Backward jumps of the clock never split: they may be faults.
    """
    ids = identifier_columns(names)
    keys = list(s.keys)
    label = {c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(UNKNOWN))) for c in ids}
    s = s.scan(lag={f"_l{i}": label[c] for i, c in enumerate(ids)})
    opens = F.array(*[F.when(F.col(f"_l{i}").isNull() | (F.col(f"_l{i}") != label[c]),
                             F.struct(F.lit(i).alias("rank"), F.lit(c).alias("column"), label[c].alias("label"))) for i, c in enumerate(ids)])
    starts = s.df.select(*keys, "idx", F.inline(F.array_compact(opens)))
    size = s.df.groupBy(*keys).agg((F.max("idx") + 1).alias("n")).filter(F.col("n") >= 2 * min_rows)
    count = starts.groupBy(*keys, "rank").agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs").between(2, max_blocks))
    few = s.groups * max(1, len(ids))
    # From here on there are at most max_blocks rows per source and column.
    kept = starts.join(small(count.drop("runs"), few), [*keys, "rank"])
    runs = kept.groupBy(*keys, "rank", "column").agg(F.sort_array(F.collect_list(F.struct("idx", "label"))).alias("runs"))
    runs = runs.join(small(size, s.groups), keys)
    stop = F.transform("runs", lambda r, i: F.coalesce(F.get(F.col("runs"), i + 1)["idx"], F.col("n")))
    runs = runs.withColumn("stops", stop).withColumn("lens", F.zip_with("runs", "stops", lambda r, e: e - r["idx"]))
    ordered = F.array_sort("lens")
    half = F.size("lens") / 2
    median = (F.get(ordered, F.ceil(half).cast("int") - 1) + F.get(ordered, F.floor(half).cast("int"))) / 2
    long = F.size(F.filter("lens", lambda x: x >= min_rows)) / F.size("lens")
    good = runs.filter((median >= min_rows) & (long >= 0.8))
    best = good.groupBy(*keys).agg(F.min_by(F.struct("column", "runs", "stops"), "rank").alias("b"))
    rows = best.select(*keys, F.col("b.column").alias("column"), F.posexplode(F.arrays_zip(F.col("b.runs").alias("r"), F.col("b.stops").alias("e"))).alias("block", "z"))
    return rows.select(*keys, "column", "block", F.col("z.r.idx").alias("start"),
                       F.col("z.e").alias("stop"), F.col("z.r.label").alias("label"))


def with_blocks(s: Series, column: str) -> Series:
    """Every run of the identifier as its own recording, rows and order unchanged.

    The same label met again later is another recording.
    """
    label = F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(UNKNOWN)))
    s = s.scan(lag={"_l": label})
    s = s.scan(last={"_start": F.when(F.col("_l").isNull() | (F.col("_l") != label), F.col("idx"))})
    name = F.concat_ws("#", *s.keys, F.col("_start").cast("string"))
    df = s.df.withColumn("recording_id", name).withColumn("idx", F.col("idx") - F.col("_start")).withColumn("label", label)
    return Series.of(df.drop("_l", "_start", *[k for k in s.keys if k != "recording_id"]), ("recording_id",), s.block)


def select_block(s: Series, start: int, stop: int) -> Series:
    """One run by position, renumbered from 0."""
    if not 0 <= start < stop:
        raise ValueError("selected recording is outside the table")
    df = s.df.filter((F.col("idx") >= start) & (F.col("idx") < stop)).withColumn("idx", F.col("idx") - start)
    return Series(df, s.keys, min(s.longest, stop - start), s.groups, s.block)
