"""Delimited recordings: dialect per file, reading, and mapping onto common columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.operators.columns import as_number, promote

SEPARATORS = (",", ";", "\t", "|")
SAMPLE_LINES = 20


def dialects(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, separator, decimal) of every file under a path, in one scan.

    The separator is the one with the largest median count per line over the
    first 20 non-blank lines, then the steadiest; .tsv files use tabs. The
    decimal mark is a comma when more numbers are written with it than with a dot.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line"), "value")
    comma, dot = r"(?<!\d)\d+,\d+|\d+,\d+(?!\d)", r"(?<!\d)\d+\.\d+|\d+\.\d+(?!\d)"
    whole = lines.groupBy("file").agg(
        F.sum(F.regexp_count("value", F.lit(comma))).alias("commas"), F.sum(F.regexp_count("value", F.lit(dot))).alias("dots"),
        F.bool_or(~F.is_valid_utf8("value")).alias("broken"))
    rank = F.row_number().over(W.partitionBy("file").orderBy("part", "line"))
    head = lines.filter(F.trim("value") != "").withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_LINES)
    counts = head.groupBy("file").agg(
        *[F.percentile(_count(s), F.lit(0.5)).alias(f"m{i}") for i, s in enumerate(SEPARATORS)],
        *[F.stddev_pop(_count(s)).alias(f"s{i}") for i, s in enumerate(SEPARATORS)])
    scores = F.array(*[F.struct(F.col(f"m{i}").alias("m"), (-F.col(f"s{i}")).alias("s"), F.lit(-i).alias("i"), F.lit(s).alias("sep"))
                       for i, s in enumerate(SEPARATORS)])
    sep = F.when(F.lower("file").endswith(".tsv"), "\t").otherwise(F.array_max(scores)["sep"])
    out = whole.join(counts, "file").withColumn("separator", sep)
    return out.select(
        "file", F.when(F.col("broken"), "latin-1").otherwise("utf-8-sig").alias("encoding"), "separator",
        F.when((F.col("separator") != ",") & (F.col("commas") > F.col("dots")), ",").otherwise(".").alias("decimal"))


def _count(sep: str) -> Column:
    return (F.length("value") - F.length(F.replace(F.col("value"), F.lit(sep), F.lit("")))).cast("double")


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """The dialect of every file, its first line, and a status: ok, single column or empty (files of no byte are skipped)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    first = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                                         F.monotonically_increasing_id().alias("line"), "value").filter(F.trim("value") != "")
    first = first.groupBy("file").agg(F.min_by("value", F.struct("part", "line")).alias("header"))
    told = dialects(spark, path).join(first, "file")
    # Both readers name files alike but for the slashes after the scheme.
    key = F.regexp_replace(F.url_decode("file"), "^file:/+", "/").alias("_key")
    out = files.select("file", key).join(told.select(key, *[c for c in told.columns if c != "file"]), "_key", "left")
    status = F.when(F.col("header").isNull(), "empty").when(_count_of("header", "separator") < 1, "single column").otherwise("ok")
    return out.select("file", "encoding", "separator", "decimal", "header", status.alias("status"))


def _count_of(text: str, part: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.col(part), F.lit("")))


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None,
                   convert: bool = True) -> DataFrame:
    """All files as text columns with trimmed names, plus source and row order.

    Files are read in groups of one encoding, separator and header, and joined by column name; columns that a file lacks
    are NULL. Numbers are recognised afterwards, with their decimal mark and units. A separator given by the caller that
    finds fewer than two columns is wrong: it is then told from the file. Blank files and files of a single column have
    no rows here; `layouts` tells of them.
    """
    given = F.lit(separator)
    parts = layouts(spark, path).filter("status <> 'empty'")
    if separator is not None:
        parts = parts.withColumn("separator", F.when(F.contains("header", given), given).otherwise(F.col("separator")))
    if encoding is not None:
        parts = parts.withColumn("encoding", F.lit(encoding))
    if parts.filter("status = 'ok'").take(1):  # else a folder of single columns, which is read as it is
        parts = parts.filter("status = 'ok'")
    groups = parts.groupBy("encoding", "separator", "header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not groups:
        raise ValueError(f"no readable file in {path}")

    def load(group) -> DataFrame:
        name = {"latin-1": "ISO-8859-1"}.get(group["encoding"], "UTF-8")
        raw = spark.read.option("header", True).option("sep", group["separator"]).option("encoding", name).csv(group["files"])
        return raw.select(*[F.col(f"`{n}`").alias(n.strip().lstrip("\ufeff")) for n in raw.columns], F.col("_metadata.file_path").alias("source"))

    loaded = [load(g) for g in sorted(groups, key=lambda g: g["files"][0])]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loaded)
    names = [c for c in df.columns if c != "source"]
    df = df.select(*[F.col(f"`{n}`") for n in names], "source", F.monotonically_increasing_id().alias("row"))
    if not convert:
        return df
    body = promote(df.drop("source", "row"))
    return df.select(*[as_number(F.col(f"`{n}`")).alias(n) if body.schema[n].dataType.simpleString() == "double" else F.col(f"`{n}`") for n in body.columns], "source", "row")


def adapt(df: DataFrame, mapping: dict[str, list[str] | str], clock: str, seconds_per_unit: float, keep=()) -> DataFrame:
    """Heterogeneous exports onto timestamp, gaze_x, gaze_y, pupil…

    A target fed by several columns (left and right eye) is the mean of those
    available in the row; text numbers may use a decimal comma.
    """
    cols = [(as_number(F.col(f"`{clock}`")) * seconds_per_unit).alias("timestamp")]
    for target, sources in mapping.items():
        parts = [as_number(F.col(f"`{c}`")) for c in ([sources] if isinstance(sources, str) else sources)]
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
        seen = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
        cols.append(F.when(seen > 0, total / F.when(seen > 0, seen)).alias(target))
    return df.select(*keep, *cols)
