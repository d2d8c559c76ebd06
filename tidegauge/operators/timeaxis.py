"""Time axis: parsing, units, sampling rate, diagnostics and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.domains import TIME_UNITS, UNIT_NAME_PATTERNS
from tidegauge.functions.scalar import finite
from tidegauge.functions.series import Series

DATE_LIKE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}"
AMBIGUOUS = "Timestamp unit is ambiguous"


def unit_from_name(name: Column) -> Column:
    """Unit told by a column name, NULL when the name does not tell."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(UNIT_NAME_PATTERNS):
        out = F.when(low.rlike(pattern), unit).otherwise(out)
    return out


def unit_scale(unit: Column) -> Column:
    """Seconds per unit."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIME_UNITS.items() for x in kv]), unit)


def parse_clock(df: DataFrame, column: str, unit: str = "auto") -> DataFrame:
    """Add clock (number in the original unit, or seconds for dates) and is_date.

    Text is read as date and time when asked for, or when fewer than 80 % of it
    is numeric and some of it looks like a date.
    """
    c = F.col(f"`{column}`")
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp") or kind == "date":
        secs = F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
        return df.withColumn("clock", secs).withColumn("is_date", F.lit(True))
    text, number = F.trim(c.cast("string")), finite(c.try_cast("double"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in (
        "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd",
        "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")])
    secs = F.when(number.isNull(), F.unix_micros(parsed) / F.lit(1e6))
    if unit == "date":
        return df.withColumn("clock", secs).withColumn("is_date", F.lit(True))
    if unit != "auto" or kind not in ("string",):
        return df.withColumn("clock", number).withColumn("is_date", F.lit(False))
    n, numbers, dated = df.agg(F.count(c), F.count(number), F.bool_or(text.rlike(DATE_LIKE))).first()
    is_date = numbers < 0.8 * n and bool(dated)
    return df.withColumn("clock", secs if is_date else number).withColumn("is_date", F.lit(is_date))


def relative_seconds(s: Series, clock: str, scale: Column) -> Series:
    """Column t: seconds since the first available clock value of the recording.

    The origin is subtracted before the unit is applied, which keeps the
    precision of large integer device clocks.
    """
    first = F.min_by(F.col(clock), F.when(F.col(clock).isNotNull(), F.col("idx")))
    s = s.stats({"_origin": first})
    return s.on(s.df.withColumn("t", (F.col(clock) - F.col("_origin")) * scale).drop("_origin"))


def axis_metadata(s: Series, clock: str, column: str, unit: str = "auto", is_date: bool = False) -> DataFrame:
    """Per recording: how its time axis comes about from a clock, or why there is none.

    Steps run between available values. The unit is the one asked for, or told by the column's name.
    """
    chosen = F.lit("date/time") if is_date else unit_from_name(F.lit(column)) if unit == "auto" else F.lit(unit)
    scale = F.lit(1.0) if is_date else unit_scale(chosen)
    known = F.col(clock).isNotNull()
    s = s.scan(last={"_seen": F.when(known, F.struct("idx", F.col(clock).alias("c")))})
    s = s.scan(lag={"_prev": F.col("_seen")})
    s = s.with_column("_step", F.when(known, F.col(clock) - F.col("_prev")["c"]))
    step = F.col("_step")
    pos = F.when(step > 0, step)
    d = s.summary({"_n": F.count(clock), "origin": F.min_by(clock, F.when(known, F.col("idx"))),
                   "missing_timestamps": F.count_if(~known), "non_increasing_steps": F.count_if(step <= 0),
                   "_least": F.min(pos), "_most": F.max(pos)}, {"_med": (pos, 0.5)})
    far = F.greatest(F.col("_most") - F.col("_med"), F.col("_med") - F.col("_least"))
    status = (F.when((F.col("_n") < 2) | F.col("_med").isNull(), "Needs two usable values and a positive interval")
              .when(scale.isNull(), AMBIGUOUS).otherwise("ok"))
    return d.select(
        *s.keys, F.lit(column).alias("column"), F.lit(unit).alias("unit_selection"), chosen.alias("original_unit"),
        scale.alias("seconds_per_original_unit"), "origin", "missing_timestamps", "non_increasing_steps",
        F.coalesce(far > 0.05 * F.col("_med"), F.lit(False)).alias("irregular_intervals"), status.alias("status"))


def sampling_rate(s: Series, clock: str, scale: Column) -> DataFrame:
    """rate_hz and the reason, from the median positive step of the clock."""
    # Steps run between available values, so a missing value is stepped over.
    s = s.scan(last={"_seen": F.when(F.col(clock).isNotNull(), F.struct("idx", F.col(clock).alias("c")))})
    s = s.scan(lag={"_prev": F.col("_seen")})
    step = F.when(F.col(clock).isNotNull(), F.col(clock) - F.col("_prev")["c"])
    out = s.summary({"n_times": F.count(clock)}, {"_dt": (F.when(step > 0, step), 0.5)})
    rate = 1.0 / (F.col("_dt") * scale)
    return out.select(
        *s.keys,
        F.when(rate.between(1e-9, 1e4), rate).alias("rate_hz"),
        F.when(F.col("n_times") < 2, "Too few timestamp values")
        .when(F.col("_dt").isNull(), "No stable positive timestamp increments")
        .when(scale.isNull(), AMBIGUOUS)
        .when(~rate.between(1e-9, 1e4), "Inferred rate is outside the supported range")
        .otherwise("Inferred from median timestamp step").alias("reason"))


def diagnostics(s: Series) -> DataFrame:
    """Per recording: counts of bad steps, intervals, rate, regularity, validity.

    A coarsely quantised clock alternates between neighbouring ticks and its
    median step overstates the rate; there the mean of the steps up to the 99 %
    quantile is used.
    """
    s = s.scan(lag={"_pt": F.col("t")})
    s = s.with_column("_step", F.col("t") - F.col("_pt"))
    pos = F.when(F.col("_step") > 0, F.col("_step"))
    s = s.stats(quantiles={"_med": (pos, 0.5), "_q05": (pos, 0.05), "_q80": (pos, 0.8), "_q99": (pos, 0.99)})
    pos, med = F.when(F.col("_step") > 0, F.col("_step")), F.col("_med")
    aggs = {
        "n_rows": F.count(F.lit(1)),
        "missing_timestamps": F.count_if(F.col("t").isNull()),
        "duplicate_steps": F.count_if(F.col("_step") == 0),
        "backward_steps": F.count_if(F.col("_step") < 0),
        "_np": F.count(pos), "median_interval_seconds": F.max(med),
        "_trim": F.avg(F.when(pos <= F.col("_q99"), pos)),
        "_q05": F.max("_q05"), "_q80": F.max("_q80"), "_q99": F.max("_q99"),
        "_far": F.max(F.abs(pos - med)),
        "_first": F.min_by("t", "idx"), "_last": F.max_by("t", "idx"),
    }
    d = s.summary(aggs)
    med = F.col("median_interval_seconds")
    quantised = ((F.col("_np") > 100) & (F.col("_q05") > 0) & (med <= 2.05 * F.col("_q05"))
                 & (F.col("_q80") > 1.35 * F.col("_q05")) & (F.col("_q99") <= 3.2 * F.col("_q05")))
    effective = F.when(F.coalesce(quantised, F.lit(False)), F.col("_trim")).otherwise(med)
    complete = F.col("missing_timestamps") == 0
    return d.select(
        *s.keys, "n_rows", "missing_timestamps", "duplicate_steps", "backward_steps", "median_interval_seconds",
        effective.alias("effective_interval_seconds"),
        F.when(F.coalesce(quantised, F.lit(False)), "trimmed-mean interval for coarsely quantised clock")
        .otherwise("inverse median of positive intervals").alias("sampling_rate_estimation"),
        F.when(effective > 0, 1.0 / effective).alias("sampling_rate_hz"),
        F.when(complete, F.col("_last") - F.col("_first")).alias("duration_seconds"),
        F.coalesce(F.col("_far") > 0.05 * med, F.lit(False)).alias("irregular_intervals"),
        ((F.col("n_rows") >= 2) & complete & (F.col("duplicate_steps") == 0)
         & (F.col("backward_steps") == 0)).alias("valid"),
        F.greatest(F.lit(0.5), 10.0 * med).alias("default_max_gap_seconds"))


def gate(rows: DataFrame, timing: DataFrame, groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of recordings with a complete, strictly increasing clock, and the rest.

    Rows are neither reordered nor filled; the rejected recordings keep their
    counts so that the clock can be corrected at the source.
    """
    from tidegauge.settings import small
    flags = small(timing.select("recording_id", "valid"), groups)
    both = rows.join(flags, "recording_id")
    return both.filter("valid").drop("valid"), both.filter(~F.col("valid")).drop("valid")


def unit_guidance(s: Series, clock: str, names: list[str], column: str, duration: str | None = None) -> DataFrame:
    """Suggested clock unit per recording, or no row when none can be told.

    Verified when the clock span matches a duration column in milliseconds;
    otherwise, for eye data only, the single unit that gives 30 to 2000 Hz.
    """
    low = column.lower()
    none = s.df.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in s.keys)
                                             + ", unit string, confidence string, rate_hz double")
    if any(u in low for u in ("[ms]", "(ms)", "millisecond", "microsecond", "µs", "usec", "nanosecond")):
        return none
    s = s.on(s.df.filter(F.col(clock).isNotNull()))
    s = s.scan(lag={"_pc": F.col(clock)})
    pos = F.when(F.col(clock) > F.col("_pc"), F.col(clock) - F.col("_pc"))
    s = s.with_column("_pos", pos)
    p = F.col("_pos")
    s = s.stats(quantiles={"_med": (p, 0.5), "_q05": (p, 0.05), "_q80": (p, 0.8), "_q99": (p, 0.99)})
    aggs = {"n": F.count(F.lit(1)), "np": F.count(p), "med": F.max("_med"), "q05": F.max("_q05"),
            "q80": F.max("_q80"), "q99": F.max("_q99"), "trim": F.avg(F.when(p <= F.col("_q99"), p)),
            "first": F.min_by(clock, "idx"), "last": F.max_by(clock, "idx")}
    if duration:
        aggs["dur"] = F.min_by(duration, F.when(F.col(duration).isNotNull(), F.col("idx")))
    d = s.summary(aggs).filter((F.col("n") >= 10) & (F.col("np") >= 5))
    quantised = ((F.col("np") > 100) & (F.col("q05") > 0) & (F.col("med") <= 2.05 * F.col("q05"))
                 & (F.col("q80") > 1.35 * F.col("q05")) & (F.col("q99") <= 3.2 * F.col("q05")))
    typical = F.when(quantised, F.col("trim")).otherwise(F.col("med"))
    verified = F.lit(None).cast("string")
    if duration and "recording" in low:
        ratio = (F.col("last") - F.col("first")) / F.when(F.col("dur") > 0, F.col("dur"))
        verified = (F.when((ratio > 950) & (ratio < 1050), "microseconds")
                    .when((ratio > 0.95) & (ratio < 1.05), "milliseconds"))
    guesses = F.array(*[F.struct(F.lit(u).alias("u"), (1.0 / (typical * TIME_UNITS[u])).alias("r"))
                        for u in ("seconds", "milliseconds", "microseconds", "nanoseconds")])
    fits = F.filter(guesses, lambda g: g["r"].between(30, 2000))
    eye = any(w in " ".join(names).lower() for w in ("gaze", "pupil", "eye", "fixation"))
    single = (F.size("_fits") == 1) if eye else F.lit(False)
    out = d.withColumn("_unit", verified).withColumn("_fits", fits).filter(F.col("_unit").isNotNull() | single)
    unit = F.coalesce("_unit", F.col("_fits")[0]["u"])
    return out.select(
        *s.keys, unit.alias("unit"),
        F.when(F.col("_unit").isNotNull(), "verified").otherwise("unverified").alias("confidence"),
        (1.0 / (typical * unit_scale(unit))).alias("rate_hz"))


def preferred_clock(s: Series, clocks: dict[str, Column]) -> DataFrame:
    """(keys, column, valid): the first candidate that is complete and increasing, else the first one.

    ``clocks`` lists the named candidates in order as seconds, NULL where the
    unit is not known; a row number is never one of them.
    """
    names = list(clocks)
    s = s.fan_out("column", {n: {"t": c} for n, c in clocks.items()})
    d = diagnostics(s)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("column"))
    keys = [k for k in s.keys if k != "column"]
    best = F.min_by(F.struct("column", "valid"), F.struct((~F.col("valid")).cast("int"), place))
    return d.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.column", "b.valid")
