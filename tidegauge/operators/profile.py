"""Per-signal and per-recording quality measurements."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.crossprod import EXPRESSIONS, correlation, pair_moments
from tidegauge.functions.scalar import clip, pearson
from tidegauge.functions.series import Series
from tidegauge.functions.spectrum import series_dynamics, spectral_shape, welch

MAD_SCALE = 0.67448975


def _v() -> Column:
    return F.col("value")


def _zero() -> Column:
    return F.lit(0.0)


METRICS = (
    "n", "missing_rate", "longest_missing_run_seconds", "missing_run_p95_seconds", "missing_burstiness",
    "outlier_iqr_rate", "outlier_mad_rate", "skewness", "kurtosis_excess", "lag1_autocorr", "drift_score",
    "local_volatility", "spectral_entropy", "dominant_frequency_ratio", "corr_mean_abs",
)


def fill_by_index(s: Series) -> Series:
    """Column filled: linear by row number, nearest observation at the edges.

    Also leaves p and n, the observations at or around each row.
    """
    here = F.when(_v().isNotNull(), F.struct("idx", "t", "value"))
    s = s.scan(last={"p": here}, first={"n": here})
    p, n = F.col("p"), F.col("n")
    slope = (n["value"] - p["value"]) / (n["idx"] - p["idx"])
    inner = slope * (F.col("idx") - p["idx"]) + p["value"]
    return s.with_column("filled", F.when(_v().isNotNull(), _v()).when(p.isNotNull() & n.isNotNull(), inner)
                         .otherwise(F.coalesce(p["value"], n["value"])))


def fill_columns(s: Series, columns: list[str]) -> Series:
    """The named columns made complete: by row number, then the median, then zero."""
    here = {c: F.when(F.col(c).isNotNull(), F.struct("idx", F.col(c).alias("v"))) for c in columns}
    keep = [c for c in s.df.columns if c not in columns]
    s = s.scan(last={f"_p_{c}": h for c, h in here.items()}, first={f"_n_{c}": h for c, h in here.items()})
    cols = []
    for c in columns:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        inner = (n["v"] - p["v"]) / (n["idx"] - p["idx"]) * (F.col("idx") - p["idx"]) + p["v"]
        # An edge takes the nearest value, so only a column without any value is left; its median is none too.
        cols.append(F.coalesce(F.col(c), inner, p["v"], n["v"], _zero()).alias(c))
    return s.on(s.df.select(*keep, *cols))


def gap_columns(s: Series, fs: Column, rows: str = "n_rows", last_t: str = "last_t") -> Series:
    """At the first row of every gap: its samples and its duration.

    A gap lasts from its first missing sample to the next observed one, or to
    one sampling interval past the end of the recording.
    """
    p, n = F.col("p"), F.col("n")
    starts = _v().isNull() & (F.col("idx") == F.coalesce(p["idx"] + 1, F.lit(0)))
    stop = F.coalesce(n["idx"], F.col(rows))
    stop_t = F.coalesce(n["t"], F.col(last_t) + 1.0 / fs)
    return s.on(s.df.withColumn("gap_samples", F.when(starts, stop - F.col("idx")))
                .withColumn("gap_seconds", F.when(starts, stop_t - F.col("t"))))


def skewness(n: Column, biased: Column) -> Column:
    return F.try_divide(biased * F.sqrt(n * (n - 1)), (n - 2).cast("double"))


def kurtosis(n: Column, biased: Column) -> Column:
    return F.try_divide((n - 1).cast("double"), ((n - 2) * (n - 3)).cast("double")) * ((n + 1) * biased + 6)


def iqr_bounds(q1: Column, q3: Column, factor: float = 1.5) -> tuple[Column, Column]:
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def outside_iqr(x: Column, q1: Column, q3: Column) -> Column:
    low, high = iqr_bounds(q1, q3)
    return ((q3 - q1) > 0) & ((x < low) | (x > high))


def outside_mad(x: Column, med: Column, mad: Column) -> Column:
    return (mad > 0) & (F.abs(F.lit(MAD_SCALE) * (x - med) / F.when(mad > 0, mad)) > 3.5)


def _rate(flag: Column) -> Column:
    return F.coalesce(F.avg(F.when(_v().isNotNull(), flag.cast("double"))), _zero())


def measured(s: Series, fs: Column) -> Series:
    """Rows with everything the profile aggregates over, in one shuffle.

    The running sum is only needed where a series is too long for one array.
    """
    s = fill_by_index(s)
    s = s.stats({"n_rows": F.count(F.lit(1)), "last_t": F.max_by("t", "idx"), "mean_v": F.avg("value")},
                {"q1": (_v(), 0.25), "med": (_v(), 0.5), "q3": (_v(), 0.75)})
    s = s.with_column("dev", F.abs(_v() - F.col("med"))).stats(quantiles={"mad": (F.col("dev"), 0.5)})
    s = gap_columns(s, fs)
    total = {"run": F.col("filled") - F.col("mean_v")} if s.blocked else {}
    return s.scan(lag={"prev_filled": F.col("filled")}, total=total)


def _samples() -> Column:
    """The filled values of a short series in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct("idx", "filled"))), lambda r: r["filled"])


def _dynamics(s: Series, out: DataFrame, spectrum: bool) -> DataFrame:
    """roll_range, spectral_entropy and dominant_frequency_ratio next to the aggregates.

    A series of at most one block comes as the array ``samples`` of the same
    aggregate; longer ones are worked on row by row and segment by segment.
    """
    keys = list(s.keys)
    if not s.blocked:
        return out.select("*", series_dynamics("samples", F.lit(spectrum)).alias("_d")).select(*out.columns, "_d.*").drop("samples")
    out = out.join(rolling_range(s), keys, "left")
    if not spectrum:
        none = F.lit(None).cast("double")
        return out.withColumns({"spectral_entropy": none, "dominant_frequency_ratio": none})
    return out.join(spectral_shape(welch(s.df, keys, "filled", F.col("n_rows")), keys), keys, "left")


def _shape(s: Series) -> DataFrame:
    """Everything that is one aggregate per series."""
    x, prev = F.col("filled"), F.col("prev_filled")
    gaps = F.col("gap_samples")
    return s.summary({
        "n": F.count(F.lit(1)), "valid": F.count("value"),
        "runs": F.count(gaps), "run_max": F.max(gaps), "run_sum": F.sum(gaps), "run_mean": F.avg(gaps),
        "run_seconds": F.max("gap_seconds"),
        "iqr_rate": _rate(outside_iqr(_v(), F.col("q1"), F.col("q3"))),
        "mad_rate": _rate(outside_mad(_v(), F.col("med"), F.col("mad"))),
        "sk": F.skewness("value"), "ku": F.kurtosis("value"), "sd": F.stddev_pop("value"),
        "lag1": pearson(x, prev), "sd_diff": F.stddev_pop(x - prev), "sd_fill": F.stddev_pop(x),
        "sd_fill1": F.stddev_samp(x), **({} if s.blocked else {"samples": _samples()}),
    }, {"run_p95": (F.col("gap_seconds"), 0.95)})


def rolling_range(s: Series) -> DataFrame:
    """Range of the rolling mean whose window is a tenth of the series.

    The window length differs per series, so the mean is a difference of two
    running sums; the earlier sum is moved to the later row and both meet in one
    aggregate keyed by (keys, idx), which never gathers a long series.
    """
    w = F.greatest(F.lit(10), F.floor(F.col("n_rows") / 10))
    both = F.array(F.struct(F.col("idx").alias("i"), F.col("run").alias("a"), _zero().alias("b"), F.col("n_rows").alias("m")),
                   F.struct((F.col("idx") + w).alias("i"), _zero().alias("a"), F.col("run").alias("b"), F.lit(None).cast("long").alias("m")))
    met = (s.df.select(*s.keys, F.explode(both).alias("_r"))
           .groupBy(*s.keys, F.col("_r.i").alias("idx"))
           .agg(F.sum("_r.a").alias("a"), F.sum("_r.b").alias("b"), F.max("_r.m").alias("n_rows"))
           .filter(F.col("n_rows").isNotNull()))
    seen = F.col("idx") + 1
    enough = seen >= F.greatest(F.lit(5), F.floor(w / 3))
    mean = F.when(enough, (F.col("a") - F.col("b")) / F.least(w, seen))
    return met.groupBy(*s.keys).agg((F.max(mean) - F.min(mean)).alias("roll_range"))


def feature_profile(s: Series, fs: Column | float, timing: DataFrame | None = None,
                    corr: DataFrame | None = None, spectrum: bool = True) -> DataFrame:
    """The 15 metrics and zero_variance of every series.

    ``timing`` (one row per recording) blanks the frequency metrics of
    recordings whose clock is invalid or irregular.
    """
    fs = F.lit(float(fs)) if isinstance(fs, (int, float)) else fs
    keys = list(s.keys)
    s = measured(s, fs)
    if s.blocked:
        s = s.cut()
    out = _dynamics(s, _shape(s), spectrum)
    n, few = F.col("n"), F.col("valid") < 4
    v = F.col("valid")

    def full(c: Column) -> Column:
        return F.when(few, _zero()).otherwise(c)

    flat = F.col("sd_fill1") == 0
    burst = clip(0.65 * F.col("run_max") / F.col("run_sum") + 8 * 0.35 * F.col("run_mean") / n, 0, 1)
    quiet = (n < 16) | (F.col("sd_fill") == 0)
    live = F.lit(spectrum)
    out = out.select(
        *keys, n.alias("n"), ((n - v) / n).alias("missing_rate"),
        F.coalesce("run_seconds", _zero()).alias("longest_missing_run_seconds"),
        F.coalesce("run_p95", _zero()).alias("missing_run_p95_seconds"),
        full(F.coalesce(burst, _zero())).alias("missing_burstiness"),
        full(F.col("iqr_rate")).alias("outlier_iqr_rate"), full(F.col("mad_rate")).alias("outlier_mad_rate"),
        full(F.when(F.col("sd") > 0, skewness(v, F.col("sk")))).alias("skewness"),
        full(F.when(F.col("sd") > 0, kurtosis(v, F.col("ku")))).alias("kurtosis_excess"),
        full(F.coalesce("lag1", _zero())).alias("lag1_autocorr"),
        full(F.when((n < 30) | flat, _zero()).otherwise(
            F.coalesce(clip(F.col("roll_range") / (4 * F.col("sd_fill1")), 0, 1), _zero()))).alias("drift_score"),
        full(F.col("sd_diff") / (F.col("sd_fill") + F.lit(1e-12))).alias("local_volatility"),
        F.when(~live, None).when(few | quiet, _zero()).otherwise(F.coalesce("spectral_entropy", _zero())).alias("spectral_entropy"),
        F.when(~live, None).when(few | quiet, _zero())
        .otherwise(F.coalesce("dominant_frequency_ratio", _zero())).alias("dominant_frequency_ratio"),
        F.when(few, True).otherwise(F.col("sd") <= 1e-12).alias("zero_variance"))
    if timing is not None:
        flags = timing.select("recording_id", (F.col("valid") & ~F.col("irregular_intervals")).alias("_steady"))
        out = out.join(flags, "recording_id", "left")
        for c in ("spectral_entropy", "dominant_frequency_ratio"):
            out = out.withColumn(c, F.when(F.col("_steady"), F.col(c)))
        out = out.drop("_steady")
    if corr is None:
        return out.withColumn("corr_mean_abs", _zero())
    return out.join(corr, [k for k in keys if k in corr.columns], "left")


def pairwise_correlation(wide: DataFrame, signals: list[str], keys=("recording_id",)) -> DataFrame:
    """|Pearson| of every pair of signal columns over their common rows, one pass; of many columns by their cross products,
    without rows for pairs that have no common row."""
    pairs = list(combinations(signals, 2))
    if len(signals) > EXPRESSIONS:
        names = F.array(*[F.lit(x) for x in signals])
        m = pair_moments(wide, signals, keys).filter("a < b")
        return m.select(*keys, F.element_at(names, F.col("a") + 1).alias("signal_a"), F.element_at(names, F.col("b") + 1).alias("signal_b"), F.abs(correlation()).alias("r"))
    if not pairs:
        return wide.sparkSession.createDataFrame(
            [], wide.select(*keys).schema.add("signal_a", "string").add("signal_b", "string").add("r", "double"))
    agg = wide.groupBy(*keys).agg(*[F.abs(pearson(F.col(f"`{a}`"), F.col(f"`{b}`"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), F.col(f"c{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return agg.select(*keys, F.inline(rows))


def correlation_matrix(wide: DataFrame, signals: list[str], keys=("recording_id",)) -> DataFrame:
    """Both triangles and the diagonal (shown, not scored)."""
    if len(signals) > EXPRESSIONS:
        names = F.array(*[F.lit(x) for x in signals])
        one, other = F.element_at(names, F.col("a") + 1), F.element_at(names, F.col("b") + 1)
        m = pair_moments(wide, signals, keys).select(*keys, one.alias("x"), other.alias("y"), F.abs(correlation()).alias("r"))
        pair = lambda p, q: F.struct(F.col(p).alias("signal_a"), F.col(q).alias("signal_b"), "r")
        own = F.array(F.struct(F.col("x").alias("signal_a"), F.col("y").alias("signal_b"), F.when(F.col("r").isNotNull(), 1.0).alias("r")))
        return m.select(*keys, F.inline(F.when(F.col("x") == F.col("y"), own).otherwise(F.array(pair("x", "y"), pair("y", "x")))))
    half = pairwise_correlation(wide, signals, keys)
    back = F.array(F.struct("signal_a", "signal_b", "r"),
                   F.struct(F.col("signal_b").alias("signal_a"), F.col("signal_a").alias("signal_b"), F.col("r")))
    both = half.select(*keys, F.inline(back))
    has_spread = wide.groupBy(*keys).agg(*[(F.stddev_pop(f"`{s}`") > 0).alias(f"d{i}") for i, s in enumerate(signals)])
    diag = has_spread.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal_a"), F.lit(s).alias("signal_b"), F.when(F.col(f"d{i}"), 1.0).alias("r"))
        for i, s in enumerate(signals)])))
    return both.unionByName(diag)


def mean_abs_correlation(wide: DataFrame, signals: list[str], keys=("recording_id",)) -> DataFrame:
    """corr_mean_abs per signal; pairs without a correlation are skipped."""
    if len(signals) < 2:
        return wide.select(*keys).distinct().select(*keys, F.lit(signals[0]).alias("signal"), _zero().alias("corr_mean_abs"))
    half = pairwise_correlation(wide, signals, keys)
    ends = half.select(*keys, F.explode(F.array("signal_a", "signal_b")).alias("signal"), "r")
    return ends.groupBy(*keys, "signal").agg(F.avg("r").alias("corr_mean_abs"))


def aggregate_profile(profile: DataFrame, keys=("recording_id",), timing: DataFrame | None = None,
                      resample: bool = False) -> DataFrame:
    """Median and maximum of every metric over the signals of a recording."""
    cols = [F.count(F.lit(1)).alias("n_features")]
    for m in METRICS:
        cols += [F.percentile(m, F.lit(0.5)).alias(m), F.max(F.col(m).cast("double")).alias(f"max_{m}")]
    cols.append(F.avg(F.col("zero_variance").cast("double")).alias("zero_variance_fraction"))
    out = profile.groupBy(*keys).agg(*cols)
    if timing is None:
        return out
    flag = timing.select("recording_id", F.col("irregular_intervals").alias("irregular_timestamps"),
                         (F.col("irregular_intervals") & F.lit(not resample)).alias("smoothing_requires_resampling"))
    return out.join(flag, "recording_id", "left")


def measurements(s: Series, fs: Column | float = 1.0) -> DataFrame:
    """The counts, fences and moments behind the profile of each series."""
    fs = F.lit(float(fs)) if isinstance(fs, (int, float)) else fs
    s = measured(s, fs)
    if s.blocked:
        s = s.cut()
    x, prev, dev = F.col("filled"), F.col("prev_filled"), _v() - F.col("mean_v")
    low, high = iqr_bounds(F.col("q1"), F.col("q3"))
    d = s.summary({
        "samples": F.count(F.lit(1)), "finite_values": F.count("value"),
        "gap_count": F.count("gap_samples"), "longest_gap_samples": F.max("gap_samples"),
        "mean_gap_samples": F.avg("gap_samples"),
        "q1": F.max("q1"), "q3": F.max("q3"), "median": F.max("med"), "mad": F.max("mad"),
        "iqr_lower_bound": F.max(low), "iqr_upper_bound": F.max(high),
        "iqr_flagged": F.count_if(outside_iqr(_v(), F.col("q1"), F.col("q3"))),
        "mad_flagged": F.count_if(outside_mad(_v(), F.col("med"), F.col("mad"))),
        "central_moment_2": F.avg(dev * dev), "central_moment_3": F.avg(dev * dev * dev),
        "central_moment_4": F.avg(dev * dev * dev * dev),
        "sample_std": F.stddev_samp(x), "population_std": F.stddev_pop(x), "difference_std": F.stddev_pop(x - prev),
        **({} if s.blocked else {"samples_": _samples()}),
    }, {"p95_gap_samples": (F.col("gap_samples"), 0.95)})
    if s.blocked:
        d = d.join(rolling_range(s), list(s.keys), "left")
    else:
        d = d.withColumn("roll_range", series_dynamics("samples_", F.lit(False))["roll_range"])
    few = F.col("finite_values") < 4
    return d.select(
        *s.keys, "samples", "finite_values", (F.col("samples") - F.col("finite_values")).alias("missing_values"),
        "gap_count", F.coalesce("longest_gap_samples", F.lit(0)).alias("longest_gap_samples"),
        F.coalesce("mean_gap_samples", _zero()).alias("mean_gap_samples"),
        F.coalesce("p95_gap_samples", _zero()).alias("p95_gap_samples"),
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "median", "mad", "iqr_lower_bound", "iqr_upper_bound",
        F.when(few, 0).otherwise(F.col("iqr_flagged")).alias("iqr_flagged"),
        F.when(few, 0).otherwise(F.col("mad_flagged")).alias("mad_flagged"),
        "central_moment_2", "central_moment_3", "central_moment_4",
        F.greatest(F.lit(10), F.floor(F.col("samples") / 10)).alias("rolling_window_samples"),
        F.col("roll_range").alias("rolling_mean_range"), "sample_std", "population_std", "difference_std")


def box_stats(s: Series) -> DataFrame:
    """Quartiles and whiskers (outermost observations inside the fences)."""
    s = s.stats(quantiles={"q1": (_v(), 0.25), "med": (_v(), 0.5), "q3": (_v(), 0.75)})
    low, high = iqr_bounds(F.col("q1"), F.col("q3"))
    return s.summary({
        "q1": F.max("q1"), "median": F.max("med"), "q3": F.max("q3"),
        "whisker_low": F.min(F.when(_v() >= low, _v())), "whisker_high": F.max(F.when(_v() <= high, _v()))})


def histogram(s: Series, bins: int = 45) -> DataFrame:
    """Counts in equally wide bins between the smallest and largest value."""
    s = s.stats({"_lo": F.min("value"), "_hi2": F.max("value")})
    width = (F.col("_hi2") - F.col("_lo")) / bins
    bin_no = F.when(width > 0, F.least(F.floor((_v() - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(F.lit(0))
    return (s.df.filter(_v().isNotNull())
            .groupBy(*s.keys, bin_no.cast("long").alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.max(F.col("_lo")).alias("low"), F.max(width).alias("width")))


def signal_overview(s: Series, points: int = 48) -> DataFrame:
    """Availability, range and up to 48 evenly spaced preview values per signal."""
    s = s.stats({"n_rows": F.count(F.lit(1))})
    take = evenly(F.col("idx"), F.col("n_rows"), points)
    low, high = F.min("value"), F.max("value")
    return s.summary({
        "available_pct": F.round(100 * F.avg(_v().isNotNull().cast("double")), 1),
        "missing": F.count_if(_v().isNull()), "low": low, "high": high,
        "preview": F.transform(F.sort_array(F.collect_list(F.when(take, F.struct("idx", "value")))), lambda r: r["value"]),
    })


def evenly(idx: Column, rows: Column, points: Column | int) -> Column:
    """True for the rows picked by ``points`` evenly spaced positions, ends included.

    Position j is floor(j (rows - 1) / (points - 1)). A row is picked when some j
    lands on it; the row itself tells the only j that can, up to rounding.
    """
    points = F.lit(points) if isinstance(points, int) else points
    step = (rows - 1) / F.when(points > 1, (points - 1).cast("double"))
    near = F.round(idx / F.when(step > 0, step))
    last = idx == rows - 1

    def lands(j: Column) -> Column:
        return (F.floor(j * step) == idx) & (j >= 0) & (j < points - 1)

    hit = lands(near - 1) | lands(near) | lands(near + 1)
    return F.when(rows <= points, True).when(points == 1, idx == 0).otherwise(F.coalesce(hit, F.lit(False)) | last)
