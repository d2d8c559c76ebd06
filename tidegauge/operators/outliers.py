"""Outlier handling: flagged samples become missing, or the tails are clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import isclose
from tidegauge.functions.series import Series
from tidegauge.operators.profile import fill_by_index, iqr_bounds, outside_iqr, outside_mad

MIN_SAMPLES = 8
STATISTICAL = ("zscore", "iqr", "mad", "winsorize")


def with_limits(s: Series, methods) -> Series:
    """The statistics the methods need, next to every row."""
    v = F.col("value")
    aggs, quants = {"_nv": F.count("value")}, {}
    if "zscore" in methods:
        aggs.update(_mean=F.avg("value"), _std=F.stddev_pop("value"))
    if "iqr" in methods:
        quants.update(_q1=(v, 0.25), _q3=(v, 0.75))
    if "mad" in methods:
        quants.update(_med=(v, 0.5))
    if "winsorize" in methods:
        quants.update(_lo=(v, 0.01), _hi99=(v, 0.99))
    s = s.stats(aggs, quants)
    if "mad" in methods:
        s = s.with_column("_dev", F.abs(v - F.col("_med"))).stats(quantiles={"_mad": (F.col("_dev"), 0.5)})
    return s


def flags(method: str) -> Column:
    """True where the method flags the observation; never on a missing one."""
    v = F.col("value")
    rules = {
        "none": lambda: F.lit(False),
        "zscore": lambda: (F.col("_std") > 0)
        & (F.abs(v - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")) > 3),
        "iqr": lambda: outside_iqr(v, F.col("_q1"), F.col("_q3")),
        "mad": lambda: outside_mad(v, F.col("_med"), F.col("_mad")),
        "winsorize": lambda: ~isclose(clamped(), v),
        "isolation_forest": lambda: F.col("row_flag"),
    }
    rule = rules[method]()
    if method in ("zscore", "iqr", "mad"):
        rule = (F.col("_nv") >= MIN_SAMPLES) & rule
    return F.coalesce(rule, F.lit(False))


def clamped() -> Column:
    v = F.col("value")
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_lo")), F.col("_hi99")))


def cleaned(method: str) -> Column:
    """The value after the method."""
    if method == "none":
        return F.col("value")
    if method == "winsorize":
        return clamped()
    return F.when(~flags(method), F.col("value"))


def handle(s: Series, methods, row_flags: DataFrame | None = None) -> Series:
    """Columns out_<method> and flag_<method> for every method, from one set of windows.

    ``row_flags`` (recording_id, idx, row_flag) comes from the isolation forest
    and flags all signals of a row.
    """
    temps = [c for c in s.df.columns]
    if "isolation_forest" in methods:
        if row_flags is None:
            raise ValueError("isolation_forest needs row_flags")
        on = [c for c in row_flags.columns if c != "row_flag"]
        s = s.on(s.df.join(row_flags, on, "left"))
    s = with_limits(s, methods)
    cols = [cleaned(m).alias("out_" + m) for m in methods] + [flags(m).alias("flag_" + m) for m in methods]
    return s.on(s.df.select(*temps, *cols))


def refill(s: Series) -> Series:
    """Benchmark semantics: gaps left by the stage are interpolated, then set to the median."""
    s = fill_by_index(s).stats(quantiles={"_m": (F.col("value"), 0.5)})
    return s.on(s.df.withColumn("value", F.coalesce("filled", "_m")).drop("filled", "p", "n", "_m"))


def audit(s: Series, methods=("zscore", "iqr", "mad", "winsorize")) -> DataFrame:
    """Per series: the statistics and limits of each method and what came of it."""
    s = with_limits(s, methods)
    low, high = iqr_bounds(F.col("_q1"), F.col("_q3"))
    d = s.summary({
        "available": F.count("value"), "mean": F.max("_mean"), "std": F.max("_std"),
        "q1": F.max("_q1"), "q3": F.max("_q3"), "lower": F.max(low), "upper": F.max(high),
        "median": F.max("_med"), "mad": F.max("_mad"), "winsor_low": F.max("_lo"), "winsor_high": F.max("_hi99"),
        **{f"flagged_{m}": F.count_if(flags(m)) for m in methods}})

    def status(ok: Column) -> Column:
        return (F.when(F.col("available") < MIN_SAMPLES, "skipped_insufficient_observations")
                .when(ok, "applied").otherwise("no_spread"))

    return (d.withColumn("zscore_status", status(F.col("std") > 0)).withColumn("iqr_status", status(F.col("q3") > F.col("q1")))
            .withColumn("mad_status", status(F.col("mad") > 0)))
