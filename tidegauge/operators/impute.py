"""Imputation per signal; only gaps with observations on both sides are filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.series import Series

PER_SIGNAL = ("mean", "median", "locf", "linear")
CROSS_SIGNAL = ("knn", "mice")


def eligible(max_gap: float | Column | None) -> Column:
    """Between two observations at most max_gap seconds apart (any distance when None)."""
    p, n = F.col("p"), F.col("n")
    inside = p.isNotNull() & n.isNotNull()
    if max_gap is None:
        return inside
    return inside & (n["t"] - p["t"] <= F.lit(max_gap) + F.lit(1e-12))


def with_anchors(s: Series) -> Series:
    here = F.when(F.col("value").isNotNull(), F.struct("idx", "t", "value"))
    return s.scan(last={"p": here}, first={"n": here})


def impute(s: Series, methods, max_gap: float | None = None, semantics: str = "app",
           estimates: dict[str, DataFrame] | None = None) -> Series:
    """Column imp_<method> for every method, from one forward and one backward pass.

    ``estimates`` holds (keys, idx, estimate) of the cross-signal methods.
    With semantics "bench" boundary gaps are filled too and linear goes by row.
    """
    keep = list(s.df.columns)
    for m in methods:
        if m in CROSS_SIGNAL:
            e = estimates[m].withColumnRenamed("estimate", "_e_" + m)
            s = s.on(s.df.join(e, [*s.keys, "idx"], "left"))
    s = with_anchors(s)
    v, p, n = F.col("value"), F.col("p"), F.col("n")
    if "mean" in methods:
        s = s.stats({"_mean": F.avg("value")})
    if "median" in methods:
        s = s.stats(quantiles={"_median": (v, 0.5)})
    rise = n["value"] - p["value"]
    by_time = F.try_divide(rise, n["t"] - p["t"]) * (F.col("t") - p["t"]) + p["value"]
    by_row = F.try_divide(rise, (n["idx"] - p["idx"]).cast("double")) * (F.col("idx") - p["idx"]) + p["value"]
    bench = semantics == "bench"
    guess = {
        "none": F.lit(None).cast("double"), "mean": lambda: F.col("_mean"), "median": lambda: F.col("_median"),
        "locf": lambda: F.coalesce(p["value"], n["value"]) if bench else p["value"],
        "linear": lambda: F.coalesce(by_row, p["value"], n["value"]) if bench else by_time,
        "knn": lambda: F.col("_e_knn"), "mice": lambda: F.col("_e_mice"),
    }
    allowed = F.lit(True) if bench else eligible(max_gap)
    cols = []
    for m in methods:
        g = guess[m]() if callable(guess[m]) else guess[m]
        cols.append((v if m == "none" else F.coalesce(v, F.when(allowed, g))).alias("imp_" + m))
    return s.on(s.df.select(*keep, *cols))


def gap_limits(s: Series, max_gap: float) -> DataFrame:
    """Per series: missing samples, those within the limit, and those that stay missing."""
    s = with_anchors(s)
    missing = F.col("value").isNull()
    ok = eligible(max_gap)
    return s.summary({
        "missing": F.count_if(missing), "fillable": F.count_if(missing & F.coalesce(ok, F.lit(False))),
        "boundary": F.count_if(missing & (F.col("p").isNull() | F.col("n").isNull()))})
