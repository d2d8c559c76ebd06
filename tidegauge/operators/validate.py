"""Reconstruction error and loss of processed series against their clean reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.domains import LOSS_PARTS, LOSS_WEIGHTS
from tidegauge.functions.scalar import clip, isclose, squash
from tidegauge.functions.series import Series, ordered_index
from tidegauge.functions.spectrum import welch
from tidegauge.operators.profile import fill_columns, kurtosis, skewness

TINY = 1e-12


def _rms(diff: Column, where: Column) -> Column:
    return F.sqrt(F.avg(F.when(where, diff * diff)))


def unit_of(name: Column) -> Column:
    """Unit in brackets of a signal name."""
    unit = F.regexp_extract(name, r"\[([^\]]+)\]", 1)
    return F.when(unit != "", unit).otherwise("original units")


def reconstruction_rmse(rows: DataFrame, keys) -> DataFrame:
    """Error over all, damaged and intact samples, and how much of the reference is covered.

    ``rows`` has clean, value and mask. Gaps are never filled for scoring: a
    share without any pair has no error.
    """
    c, v, m = F.col("clean"), F.col("value"), F.col("mask")
    known, pair = c.isNotNull(), c.isNotNull() & v.isNotNull()
    d = v - c
    out = rows.groupBy(*keys).agg(
        _rms(d, pair).alias("rmse"), _rms(d, pair & m).alias("affected_rmse"), _rms(d, pair & ~m).alias("intact_rmse"),
        F.count_if(known).alias("reference_samples"), F.count_if(known & m).alias("affected_samples"),
        F.count_if(known & ~m).alias("intact_samples"), F.count_if(pair).alias("_pairs"), F.count_if(pair & m).alias("_apairs"))
    ref, aff = F.col("reference_samples"), F.col("affected_samples")
    return out.select(
        *keys, "rmse", "affected_rmse", "intact_rmse",
        F.when(ref > 0, F.col("_pairs") / ref).otherwise(0.0).alias("coverage"),
        F.when(aff > 0, F.col("_apairs") / aff).alias("affected_coverage"),
        (ref - F.col("_pairs")).alias("remaining_missing"), "reference_samples", "affected_samples", "intact_samples",
        ((ref > 0) & (F.col("_pairs") == ref)).alias("complete"))


def rank_candidates(scores: DataFrame, by=("recording_id", "signal"), tie=()) -> DataFrame:
    """Rank by rmse, missing scores last; the winner is the best complete candidate."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*by).orderBy(F.asc_nulls_last("rmse"), *tie)
    best = W.partitionBy(*by).orderBy((~F.col("complete")).cast("int"), F.asc_nulls_last("rmse"), *tie)
    first = (F.row_number().over(best) == 1) & F.col("complete") & F.col("rmse").isNotNull()
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("winner", first)


def align(clean: Series, noisy: Series, min_rows: int = 32) -> DataFrame:
    """Sample-aligned pairs of two recordings by position, on their common rows.

    ``usable`` marks series with at least 32 pairs and a complete reference.
    """
    keys = list(clean.keys)
    a = clean.df.select(*keys, "idx", F.col("value").alias("clean"))
    b = noisy.df.select(*keys, "idx", "t", "value")
    both = a.join(b, [*keys, "idx"]).withColumn("mask", ~isclose(F.col("clean"), F.col("value")))
    s = Series(both, clean.keys, clean.longest, clean.groups, clean.block)
    s = s.stats({"_n": F.count(F.lit(1)), "_ok": F.count("clean")})
    return s.df.withColumn("usable", (F.col("_n") >= min_rows) & (F.col("_ok") == F.col("_n"))).drop("_n", "_ok")


def wasserstein(s: Series, a: str, b: str) -> DataFrame:
    """Distance between the distributions of two complete columns of equal length.

    For equal sizes the mean distance of equally ranked values is the area
    between the two step functions. It is summed over distinct values, which
    are counted before anything is ordered, so a value that repeats weighs nothing.
    """
    pair = F.array(F.struct(F.lit(1).alias("w"), F.col(a).alias("v")), F.struct(F.lit(-1).alias("w"), F.col(b).alias("v")))
    points = (s.df.select(*s.keys, F.explode(pair).alias("_p")).groupBy(*s.keys, F.col("_p.v").alias("_v"))
              .agg(F.sum("_p.w").cast("double").alias("_d"), F.sum((F.col("_p.w") > 0).cast("long")).alias("_c")))
    longest = 2 * s.longest
    points = ordered_index(points, s.keys, ["_v"], F.col("_v"), longest, s.groups, s.block)
    steps = Series(points, s.keys, longest, s.groups, s.block).scan(total={"_level": F.col("_d")}, lead={"_next": F.col("_v")})
    area = F.abs("_level") * (F.col("_next") - F.col("_v"))
    return steps.summary({"_area": F.sum(area), "_n": F.sum("_c")}).select(
        *s.keys, (F.coalesce("_area", F.lit(0.0)) / F.col("_n")).alias("wasserstein"))


def spectral_divergence(s: Series, a: str, b: str) -> DataFrame:
    """Squared Jensen-Shannon distance (base 2) of two Welch spectra; 0 under 16 samples."""
    keys = list(s.keys)
    if "n_rows" not in s.df.columns:
        s = s.stats({"n_rows": F.count(F.lit(1))})
    pa = welch(s.df, keys, a, F.col("n_rows")).withColumnRenamed("power", "pa")
    pb = welch(s.df, keys, b, F.col("n_rows")).withColumnRenamed("power", "pb")
    both = pa.join(pb, [*keys, "bin"]).groupBy(*keys).agg(F.collect_list(F.struct("pa", "pb")).alias("_s"))  # at most 129 bins

    def total(f) -> Column:
        return F.aggregate(F.transform("_s", f), F.lit(0.0), lambda x, y: x + y)

    both = both.withColumn("_ta", total(lambda r: r["pa"])).withColumn("_tb", total(lambda r: r["pb"]))
    p = lambda r: r["pa"] / (F.col("_ta") + TINY) + TINY
    q = lambda r: r["pb"] / (F.col("_tb") + TINY) + TINY
    both = both.withColumn("_za", total(p)).withColumn("_zb", total(q))

    def half(own, x: Column, y: Column) -> Column:
        return own * F.ln(own / ((x + y) / 2))

    js = total(lambda r: half(p(r) / F.col("_za"), p(r) / F.col("_za"), q(r) / F.col("_zb"))
               + half(q(r) / F.col("_zb"), p(r) / F.col("_za"), q(r) / F.col("_zb")))
    return both.select(*keys, (F.greatest(F.lit(0.0), js) / (2 * F.ln(F.lit(2.0)))).alias("spectral_js"))


def signal_losses(s: Series, event: str | None = None) -> DataFrame:
    """Six squashed loss parts per series, from clean, value and mask."""
    keys = list(s.keys)
    s = s.on(s.df.withColumn("y", F.col("clean")).withColumn("z", F.col("value")))
    s = fill_columns(s, ["y", "z"]).stats({"n_rows": F.count(F.lit(1))})
    s = s.scan(lag={"_py": F.col("y"), "_pz": F.col("z")}, lead={"_ny": F.col("y"), "_nz": F.col("z")})
    s = s.cut()  # read by the sums, the distribution distance and both spectra
    y, z, m = F.col("y"), F.col("z"), F.col("mask")
    dy, dz = y - F.col("_py"), z - F.col("_pz")
    # A change at the first sample is measured to the second one.
    ey = F.abs(F.coalesce(dy, F.col("_ny") - y))
    ez = F.abs(F.coalesce(dz, F.col("_nz") - z))
    ev = F.lit(False) if event is None else F.coalesce(F.col(event), F.lit(False))
    d = s.summary({
        "n": F.count(F.lit(1)), "sd": F.stddev_pop(y), "sd_z": F.stddev_pop(z),
        "rec": _rms(z - y, m), "harm": _rms(z - y, ~m), "dyn": F.sqrt(F.avg((dz - dy) * (dz - dy))), "sd_dy": F.stddev_pop(dy),
        "sk_y": F.skewness(y), "sk_z": F.skewness(z), "ku_y": F.kurtosis(y), "ku_z": F.kurtosis(z),
        "e_y": F.avg(F.when(ev, ey)), "e_z": F.avg(F.when(ev, ez))})
    d = d.join(wasserstein(s, "y", "z"), keys).join(spectral_divergence(s, "y", "z"), keys, "left")
    n, scale = F.col("n"), F.col("sd") + TINY
    live = (F.col("sd") > 0) & (F.col("sd_z") > 0)
    dsk = F.when(live, F.abs(skewness(n, F.col("sk_z")) - skewness(n, F.col("sk_y"))))
    dku = F.when(live, F.abs(kurtosis(n, F.col("ku_z")) - kurtosis(n, F.col("ku_y"))))
    dist = 0.55 * squash(F.col("wasserstein") / scale) + 0.20 * squash(dsk) + 0.25 * squash(dku / 3)
    event_loss = F.abs(F.ln((F.col("e_z") + TINY) / (F.col("e_y") + TINY)))
    return d.select(
        *keys, squash(F.coalesce(F.col("rec") / scale, F.lit(0.0))).alias("reconstruction"),
        squash(F.coalesce(F.col("harm") / scale, F.lit(0.0))).alias("clean_harm"),
        squash(F.col("dyn") / (F.col("sd_dy") + TINY)).alias("dynamics"), clip(dist, 0, 1).alias("distribution"),
        F.when(n < 16, 0.0).otherwise(clip(F.col("spectral_js"), 0, 1)).alias("frequency"),
        F.when(F.col("e_y").isNotNull(), squash(event_loss)).alias("event"))


def detection(rows: DataFrame, keys) -> DataFrame:
    """Precision, recall and F1 of detected against mask, pooled over signals; empty denominators count as 1."""
    m, p = F.col("mask"), F.coalesce(F.col("detected"), F.lit(False))
    d = rows.groupBy(*keys).agg(F.count_if(m & p).alias("tp"), F.count_if(~m & p).alias("fp"), F.count_if(m & ~p).alias("fn"))
    tp = F.col("tp")
    d = (d.withColumn("det_precision", F.when(tp + F.col("fp") > 0, tp / (tp + F.col("fp"))).otherwise(1.0))
         .withColumn("det_recall", F.when(tp + F.col("fn") > 0, tp / (tp + F.col("fn"))).otherwise(1.0)))
    both = F.col("det_precision") + F.col("det_recall")
    d = d.withColumn("det_f1", F.when(both > 0, 2 * F.col("det_precision") * F.col("det_recall") / both).otherwise(0.0))
    return d.withColumn("detection", 1 - F.col("det_f1")).drop("tp", "fp", "fn")


def losses(s: Series, detectable: bool = False, event: str | None = None) -> DataFrame:
    """Loss parts per recording (and candidate): means over signals, detection and retention."""
    keys = [k for k in s.keys if k != "signal"]
    per = signal_losses(s, event)
    names = LOSS_PARTS[:6]
    out = per.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])
    kept = s.df.groupBy(*keys).agg(F.avg(F.col("value").isNull().cast("double")).alias("retention"))
    out = out.join(kept, keys)
    if detectable:
        return out.join(detection(s.df, keys), keys)
    for c in ("det_precision", "det_recall", "det_f1", "detection"):
        out = out.withColumn(c, F.lit(None).cast("double"))
    return out


def weighted_loss(parts: DataFrame, domain: str, name: str = "loss") -> DataFrame:
    """Weighted mean over the parts that are known and count in the domain."""
    weights = dict(zip(LOSS_PARTS, LOSS_WEIGHTS[domain]))
    active = {k: w for k, w in weights.items() if w > 0 and k in parts.columns}
    zero = F.lit(0.0)
    top = sum((F.when(F.col(k).isNotNull(), w * F.col(k)).otherwise(zero) for k, w in active.items()), zero)
    total = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(zero) for k, w in active.items()), zero)
    return parts.withColumn(name, F.when(total > 0, top / F.when(total > 0, total)))


def signal_errors(rows: DataFrame, keys) -> DataFrame:
    """rmse, sd of the clean signal, cells and missing cells (gone) per signal."""
    c, v = F.col("clean"), F.col("value")
    return rows.groupBy(*keys, "signal").agg(
        F.sqrt(F.avg((v - c) * (v - c))).alias("rmse"), F.stddev_pop(c).alias("sd"),
        F.count(F.lit(1)).alias("cells"), F.count_if(v.isNull()).alias("gone"))


def nrmse(rows: DataFrame, keys, signals=()) -> DataFrame:
    """Mean over signals of RMSE / spread, and both per named signal; unavailable when any output is missing."""
    return overall_error(signal_errors(rows, keys), keys, signals)


def overall_error(per: DataFrame, keys, signals=(), more=()) -> DataFrame:
    """The same from the errors per signal, and `more` aggregates of the same rows."""
    relative = F.col("rmse") / (F.col("sd") + TINY)
    each = {f"{name}_{x}": F.max(F.when(F.col("signal") == x, e)) for name, e in (("nrmse", relative), ("rmse", F.col("rmse"))) for x in signals}
    out = per.groupBy(*keys).agg(
        F.avg(relative).alias("nrmse"), F.avg("rmse").alias("mean_raw_rmse"), *[e.alias(n) for n, e in each.items()],
        (F.sum("gone") / F.sum("cells")).alias("remaining_missing_fraction"), *more)
    valid = F.col("remaining_missing_fraction") == 0
    return out.withColumns({n: F.when(valid, F.col(n)) for n in ("nrmse", "mean_raw_rmse", *each)}).withColumn("valid_rmse", valid)
