"""Four cleaning stages over all recordings: outlier, imputation, scaling, smoothing.

A stage takes one method, several at once (each series is then copied per method
and keyed by it, so later stages share everything before them), or a column that
names the method of each recording.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.domains import IMPUTATION_FIRST, LEGACY_ORDERS, METHODS, OUTLIER_FIRST
from tidegauge.functions.scalar import isclose, wide_form
from tidegauge.functions.series import Series
from tidegauge.operators import forest, knn, mice, scale, smooth
from tidegauge.operators.impute import CROSS_SIGNAL, impute
from tidegauge.operators.outliers import handle, refill
from tidegauge.operators.profile import aggregate_profile, feature_profile

STAGES = ("outlier", "imputation", "scaling", "smoothing")


@dataclass(frozen=True)
class Settings:
    """How stages treat time: gap limit, clock regularity, resampling; and their semantics."""

    signals: tuple[str, ...]
    max_gap: float | None = None
    irregular: str | None = None  # boolean column
    resample: bool = False
    fs: str | None = None  # column with the sampling rate
    semantics: str = "app"
    seed: int = 42


def order_of(name: str) -> str:
    name = LEGACY_ORDERS.get(name, name)
    if name not in (OUTLIER_FIRST, IMPUTATION_FIRST):
        raise ValueError(f"unknown order {name!r}")
    return name


def check_methods(methods: dict[str, list[str]]) -> None:
    for stage, names in methods.items():
        for m in names:
            if m not in METHODS[stage]:
                raise ValueError(f"unknown {stage} method {m!r}")


def rows_of(s: Series, signals) -> Series:
    """The long series as wide rows; the recording's rows stay together."""
    keys = tuple(k for k in s.keys if k != "signal")
    df = wide_form(s.df, list(signals), [*keys, "idx"])
    return Series(df, keys, s.longest, max(1, s.groups // max(1, len(signals))), s.block)


def _choose(s: Series, stage: str, methods: list[str], columns: dict[str, dict[str, Column]], by: str | None) -> Series:
    """Take the single method, copy per method, or follow the column ``by``."""
    if by is not None:
        into = list(next(iter(columns.values())))
        picked = {}
        for c in into:
            e = F.lit(None)
            for m in methods:
                e = F.when(F.col(by) == m, columns[m][c]).otherwise(e)
            picked[c] = e
        return s.on(s.df.withColumns(picked))
    if len(methods) == 1:
        return s.on(s.df.withColumns(columns[methods[0]]))
    return s.fan_out(stage, columns)


def _narrow(s: Series, keep: list[str]) -> Series:
    extra = [k for k in s.keys if k not in keep]
    return s.on(s.df.select(*keep, *extra))


def outlier_stage(s: Series, methods: list[str], st: Settings, by: str | None = None) -> Series:
    """Sets value and detected."""
    keep = [c for c in s.df.columns if c != "detected"]
    rows = None
    if "isolation_forest" in methods:
        part = s if by is None else s.on(s.df.filter(F.col(by) == "isolation_forest"))
        rows = forest.row_flags(rows_of(part, st.signals), list(st.signals), st.seed)
    s = handle(s, methods, rows)
    s = _choose(s, "outlier", methods, {m: {"value": F.col("out_" + m), "detected": F.col("flag_" + m)} for m in methods}, by)
    s = _narrow(s, [*keep, "detected"])
    if st.semantics == "bench" and methods != ["none"]:
        none = F.col("outlier") == "none" if "outlier" in s.keys else F.lit(False)
        before = s.with_column("_kept", F.col("value"))
        s = refill(before)
        wins = F.col("outlier") == "winsorize" if "outlier" in s.keys else F.lit(methods == ["winsorize"])
        s = s.on(s.df.withColumn("value", F.when(none | wins, F.col("_kept")).otherwise(F.col("value"))).drop("_kept"))
    return s


def imputation_stage(s: Series, methods: list[str], st: Settings, by: str | None = None) -> Series:
    keep = list(s.df.columns)
    estimates = {}
    for m in (m for m in methods if m in CROSS_SIGNAL):
        part = s if by is None else s.on(s.df.filter(F.col(by) == m))
        wide = rows_of(part, st.signals)
        estimates[m] = (knn.estimates(wide, list(st.signals), scaled=st.semantics != "bench") if m == "knn"
                        else mice.estimates(wide, list(st.signals)))
    s = impute(s, methods, st.max_gap, st.semantics, estimates)
    s = _choose(s, "imputation", methods, {m: {"value": F.col("imp_" + m)} for m in methods}, by)
    return _narrow(s, keep)


def scaling_stage(s: Series, methods: list[str], by: str | None = None) -> Series:
    """Sets value, center and width."""
    keep = [c for c in s.df.columns if c not in ("center", "width")]
    columns = {}
    for m in methods:
        s = scale.with_scaler(s, m)
        s = s.on(s.df.withColumnRenamed("center", "_c_" + m).withColumnRenamed("width", "_w_" + m))
        c, w = F.col("_c_" + m), F.col("_w_" + m)
        columns[m] = {"value": F.col("value") if m == "none" else (F.col("value") - c) / w, "center": c, "width": w}
    return _narrow(_choose(s, "scaling", methods, columns, by), [*keep, "center", "width"])


def smoothing_stage(s: Series, methods: list[str], st: Settings, by: str | None = None) -> Series:
    keep = list(s.df.columns)
    irregular = None if st.irregular is None else F.col(st.irregular)
    if by is not None and irregular is not None:
        irregular = irregular & (F.col(by) != "none")
    fs = None if st.fs is None else F.col(st.fs)
    if st.semantics == "bench" and methods != ["none"]:
        # The benchmark filters across gaps, on a series completed by interpolation.
        from tidegauge.operators.profile import fill_by_index
        s = fill_by_index(s)
        raw = s.on(s.df.withColumn("_gap", F.col("value")).withColumn("value", F.col("filled")).drop("filled", "p", "n"))
        s = smooth.smooth(raw, methods, None, None, False, fs, "bench")
        s = s.on(s.df.withColumn("smo_none", F.col("_gap")) if "none" in methods else s.df)
    else:
        s = smooth.smooth(s, methods, st.max_gap, irregular, st.resample, fs, only=by)
    s = _choose(s, "smoothing", methods, {m: {"value": F.col("smo_" + m)} for m in methods}, by)
    return _narrow(s, keep)


def execute(s: Series, methods: dict[str, list[str]], order: str, st: Settings, by: dict[str, str] | None = None) -> Series:
    """Columns raw, after_<stage>, detected, value (processed) and physical (scaling undone).

    ``methods`` lists the methods per stage; ``by`` names, per stage, the column
    that holds each recording's method.
    """
    check_methods(methods)
    by = by or {}
    base = list(s.df.columns)
    s = s.with_column("raw", F.col("value")).with_column("detected", F.lit(False))
    first = ("outlier", "imputation") if order_of(order) == OUTLIER_FIRST else ("imputation", "outlier")
    for stage in (*first, "scaling", "smoothing"):
        names = methods.get(stage, ["none"])
        if stage == "outlier":
            s = outlier_stage(s, names, st, by.get(stage))
        elif stage == "imputation":
            s = imputation_stage(s, names, st, by.get(stage))
        elif stage == "scaling":
            s = scaling_stage(s, names, by.get(stage))
        else:
            s = smoothing_stage(s, names, st, by.get(stage))
        s = s.with_column("after_" + stage, F.col("value"))
        if s.blocked and names != ["none"]:
            s = s.cut()
    s = s.with_column("physical", scale.restored(F.col("value")))
    extra = [k for k in s.keys if k not in base]
    return s.on(s.df.select(*base, *extra, "raw", "detected", *["after_" + x for x in STAGES], "physical", "center", "width"))


def run_one(s: Series, spec: dict[str, str], order: str, st: Settings) -> Series:
    return execute(s, {stage: [spec.get(stage, "none")] for stage in STAGES}, order, st)


def differs(a: str, b: str) -> Column:
    """Whether the cells differ beyond tolerance."""
    return ~isclose(F.col(a), F.col(b))


def _path(order: str) -> list[tuple[str, str]]:
    """(stage, column before it) in execution order."""
    first = ("outlier", "imputation") if order_of(order) == OUTLIER_FIRST else ("imputation", "outlier")
    names = [*first, "scaling", "smoothing"]
    return [(st, "raw" if i == 0 else "after_" + names[i - 1]) for i, st in enumerate(names)]


def _differences(order: str) -> dict[str, Column]:
    return {**{st + "_changed_fraction": differs(before, "after_" + st) for st, before in _path(order)},
            "cleaning_changed_fraction": differs("raw", "physical"), "overall_changed_fraction": differs("raw", "value")}


def stage_changes(s: Series, order: str) -> DataFrame:
    """Changed fraction of every stage, of the cleaning, the scaling and overall, per recording."""
    keys = [k for k in s.keys if k != "signal"]
    return s.df.groupBy(*keys).agg(*[F.avg(c.cast("double")).alias(n) for n, c in _differences(order).items()])


def stage_metrics(s: Series, order: str) -> DataFrame:
    """What each stage did per recording: shares filled and flagged, and the scaled range."""
    return _stage_facts(s, order, {})


def _stage_facts(s: Series, order: str, shares: dict[str, Column]) -> DataFrame:
    """stage_metrics and the shares of rows where a condition holds, from one pass: per signal, then per recording."""
    keys = [k for k in s.keys if k != "signal"]
    before = dict(_path(order))
    filled = F.col(before["imputation"]).isNull() & F.col("after_imputation").isNotNull()
    hit = F.col("detected") & F.col(before["outlier"]).isNotNull()
    shares = {"imputed_fraction": filled, "outlier_affected_fraction": hit, "remaining_missing_fraction": F.col("value").isNull(), **shares}
    each = s.df.groupBy(*s.keys).agg(
        *[F.sum(c.cast("double")).alias(n) for n, c in shares.items()], *[F.count(c).alias("_n_" + n) for n, c in shares.items()],
        F.min("after_scaling").alias("lo"), F.max("after_scaling").alias("hi"), F.stddev_pop("after_scaling").alias("sd"))
    out = each.groupBy(*keys).agg(
        *[F.try_divide(F.sum(n), F.sum("_n_" + n)).alias(n) for n in shares], F.percentile("lo", F.lit(0.5)).alias("scaled_min_median"),
        F.percentile("hi", F.lit(0.5)).alias("scaled_max_median"), F.percentile("sd", F.lit(0.5)).alias("scaled_std_median"))
    return out.dropna(subset=keys)  # rows without a recording belong to none


def smoothing_volatility(s: Series, order: str) -> DataFrame:
    """Median local volatility over the signals before and after smoothing, and the difference, per recording."""
    from tidegauge.operators.profile import fill_by_index
    base = s.on(s.df.select(*s.keys, "idx", "t", dict(_path(order))["smoothing"], "after_smoothing", F.lit(None).cast("double").alias("value")))
    both = fill_by_index(base.fan_out("side", {"before": {"value": F.col(dict(_path(order))["smoothing"])}, "after": {"value": F.col("after_smoothing")}}))
    both = both.scan(lag={"_pf": F.col("filled")})
    each = both.summary({"v": F.count("value"), "sd": F.stddev_pop("filled"), "step": F.stddev_pop(F.col("filled") - F.col("_pf"))})
    vol = F.when(F.col("v") < 4, 0.0).otherwise(F.col("step") / (F.col("sd") + F.lit(1e-12)))
    half = lambda side: F.percentile(F.when(F.col("side") == side, vol), F.lit(0.5)).alias("volatility_" + side)
    out = each.groupBy(*[k for k in s.keys if k != "signal"]).agg(half("before"), half("after"))
    return out.withColumn("volatility_delta", F.col("volatility_after") - F.col("volatility_before"))


def stage_parameters(s: Series, order: str) -> DataFrame:
    """What the stages worked with, per signal: values kept by the outlier stage, values imputed, and the scaler."""
    before = dict(_path(order))
    kept, filled = F.col("after_outlier"), F.col(before["imputation"]).isNull() & F.col("after_imputation").isNotNull()
    imputed = F.when(filled, F.col("after_imputation"))
    return s.df.groupBy(*s.keys).agg(
        F.min(kept).alias("outlier_lowest_kept"), F.max(kept).alias("outlier_highest_kept"), F.count_if("detected").alias("outlier_flagged"),
        F.count(imputed).alias("imputed_values"), F.min(imputed).alias("imputed_lowest"), F.max(imputed).alias("imputed_highest"),
        F.max("center").alias("scaling_center"), F.max("width").alias("scaling_width"),
        F.count_if(F.col("value").isNull()).alias("remaining_missing"), F.count(F.lit(1)).alias("rows"))


def as_values(s: Series, column: str) -> Series:
    """The series with one of its stage columns as value."""
    keep = [c for c in s.df.columns if c in (*s.keys, "idx", "t", "fs")]
    return s.on(s.df.select(*keep, F.col(column).alias("value")))


def profile_with_corr(s: Series, signals, fs, timing: DataFrame | None = None, spectrum: bool = True) -> DataFrame:
    """Feature profile including the cross-signal correlation of the same rows."""
    from tidegauge.operators.profile import mean_abs_correlation
    corr = None
    if len(signals) > 1:
        wide = rows_of(s, signals)
        corr = mean_abs_correlation(wide.df, list(signals), wide.keys)
    return feature_profile(s, fs, timing, corr, spectrum)


def profile_changes(before: DataFrame, after: DataFrame, keys=("recording_id", "signal")) -> DataFrame:
    """before_, after_ and delta_ of every metric per signal; no delta for zero_variance."""
    metrics = [c for c in before.columns if c not in keys and c in after.columns]
    left = before.select(*keys, *[F.col(m).alias("before_" + m) for m in metrics])
    right = after.select(*keys, *[F.col(m).alias("after_" + m) for m in metrics])
    both = left.join(right, list(keys))
    delta = [(F.col("after_" + m) - F.col("before_" + m)).alias("delta_" + m) for m in metrics if m != "zero_variance"]
    return both.select("*", *delta)


def compare_stage(s: Series, stage: str, methods: list[str], spec: dict[str, str], order: str, st: Settings, domain: str,
                  fs, timing: DataFrame | None = None, spectrum: bool = True) -> DataFrame:
    """Vary one stage and hold the others: quality, change and what is left, best first."""
    from tidegauge.operators.quality import with_components, with_index
    plan = {x: (list(methods) if x == stage else [spec.get(x, "none")]) for x in STAGES}
    out = execute(s, plan, order, st)
    if stage not in out.keys:  # a single method leaves no key of its own
        out = replace(out, df=out.df.withColumn(stage, F.lit(methods[0])), keys=(*out.keys, stage))
    if out.blocked:
        out = out.cut()  # read by the profile, the changes and the metrics; whole recordings are cleaned again for each
    keys = [k for k in out.keys if k != "signal"]

    scored = _walked_quality(s, out, stage, plan, order, st, domain, fs, timing)
    if scored is None:
        def quality(x: Series) -> DataFrame:
            prof = profile_with_corr(x, st.signals, fs, timing, spectrum)
            k = tuple(k for k in x.keys if k != "signal")
            return with_index(with_components(aggregate_profile(prof, k)), domain)

        start = quality(s).select("recording_id", F.col("quality_index").alias("_q0"))
        scored = quality(as_values(out, "value")).join(start, "recording_id")
    result = scored.select(
        *keys, "quality_index", (F.col("quality_index") - F.col("_q0")).alias("quality_delta"), "missing_rate",
        F.greatest("outlier_iqr_rate", "outlier_mad_rate").alias("outlier_rate"), "local_volatility")
    names = list(_differences(order))
    facts = _stage_facts(out, order, _differences(order))
    facts = facts.select(*keys, *names, *[c for c in facts.columns if c not in (*keys, *names)])
    return result.join(facts, keys).withColumnRenamed(stage, "method").orderBy("recording_id", F.desc("quality_index"), "method")


def _walked_quality(s: Series, out: Series, stage: str, plan: dict[str, list[str]], order: str, st: Settings, domain: str, fs,
                    timing: DataFrame | None) -> DataFrame | None:
    """The aggregate metrics and quality of every method, and _q0 of the recording as it is, from whole recordings in the
    tasks that hold them; none where the trie can't do the plan."""
    from tidegauge.operators.quality import with_components, with_index
    from tidegauge.plans.trie import LIGHT, candidate_measures
    light = all(m in LIGHT[x] for x in LIGHT for m in plan[x]) and plan["scaling"] == ["none"] and stage in LIGHT
    as_is = st.max_gap is None and st.irregular is None and not st.resample and st.fs is None and timing is None
    if not light or not as_is or s.blocked or set(s.keys) != {"recording_id", "signal"} or not isinstance(fs, (int, float)):
        return None
    packed = candidate_measures(s.with_column("clean", F.col("value")), plan, (order_of(order),), float(fs), st.semantics, st.signals, st.seed)
    start = with_index(with_components(packed.select("recording_id", "leaves", "dirty.*")), domain, name="_q0")
    rows = start.select("recording_id", "_q0", F.inline("leaves"))
    return with_index(with_components(rows), domain)
