"""Method recommendation from profiles, candidate lists and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.domains import DOMAIN_LABELS, EYE_TRACKING_SUPPORT, IMPUTATION_FIRST, METHODS, OUTLIER_FIRST, STAGE_VALIDATION
from tidegauge.functions.scalar import uniform


def _leaf(method: str, *trace: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), F.array(*trace).alias("trace"))


def _say(text: str, c: Column) -> Column:
    return F.format_string(text, c)


def imputation_rule() -> Column:
    n, gap = F.col("n").cast("double"), F.col("longest_missing_run_seconds")
    vol, burst = F.col("max_local_volatility"), F.col("missing_burstiness")
    many, few = _say("n=%.0f > 182.5", n), _say("n=%.0f ≤ 182.5", n)
    short, long = _say("longest missing run=%.3fs ≤ 0.169s", gap), _say("longest missing run=%.3fs > 0.169s", gap)
    return (F.when(n <= 182.5, _leaf("mean", few))
            .when((gap <= 0.1693) & (vol <= 0.3987), _leaf("linear", many, short, _say("max local volatility=%.3f ≤ 0.399", vol)))
            .when(gap <= 0.1693, _leaf("locf", many, short, _say("max local volatility=%.3f > 0.399", vol)))
            .when(burst <= 0.248, _leaf("locf", many, long, _say("missing burstiness=%.3f ≤ 0.248", burst)))
            .otherwise(_leaf("linear", many, long, _say("missing burstiness=%.3f > 0.248", burst))))


def outlier_rule() -> Column:
    ent, iqr, mad = F.col("spectral_entropy"), F.col("max_outlier_iqr_rate"), F.col("max_outlier_mad_rate")
    pi, pm = iqr * 100, mad * 100
    low, high = _say("spectral entropy=%.3f ≤ 0.818", ent), _say("spectral entropy=%.3f > 0.818", ent)
    blind = (F.lit("Frequency diagnostics are unavailable for irregular timestamps; the rates decide alone."),
             _say("max IQR outlier rate=%.3f%%", pi), _say("max MAD outlier rate=%.3f%%", pm))
    i_le, i_gt = _say("max IQR outlier rate=%.3f%% ≤ 2.33%%", pi), _say("max IQR outlier rate=%.3f%% > 2.33%%", pi)
    m_le, m_gt = _say("max MAD outlier rate=%.3f%% ≤ 7.62%%", pm), _say("max MAD outlier rate=%.3f%% > 7.62%%", pm)
    without = F.when(iqr <= 0.0233, _leaf("iqr", *blind)).when(mad <= 0.0762, _leaf("mad", *blind)).otherwise(_leaf("zscore", *blind))
    return (F.when(ent.isNull(), without)
            .when(ent > 0.8184, _leaf("winsorize", high))
            .when(iqr <= 0.0233, _leaf("iqr", low, i_le))
            .when(mad <= 0.0762, _leaf("mad", low, i_gt, m_le))
            .otherwise(_leaf("zscore", low, i_gt, m_gt)))


def smoothing_rule() -> Column:
    vol, sk, dom = F.col("max_local_volatility"), F.col("skewness"), F.col("dominant_frequency_ratio")
    calm = _say("max local volatility=%.3f ≤ 0.575", vol)
    s_le = _say("skewness=%.3f ≤ 0.107", sk)
    return (F.when(vol > 0.5748, _leaf("none", _say("max local volatility=%.3f > 0.575", vol)))
            .when(sk > 0.1067, _leaf("butterworth", calm, _say("skewness=%.3f > 0.107", sk)))
            .when(dom <= 0.4698, _leaf("savgol", calm, s_le, _say("dominant-frequency ratio=%.3f ≤ 0.470", dom)))
            .otherwise(_leaf("moving_median", calm, s_le, _say("dominant-frequency ratio=%.3f > 0.470", dom))))


def scaling_rule() -> Column:
    outlier, ku = F.greatest("outlier_iqr_rate", "outlier_mad_rate"), F.col("kurtosis_excess")
    return (F.when(F.col("domain") == "finance", _leaf("none", F.lit("Finance keeps its interpretable scale by default.")))
            .when((outlier > 0.03) | (ku > 3), _leaf("robust", _say("Tail diagnostics favour robust scaling (outliers=%.2f%%).", outlier * 100)))
            .otherwise(_leaf("standard", F.lit("A comparatively regular distribution favours standard scaling."))))


def guards(stage: str, method: Column) -> list[tuple[Column, Column]]:
    """(condition, text) in order; a later match replaces the text of an earlier one."""
    dom = F.col("domain")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in DOMAIN_LABELS.items() for x in kv]), dom)
    return {
        "imputation": [(F.col("missing_rate") <= 0, F.lit("No missing values were observed in the selected signals."))],
        "outlier": [
            (dom == "finance", F.lit("Finance guard: heavy tails and jumps may be genuine; removal is off by default.")),
            ((F.col("kurtosis_excess") > 8) & (F.col("outlier_mad_rate") < 0.01),
             F.lit("High kurtosis with few isolated outliers suggests heavy tails rather than spikes."))],
        "smoothing": [
            (dom.isin("finance", "network") & (method != "none"), F.concat(label, F.lit(" guard: jumps and bursts are preserved by default."))),
            (F.coalesce(F.col("smoothing_requires_resampling"), F.lit(False)),
             F.lit("Irregular timestamps require internal resampling before smoothing."))],
        "scaling": [],
    }[stage]


RULES = {"imputation": imputation_rule, "outlier": outlier_rule, "smoothing": smoothing_rule, "scaling": scaling_rule}


def recommend(profile: DataFrame, keys=("recording_id",)) -> DataFrame:
    """One row per recording and stage: method, status, trace, support and validation figures.

    ``profile`` is an aggregate profile with a column domain.
    """
    if "smoothing_requires_resampling" not in profile.columns:
        profile = profile.withColumn("smoothing_requires_resampling", F.lit(False))
    rows = []
    for stage, rule in RULES.items():
        leaf = rule()
        guard = F.lit(None).cast("string")
        for cond, text in guards(stage, leaf["method"]):
            guard = F.when(F.coalesce(cond, F.lit(False)), text).otherwise(guard)
        val = STAGE_VALIDATION.get(stage)
        support = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(w).alias("share")) for m, w in EYE_TRACKING_SUPPORT.get(stage, ())]) \
            if stage in EYE_TRACKING_SUPPORT else F.array().cast("array<struct<method:string,share:double>>")
        none = F.array().cast("array<struct<method:string,share:double>>")
        rows.append(F.struct(
            F.lit(stage).alias("stage"), F.when(guard.isNotNull(), "none").otherwise(leaf["method"]).alias("method"),
            F.lit(val["status"] if val else "profile_based").alias("status"),
            F.when(guard.isNotNull(), F.concat(leaf["trace"], F.array(guard))).otherwise(leaf["trace"]).alias("rule_trace"),
            guard.alias("caution"), F.when(F.col("domain") == "eye_tracking", support).otherwise(none).alias("domain_support"),
            F.lit(val["grouped_cv_mean"] if val else None).cast("double").alias("grouped_cv_mean"),
            F.lit(val["majority"] if val else None).cast("double").alias("majority"),
            F.lit(val["holdout"] if val else None).cast("double").alias("holdout")))
    return profile.select(*keys, "domain", F.inline(F.array(*rows)))


def recommended_spec(rec: DataFrame, keys=("recording_id",)) -> DataFrame:
    """One row per recording with the method of every stage."""
    return rec.groupBy(*keys, "domain").agg(*[
        F.max(F.when(F.col("stage") == s, F.col("method"))).alias(s) for s in ("outlier", "imputation", "scaling", "smoothing")])


# --- candidate lists ----------------------------------------------------------
def grid_for(rows: DataFrame) -> DataFrame:
    """Every row with each of the 336 cleaning candidates, by exploding the method lists; no join."""
    lists = {"order": [IMPUTATION_FIRST, OUTLIER_FIRST], "imputation": METHODS["imputation"], "outlier": METHODS["outlier"],
             "smoothing": METHODS["smoothing"]}
    keep, pos = rows.columns, F.lit(0)
    for name, values in lists.items():
        rows = rows.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_" + name, name))
        pos = pos * len(values) + F.col("_" + name)
    return rows.select(*keep, (pos + 1).cast("long").alias("pipeline_id"), "imputation", "outlier", "smoothing",
                       F.lit("none").alias("scaling"), "order")


def spec_grid(spark: SparkSession) -> DataFrame:
    """The 336 cleaning candidates with their id."""
    return grid_for(spark.range(1).select())


def pilot_subset(grid: DataFrame, seed: str = "pilot", size: int = 25) -> DataFrame:
    """The plain linear candidate and the hash-lowest others of the default order.

    A candidate list of fixed size; the ranking depends only on the seed and the names.
    """
    base = grid.filter((F.col("order") == IMPUTATION_FIRST) & ~F.col("imputation").isin("none", "mice"))
    plain = (F.col("imputation") == "linear") & (F.col("outlier") == "none") & (F.col("smoothing") == "none")
    rank = F.when(plain, -1.0).otherwise(uniform(F.lit(seed), F.col("imputation"), F.col("outlier"), F.col("smoothing")))
    return base.withColumn("rank", rank).orderBy("rank").limit(size)


def compact_grid(spec: DataFrame, alternatives: dict[str, list[str]], keys=("recording_id",), cap: int = 10) -> DataFrame:
    """Per recording: the first two methods of each stage, crossed, at most ``cap`` candidates."""
    out = spec
    for stage in ("imputation", "outlier", "smoothing"):
        alt = F.array(*[F.lit(a) for a in alternatives.get(stage, [])]).cast("array<string>")
        two = F.slice(F.concat(F.array(stage), F.array_except(alt, F.array(stage))), 1, 2)
        out = out.withColumn("_l" + stage, two)
    for stage in ("imputation", "outlier", "smoothing"):
        out = out.select(*[c for c in out.columns if c not in (stage, "_l" + stage)], F.posexplode("_l" + stage).alias("_p" + stage, stage))
    pos = F.col("_pimputation") * 4 + F.col("_poutlier") * 2 + F.col("_psmoothing")
    from pyspark.sql import Window as W
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(pos))
    return (out.withColumn("candidate", rank.cast("long")).filter(F.col("candidate") <= cap)
            .select(*keys, "candidate", "imputation", "outlier", "smoothing", F.lit("none").alias("scaling")))


def candidate_table(rows: DataFrame, keys=()) -> DataFrame:
    """User-edited candidates: blank rows go, blank cells mean none, doubles count once.

    Unknown methods fail; so does a table without any candidate left.
    """
    stages = ("outlier", "imputation", "smoothing")
    blank = {s: F.col(s).isNull() | (F.col(s) == "") for s in stages}
    rows = rows.filter(~(blank["outlier"] & blank["imputation"] & blank["smoothing"]))
    for s in stages:
        known = F.col(s).isin(*METHODS[s])
        rows = rows.withColumn(s, F.when(blank[s], "none").when(known, F.col(s)).otherwise(
            F.raise_error(F.lit("choose an available method, or leave the cell empty to skip that stage"))))
    return rows.select(*keys, *stages, F.lit("none").alias("scaling")).dropDuplicates([*keys, *stages])


def spec_validity(candidates: DataFrame, resample: bool = False) -> DataFrame:
    """Status and reason of every (recording, candidate).

    Rows carry the methods, the order, and two facts of their recording:
    irregular, and all_missing (some signal has no observation at all).
    """
    lists = {s: F.array(*[F.lit(m) for m in METHODS[s]]) for s in METHODS}
    known = [F.array_contains(lists[s], F.col(s)) for s in METHODS]
    order_ok = F.col("order").isin(OUTLIER_FIRST, IMPUTATION_FIRST)
    reason = (F.when(~order_ok, "unsupported order")
              .when(~known[0], "unsupported outlier method").when(~known[1], "unsupported imputation method")
              .when(~known[2], "unsupported scaling method").when(~known[3], "unsupported smoothing method")
              .when(F.col("irregular") & F.lit(not resample) & (F.col("smoothing") != "none"), "smoothing needs regular timestamps or resampling")
              .when(F.col("all_missing") & F.col("imputation").isin("mean", "median", "knn", "mice"), "method cannot handle an all-missing signal"))
    return candidates.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
