"""Candidate benchmarks: scenario results and what follows from them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.domains import COMPONENTS, IMPUTATION_FIRST, LOSS_PARTS, LOSS_WEIGHTS, OUTLIER_FIRST, QUALITY_WEIGHTS
from tidegauge.functions.scalar import pearson, uniform
from tidegauge.functions.series import Series
from tidegauge.operators import corrupt, validate
from tidegauge.operators.profile import aggregate_profile
from tidegauge.operators.quality import with_components, with_index
from tidegauge.plans.clean import STAGES, Settings, as_values, execute, profile_with_corr
from tidegauge.plans.trie import LIGHT, candidate_measures
from tidegauge.settings import cut

SCENARIO = ("domain", "seed", "severity_pct")
CANDIDATE = ("order", "imputation", "outlier", "smoothing")
# Scores are compared to nine digits; closer ones are ties.
DIGITS = 9
# From simple to elaborate; ours to declare, for choosing among near ties.
COMPLEXITY = ("none", "mean", "median", "locf", "linear", "zscore", "iqr", "mad", "winsorize", "moving_median", "savgol", "butterworth",
              "knn", "isolation_forest", "mice")


def severity_copies(s: Series, levels, seed: int = 42) -> Series:
    """One corrupted copy of every clean series per severity in percent; 0 stays clean."""
    s = s.fan_out("severity_pct", {str(x): {"_level": F.lit(x / 100.0)} for x in levels})
    return corrupt.nested(s, F.col("_level"), seed)


def quality_of(s: Series, st: Settings, fs, domains: DataFrame, spectrum: bool = True) -> DataFrame:
    """Component scores and index per recording copy under the recording's domain."""
    prof = profile_with_corr(s, st.signals, fs, spectrum=spectrum)
    keys = tuple(k for k in s.keys if k != "signal")
    scored = with_components(aggregate_profile(prof, keys), "").join(domains, "recording_id")
    return with_index(scored, F.col("domain"), "", "q_score").select(*keys, "domain", *COMPONENTS, "q_score")


def scenario_results(clean: Series, levels, methods: dict[str, list[str]], domains: DataFrame, st: Settings, fs,
                     orders=(IMPUTATION_FIRST, OUTLIER_FIRST), seed: int = 42) -> DataFrame:
    """One row per recording, severity and candidate: quality, components and error.

    Methods that work on one signal walk a trie of stage prefixes inside the task that holds the recording, which gives
    back sums only; where there is one signal, all methods do. Candidates with a method that looks across several signals,
    with scaling, or of recordings longer than a block run as copies, one job per order and set of methods; each stage
    copies a series once per method.
    """
    hurt = severity_copies(clean, levels, seed)
    methods = {stage: list(methods.get(stage, ["none"])) for stage in STAGES}
    light = {stage: [m for m in methods[stage] if m in LIGHT[stage]] for stage in LIGHT}
    fused = not hurt.blocked and methods["scaling"] == ["none"] and isinstance(fs, (int, float)) and not st.resample and all(light.values())
    if fused and len(st.signals) == 1:
        light = {stage: methods[stage] for stage in LIGHT}
    # The other candidates: a method across rows in the outlier stage, or in the imputation stage after one of the trie.
    sets, parts = [methods], []
    if fused:
        across = {stage: [m for m in methods[stage] if m not in light[stage]] for stage in ("outlier", "imputation")}
        sets = [methods | {"outlier": across["outlier"]}, methods | {"outlier": light["outlier"], "imputation": across["imputation"]}]
    sets = [x for x in sets if all(x.values())]
    if sets:
        hurt = hurt.cut()
    if fused:
        packed = _walked(hurt, light, domains, st, float(fs), orders, seed)
        packed = cut(packed) if sets else packed
        start = packed.select("recording_id", "severity_pct", "q_dirty")
        parts.append(_leaves(packed, st))
    else:
        start = quality_of(as_values(hurt, "value"), st, fs, domains).select("recording_id", "severity_pct", F.col("q_score").alias("q_dirty"))
    parts += [_copies(hurt, x, order, domains, st, fs).join(start, ["recording_id", "severity_pct"]) for x in sets for order in orders]
    out = reduce(DataFrame.unionByName, parts)
    r = lambda c: F.round(c, DIGITS)
    return out.select(
        "domain", F.col("recording_id").alias("seed"), F.col("severity_pct").cast("int").alias("severity_pct"), *CANDIDATE, "scaling",
        r("q_score").alias("q_score"), r(F.col("q_score") - F.col("q_dirty")).alias("delta_q"), *[r(c).alias(c) for c in COMPONENTS],
        r("nrmse").alias("nrmse"), *[r(f"{e}_{x}").alias(f"{e}_{x}") for e in ("nrmse", "rmse") for x in st.signals], "mean_raw_rmse", "remaining_missing_fraction", "valid_rmse")


def _walked(hurt: Series, methods: dict[str, list[str]], domains: DataFrame, st: Settings, fs: float, orders, seed: int) -> DataFrame:
    """One row per recording copy (and domain, where it has several): the quality of the uncleaned copy, the recording's
    domains, and the list of its candidates' measures."""
    keys = [k for k in hurt.keys if k != "signal"]
    packed = candidate_measures(hurt, methods, orders, fs, st.semantics, st.signals, st.seed)
    listed = domains.groupBy("recording_id").agg(F.collect_list(F.struct("domain")).alias("domains"))
    rows = packed.select(*keys, "leaves", "dirty.*").join(listed, "recording_id").select("*", F.inline("domains"))
    return with_index(with_components(rows, ""), F.col("domain"), "", "q_dirty").select(*keys, "domains", "q_dirty", "leaves")


def _leaves(packed: DataFrame, st: Settings) -> DataFrame:
    """Scores and errors of the candidates in the trie."""
    rows = packed.select("recording_id", "severity_pct", "q_dirty", "leaves", F.inline("domains"))
    rows = rows.select("recording_id", "severity_pct", "domain", "q_dirty", F.inline("leaves"))
    scored = with_index(with_components(rows, ""), F.col("domain"), "", "q_score").withColumn("scaling", F.lit("none"))
    errors = [f"{e}_{x}" for e in ("nrmse", "rmse") for x in st.signals]
    return scored.select("recording_id", "severity_pct", *CANDIDATE, "scaling", "domain", "q_dirty", *COMPONENTS, "q_score", "nrmse", "mean_raw_rmse",
                         *errors, "remaining_missing_fraction", "valid_rmse")


def _copies(hurt: Series, methods: dict[str, list[str]], order: str, domains: DataFrame, st: Settings, fs) -> DataFrame:
    """The same from a copy of every series per candidate."""
    runs = execute(hurt, methods, order, st)
    df, keys = runs.df, list(runs.keys)
    for stage in STAGES:
        if stage not in keys:
            df = df.withColumn(stage, F.lit(methods[stage][0]))
            keys.append(stage)
    # Written once: the profile and the error both read the cleaned copies.
    runs = Series(df.drop(*["after_" + x for x in STAGES[:3]], "center", "width"), tuple(keys), runs.longest, runs.groups, runs.block).cut()
    by = [k for k in keys if k != "signal"]
    q = quality_of(as_values(runs, "value"), st, fs, domains)
    return q.join(validate.nrmse(runs.df, by, st.signals), by).withColumn("order", F.lit(order))


def baselines(clean: Series, levels, domains: DataFrame, st: Settings, fs, seed: int = 42) -> DataFrame:
    """Quality and components of the clean and of the corrupted recording."""
    hurt = severity_copies(clean, levels, seed).cut()
    keys = ["recording_id", "severity_pct"]
    before = quality_of(as_values(hurt, "clean"), st, fs, domains)
    after = quality_of(as_values(hurt, "value"), st, fs, domains)
    left = before.select(*keys, "domain", F.col("q_score").alias("clean_q"), *[F.col(c).alias("clean_" + c) for c in COMPONENTS])
    right = after.select(*keys, F.col("q_score").alias("corrupted_q"), *[F.col(c).alias("corrupted_" + c) for c in COMPONENTS])
    out = left.join(right, keys)
    return out.select("domain", F.col("recording_id").alias("seed"), F.col("severity_pct").cast("int").alias("severity_pct"),
                      *[c for c in out.columns if c not in (*keys, "domain")])


# --- correlation of scores and errors -------------------------------------------
def tie_rank(keys, column: str) -> Column:
    """Rank from 1; equal values share the mean of their ranks."""
    order = W.partitionBy(*keys).orderBy(column)
    same = W.partitionBy(*keys, column)
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2


def spearman(df: DataFrame, keys, a: str, b: str, name: str) -> DataFrame:
    """Rank correlation per group over complete pairs; none when a side is constant.

    Ranks are computed per scenario, whose size is the fixed number of candidates.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.withColumn("_ra", tie_rank(keys, a)).withColumn("_rb", tie_rank(keys, b))
    out = rows.groupBy(*keys).agg(pearson(F.col("_ra"), F.col("_rb")).alias("_r"), F.stddev_pop("_ra").alias("_sa"), F.stddev_pop("_rb").alias("_sb"))
    return out.select(*keys, F.when((F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_r")).alias(name))


def component_spearman(results: DataFrame) -> DataFrame:
    """Rank correlation of every component with the error, next to the component's weight."""
    valid = results.filter("valid_rmse")
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("score")) for c in COMPONENTS])
    long = valid.select(*SCENARIO, "nrmse", F.inline(rows))
    out = spearman(long, [*SCENARIO, "component"], "score", "nrmse", "spearman_component_nrmse")
    weights = F.create_map(*[F.lit(x) for d, w in QUALITY_WEIGHTS.items() for c, v in zip(COMPONENTS, w) for x in (f"{d}/{c}", v)])
    return out.withColumn("component_weight", F.element_at(weights, F.concat_ws("/", "domain", "component")))


def scenario_summary(results: DataFrame) -> DataFrame:
    """Best by quality against best by error, per scenario."""
    keys = list(SCENARIO)
    counts = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("valid_rmse").alias("n_valid_rmse"))
    name = F.concat_ws(" / ", *CANDIDATE)
    whole = W.partitionBy(*keys)
    by_q = W.partitionBy(*keys).orderBy(F.desc("q_score"), "nrmse", *CANDIDATE)
    v = results.filter("valid_rmse").select(*keys, *CANDIDATE, "q_score", "nrmse", name.alias("id"))
    v = (v.withColumn("qmax", F.max("q_score").over(whole)).withColumn("best", F.min("nrmse").over(whole))
         .withColumn("place", F.row_number().over(by_q)))
    optimum = F.col("nrmse") <= F.col("best") + 1e-12
    top = F.col("q_score") >= F.col("qmax") - 1e-9
    who = F.struct("id", "q_score", "nrmse")
    out = v.groupBy(*keys).agg(
        F.max("qmax").alias("quality_max"), F.count_if(top).alias("qmax_tie_count"), F.bool_or(top & optimum).alias("qmax_ties_include_rmse_min"),
        F.min_by(who, "place").alias("_q"), F.min_by(who, F.struct("nrmse", (-F.col("q_score")).alias("q"), *CANDIDATE)).alias("_e"),
        F.bool_or((F.col("place") <= 5) & optimum).alias("top5_contains_optimum"),
        F.bool_or((F.col("place") <= 10) & optimum).alias("top10_contains_optimum"))
    best = F.col("_e.nrmse")
    out = out.select(
        *keys, "quality_max", "qmax_tie_count", "qmax_ties_include_rmse_min", F.col("_q.id").alias("best_q_pipeline"),
        F.col("_q.nrmse").alias("nrmse_best_q"), F.col("_e.id").alias("best_nrmse_pipeline"), best.alias("best_nrmse"),
        F.col("_e.q_score").alias("q_of_best_nrmse"), (F.col("_q.nrmse") - best).alias("nrmse_regret_abs"),
        F.when(best > 1e-10, F.col("_q.nrmse") / best).alias("nrmse_regret_ratio"), "top5_contains_optimum", "top10_contains_optimum")
    rho = spearman(results.filter("valid_rmse"), keys, "q_score", "nrmse", "spearman_q_nrmse")
    return (counts.withColumn("n_invalid_rmse", F.col("n_candidates") - F.col("n_valid_rmse")).join(rho, keys, "left").join(out, keys, "left"))


def _mid(c: str, name: str | None = None) -> Column:
    return F.percentile(c, F.lit(0.5)).alias(name or "median_" + c)


def severity_summary(summary: DataFrame, base: DataFrame) -> DataFrame:
    """Per domain and severity: medians, extremes and hits over the seeds."""
    keys = ["domain", "severity_pct"]
    s = summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"), _mid("spearman_q_nrmse", "median_spearman"), F.min("spearman_q_nrmse").alias("min_spearman"),
        F.max("spearman_q_nrmse").alias("max_spearman"), _mid("quality_max"), _mid("best_nrmse"), _mid("nrmse_best_q", "median_q_winner_nrmse"),
        _mid("nrmse_regret_ratio", "_regret"), F.count_if("qmax_ties_include_rmse_min").alias("qmax_hits"),
        F.count_if("top5_contains_optimum").alias("top5_hits"), F.count_if("top10_contains_optimum").alias("top10_hits"),
        _mid("n_invalid_rmse", "median_invalid_pipelines"))
    b = base.groupBy(*keys).agg(_mid("clean_q"), _mid("corrupted_q"))
    return (s.join(b, keys, "left").withColumn("median_regret_ratio", F.when(F.col("severity_pct") > 0, F.col("_regret"))).drop("_regret"))


def domain_overview(summary: DataFrame) -> DataFrame:
    """Per domain over all severities above zero."""
    return summary.filter(F.col("severity_pct") > 0).groupBy("domain").agg(
        _mid("spearman_q_nrmse", "median_rho"), F.avg("spearman_q_nrmse").alias("mean_rho"), _mid("nrmse_regret_ratio", "median_regret"),
        F.count_if("qmax_ties_include_rmse_min").alias("wins"), F.count_if("top5_contains_optimum").alias("top5_hits"),
        F.count(F.lit(1)).alias("n"), _mid("best_nrmse"), _mid("nrmse_best_q", "median_qwinner_nrmse"))


def component_summary(components: DataFrame) -> DataFrame:
    return components.groupBy("domain", "severity_pct", "component").agg(
        _mid("spearman_component_nrmse", "median_spearman"), F.count("spearman_component_nrmse").alias("valid_seeds"))


def misrankings(summary: DataFrame, n: int = 25) -> DataFrame:
    """The n scenarios with the largest regret ratio."""
    return (summary.filter((F.col("severity_pct") > 0) & F.col("nrmse_regret_ratio").isNotNull())
            .orderBy(F.desc("nrmse_regret_ratio"), *SCENARIO).limit(n))


def top_candidates(results: DataFrame, by: str, n: int = 25, keys=SCENARIO) -> DataFrame:
    """The n best candidates per group, by highest quality or lowest error."""
    first = F.desc("q_score") if by == "score" else F.asc("nrmse")
    w = W.partitionBy(*keys).orderBy(first, *[k for k in SCENARIO if k not in keys], *CANDIDATE)
    return (results.filter("valid_rmse").withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n))


def reproduction_audit(a: DataFrame, b: DataFrame, keys, values=("q_score", "nrmse")) -> DataFrame:
    """Matched rows of two result tables and the largest difference of each value."""
    right = b.select(*keys, *[F.col(v).alias("_b_" + v) for v in values])
    both = a.join(right, list(keys))
    return both.agg(F.count(F.lit(1)).alias("rows"), *[F.max(F.abs(F.col(v) - F.col("_b_" + v))).alias("max_diff_" + v) for v in values])


# --- winners and rules ------------------------------------------------------------
def winners(losses: DataFrame, scenario, tolerance: float = 0.02) -> DataFrame:
    """Oracle and practical winner per scenario.

    Methods within the tolerance of the lowest loss are near ties; the simplest
    of them, then the fastest, is the practical winner.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in COMPLEXITY]), F.col("method")), F.lit(len(COMPLEXITY) + 1))
    if "runtime" not in losses.columns:
        losses = losses.withColumn("runtime", F.lit(0.0))
    whole = W.partitionBy(*scenario)
    rows = losses.filter(F.col("loss").isNotNull()).withColumn("_min", F.min("loss").over(whole)).withColumn("_rank", rank)
    near = F.col("loss") <= F.col("_min") + tolerance
    best = F.struct("loss", "_rank", "method")
    out = rows.groupBy(*scenario).agg(
        F.min_by("method", best).alias("oracle"), F.min("loss").alias("oracle_loss"), F.count_if(near).alias("near_tie_count"),
        F.min_by(F.struct("method", "loss"), F.when(near, F.struct("_rank", "runtime", "method"))).alias("_w"),
        F.get(F.sort_array(F.collect_list("loss")), 1).alias("_second"))  # a handful of methods per scenario
    return out.select(*scenario, "oracle", "oracle_loss", "near_tie_count", F.col("_w.method").alias("winner"),
                      (F.col("_w.loss") - F.col("oracle_loss")).alias("regret"), (F.col("_second") - F.col("oracle_loss")).alias("second_best_margin"))


def winner_table(won: DataFrame) -> DataFrame:
    """Share of each winner per domain, and the share of scenarios with near ties."""
    by = W.partitionBy("domain")
    n = won.groupBy("domain", "winner").agg(F.count(F.lit(1)).alias("scenarios"), F.count_if(F.col("near_tie_count") > 1).alias("near_ties"))
    return n.select("domain", "winner", "scenarios", (F.col("scenarios") / F.sum("scenarios").over(by)).alias("share"),
                    (F.sum("near_ties").over(by) / F.sum("scenarios").over(by)).alias("near_tie_share"))


def dirichlet_weights(spark, domains, draws: int = 250, concentration: int = 120, seed: int = 42) -> DataFrame:
    """(domain, _w): random loss weights around those of each domain, a list of `draws` (draw, weights).

    Shapes are rounded to whole numbers, so each part is a sum of exponentials that a hash lays down.
    """
    shapes = [(d, [round(w * concentration) for w in LOSS_WEIGHTS[d]]) for d in domains]

    def part(draw: Column, shape: Column, j: Column) -> Column:
        one = lambda n: uniform(F.lit(seed), F.lit("weights"), F.col("domain"), draw, j, n)
        return F.when(shape > 0, F.aggregate(F.sequence(F.lit(1), shape), F.lit(0.0), lambda s, n: s - F.ln(1 - one(n)))).otherwise(0.0)

    def weights(draw: Column) -> Column:
        raw = F.transform("shapes", lambda shape, j: part(draw, shape, j))
        return F.transform(F.array(raw), lambda g: F.transform(g, lambda x: x / F.aggregate(g, F.lit(0.0), lambda s, y: s + y)))[0]

    rows = spark.createDataFrame(shapes, "domain string, shapes array<int>")
    return rows.select("domain", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.struct(i.alias("draw"), weights(i).alias("weights"))).alias("_w"))


def weight_support(parts: DataFrame, scenario, draws: int = 250, seed: int = 42) -> DataFrame:
    """Share of weight draws under which each method wins, per scenario; a method without any known part never does.

    ``parts`` has domain, method and the loss parts. The candidates of a scenario, one row each, meet in a list; all draws are
    decided inside its row, so nothing is repeated per draw. The draws of a domain are a list of fixed length.
    """
    packed = dirichlet_weights(parts.sparkSession, list(LOSS_WEIGHTS), draws, seed=seed)
    rows = parts.groupBy(*scenario, "domain").agg(F.collect_list(F.struct("method", F.array(*[F.col(p) for p in LOSS_PARTS]).alias("v"))).alias("_c"))
    rows = rows.join(F.broadcast(packed), "domain")

    def loss(v: Column, w: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
        top = total(F.zip_with(v, w, lambda a, b: F.coalesce(a * b, F.lit(0.0))))
        return F.coalesce(F.try_divide(top, total(F.zip_with(v, w, lambda a, b: F.when(a.isNotNull(), b).otherwise(0.0)))), F.lit(float("inf")))

    won = F.transform("_w", lambda d: F.array_min(F.transform("_c", lambda c: F.struct(loss(c["v"], d["weights"]).alias("l"), c["method"].alias("m"))))["m"])
    # A list of one binds the winners to a name, so that they are found once.
    shares = F.transform(F.array(won), lambda ms: F.transform(F.array_distinct(ms), lambda m: F.struct(
        m.alias("method"), (F.size(F.filter(ms, lambda x: x == m)) / F.lit(float(draws))).alias("support"))))[0]
    return rows.select(*scenario, F.inline(shares))


def _complete(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Features that trees can read: an unknown metric (skewness of a constant signal, say) is 0 and marked as missing."""
    rows = rows.withColumns({f"{f}_known": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
                            | {f"{f}_missing": F.col(f).isNull().cast("double") for f in features})
    return rows, [f"{f}_{k}" for k in ("known", "missing") for f in features]


def _tree(rows: DataFrame, features: list[str], depth: int, leaf: int):
    label = StringIndexer(inputCol="winner", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
    ready = VectorAssembler(inputCols=features, outputCol="features")
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, seed=42).fit(ready.transform(label.transform(rows)))
    return label, ready, model


def rule_tree(rows: DataFrame, features: list[str], depth: int = 4, leaf: int = 4) -> str:
    """A shallow tree from profile metrics to the winning method, as text."""
    rows, features = _complete(rows, features)
    label, _, model = _tree(rows, features, depth, leaf)
    text = model.toDebugString
    for i, f in enumerate(features):
        text = text.replace(f"feature {i} ", f"{f.removesuffix('_known')} ")
    for i, m in enumerate(label.labels):
        text = text.replace(f"Predict: {float(i)}", f"Predict: {m}")
    return text


def holdout_accuracy(rows: DataFrame, features: list[str], test: Column, depth: int = 4, leaf: int = 4) -> DataFrame:
    """Accuracy on the held-out rows of a tree grown on the others, next to always saying the commonest."""
    rows, features = _complete(rows, features)
    train = rows.filter(~test)
    label, ready, model = _tree(train, features, depth, leaf)
    common = train.agg(F.mode("winner", True)).first()[0]
    scored = model.transform(ready.transform(label.transform(rows.filter(test))))
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                      F.avg((F.col("winner") == F.lit(common)).cast("double")).alias("majority"))


def grouped_cv(rows: DataFrame, features: list[str], group: str, folds: int = 5, depth: int = 4, leaf: int = 4) -> DataFrame:
    """Held-out accuracy per fold; all rows of a group fall into the same fold."""
    fold = F.floor(uniform(F.lit("fold"), F.col(group)) * folds)
    rows = cut(rows.withColumn("_fold", fold))
    parts = [holdout_accuracy(rows, features, F.col("_fold") == k, depth, leaf).withColumn("fold", F.lit(k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def bootstrap_support(won: DataFrame, draws: int = 100, seed: int = 42) -> DataFrame:
    """Mean and spread of each winner's share per domain over Poisson resamples.

    A row counts 0, 1, 2, … times in a draw, told by a hash of draw and scenario.
    """
    cdf = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 9)]))

    def times(draw: int) -> Column:
        u = uniform(F.lit(seed), F.lit("boot"), F.col("seed").cast("string"), F.col("severity_pct").cast("string"), F.lit(str(draw)))
        return F.transform(F.array(u), lambda x: sum(((x >= float(c)).cast("int") for c in cdf), F.lit(0)))[0]

    # One list of sums per winner: rows aren't repeated per draw.
    sums = won.groupBy("domain", "winner").agg(F.array(*[F.sum(times(i)) for i in range(draws)]).alias("_k"))
    n = sums.select("domain", "winner", F.posexplode("_k").alias("draw", "k"))
    share = n.withColumn("support", F.col("k") / F.sum("k").over(W.partitionBy("domain", "draw")))
    return share.groupBy("domain", F.col("winner").alias("method")).agg(
        F.avg("support").alias("mean_support"), F.stddev_samp("support").alias("std_support"))


def inventory(windows: DataFrame, rates: DataFrame) -> DataFrame:
    """Per dataset: recordings, windows, median window length and median sampling rate."""
    w = windows.groupBy("dataset").agg(F.countDistinct("recording_id").alias("recordings"), F.count(F.lit(1)).alias("windows"), _mid("rows", "median_rows"))
    r = rates.groupBy("dataset").agg(_mid("rate_hz"))
    return w.join(r, "dataset")


