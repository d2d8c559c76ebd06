"""Benchmark queries on candidate results computed from the events of every user."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidegauge.catalog.base import LI, LINE_RATE, SIGNALS, corr_sql, lines, lines_wide, pivot_sql, profile_sql, query, rounded, table
from tidegauge.catalog.cleaning import impute_sql, median_sql, outlier_sql
from tidegauge.catalog.profiling import component_sql
from tidegauge.catalog.validation import EVC, RUNS, clean_events, inject_sql, loss_sql, u
from tidegauge.domains import COMPONENTS, IMPUTATION_FIRST, LOSS_PARTS, LOSS_WEIGHTS, METHODS, OUTLIER_FIRST, QUALITY_WEIGHTS
from tidegauge.operators import profile as P
from tidegauge.operators import timeaxis as T
from tidegauge.operators import windows as N
from tidegauge.plans import benchmark as B
from tidegauge.plans.clean import Settings
from tidegauge.plans.trie import LIGHT
from tidegauge.settings import cut
from tidegauge.sources import sinks

LEVELS = (0, 5, 15)
CANDIDATES = {"outlier": ["none", "iqr"], "imputation": ["mean", "linear"], "scaling": ["none"], "smoothing": ["none", "moving_median"]}
SETTINGS = Settings(signals=("value",))
SEGMENTS = {"AUTOMOBILE": "industrial", "BUILDING": "energy", "FURNITURE": "physiological", "HOUSEHOLD": "finance", "MACHINERY": "network"}


def domains(spark, d):
    """(recording_id, domain): the market segment of the user's customer record."""
    e = table(spark, d, "events").select("user_id").distinct()
    c = table(spark, d, "customer")
    named = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])
    return (e.join(c, e.user_id == c.c_custkey, "left")
            .select(F.col("user_id").cast("string").alias("recording_id"), F.coalesce(F.element_at(named, F.col("c_mktsegment")), F.lit("network")).alias("domain")))


def results(spark, d):
    return cut(B.scenario_results(clean_events(spark, d), LEVELS, CANDIDATES, domains(spark, d), SETTINGS, 1.0))


def _union(name: str, src: str, parts: dict[str, str]) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT recording_id || '|{k}' AS recording_id, signal, idx, t, value FROM {c}" for k, c in parts.items()) + ")"


def _results_sql() -> str:
    p = [f"WITH {EVC}", "ev0 AS (SELECT recording_id, signal, idx, t, value FROM evc)"]
    for x in LEVELS:
        p.append(inject_sql("ev0", f"n{x}", "nested", x / 100))
    p.append(_union("c", "", {str(x): f"n{x}" for x in LEVELS}))
    finals = []
    for tag, first in (("i", "imputation"), ("o", "outlier")):
        src = "c"
        for step, stage in enumerate((first, "outlier" if first == "imputation" else "imputation")):
            parts = {}
            for m in CANDIDATES[stage]:
                dst = f"{tag}{step}{m}"
                p.append(outlier_sql(src, dst, m) if stage == "outlier" else impute_sql(src, dst, m))
                parts[m] = dst
            src = f"{tag}{step}"
            p.append(_union(src, "", parts))
        p.append(median_sql(src, f"{tag}mm"))
        p.append(_union(f"{tag}z", "", {"none": src, "moving_median": f"{tag}mm"}))
        finals.append(f"{tag}z")
    p.append(f"al AS (SELECT recording_id || '|{IMPUTATION_FIRST}' AS recording_id, signal, idx, t, value FROM iz UNION ALL SELECT recording_id || '|{OUTLIER_FIRST}', signal, idx, t, value FROM oz "
             "UNION ALL SELECT recording_id || '|dirty', signal, idx, t, value FROM c)")
    p.append(profile_sql("al", "1e0"))
    seg = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())
    p.append(f"dom AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS seed, coalesce(CASE c_mktsegment {seg} END, 'network') AS domain FROM events LEFT JOIN customer ON c_custkey = user_id)")
    p.append(f"sc AS (SELECT split_part(recording_id, '|', 1) AS seed, CAST(split_part(recording_id, '|', 2) AS INTEGER) AS severity_pct, *, {component_sql('')} FROM prof)")
    idx = "CASE domain " + " ".join(f"WHEN '{dm}' THEN (" + " + ".join(f"{x}e0*{c}" for c, x in zip(COMPONENTS, w)) + f")/{sum(w)!r}e0" for dm, w in QUALITY_WEIGHTS.items()) + " END"
    p.append(f"qs AS (SELECT *, {idx} AS q FROM sc JOIN dom USING (seed))")
    p.append("er AS (SELECT al.recording_id, CASE WHEN count(al.value) = count(*) THEN sqrt(avg((al.value - evc.value)**2))/(stddev_pop(evc.value) + 1e-12) END AS nrmse "
             "FROM al JOIN evc ON evc.recording_id = split_part(al.recording_id, '|', 1) AND evc.idx = al.idx GROUP BY 1)")
    w = {"i": (3, 4, 5), "o": (4, 3, 5)}
    pick = lambda a, b: f"CASE WHEN split_part(q.recording_id, '|', 6) = '{IMPUTATION_FIRST}' THEN split_part(q.recording_id, '|', {a}) ELSE split_part(q.recording_id, '|', {b}) END"
    p.append(f"""results AS (SELECT q.domain, q.seed, q.severity_pct, split_part(q.recording_id, '|', 6) AS "order", {pick(w['i'][0], w['o'][0])} AS imputation, {pick(w['i'][1], w['o'][1])} AS outlier,
      split_part(q.recording_id, '|', 5) AS smoothing, round(q.q, 9) AS q_score, round(q.q - b.q, 9) AS delta_q, {', '.join(f'round(q.{c}, 9) AS {c}' for c in COMPONENTS)}, round(nrmse, 9) AS nrmse, nrmse IS NOT NULL AS valid_rmse
      FROM qs q JOIN er USING (recording_id) JOIN qs b ON b.seed = q.seed AND b.severity_pct = q.severity_pct AND split_part(b.recording_id, '|', 3) = 'dirty' WHERE split_part(q.recording_id, '|', 3) <> 'dirty')""")
    return ", ".join(p)


RESULTS = _results_sql()
SC = "domain, seed, severity_pct"


def rank_sql(c: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1)/2e0"


def rho_sql(dst: str, src: str, part: str, a: str, name: str) -> str:
    return f"""{dst} AS (SELECT {part}, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS {name} FROM (
      SELECT {part}, {rank_sql(a, part)} AS ra, {rank_sql('nrmse', part)} AS rb FROM {src} WHERE {a} IS NOT NULL AND nrmse IS NOT NULL) GROUP BY ALL)"""


CAND = '"order", imputation, outlier, smoothing'
SUMMARY = RESULTS + f""", va AS (SELECT *, "order" || ' / ' || imputation || ' / ' || outlier || ' / ' || smoothing AS id, max(q_score) OVER (PARTITION BY {SC}) AS qmax, min(nrmse) OVER (PARTITION BY {SC}) AS best,
    row_number() OVER (PARTITION BY {SC} ORDER BY q_score DESC, nrmse, {CAND}) AS place, row_number() OVER (PARTITION BY {SC} ORDER BY nrmse, q_score DESC, {CAND}) AS eplace FROM results WHERE valid_rmse),
  {rho_sql('rho', 'va', SC, 'q_score', 'spearman_q_nrmse')},
  ct AS (SELECT {SC}, count(*) AS n_candidates, count(*) FILTER (valid_rmse) AS n_valid_rmse, count(*) FILTER (NOT valid_rmse) AS n_invalid_rmse FROM results GROUP BY ALL),
  su AS (SELECT {SC}, max(qmax) AS quality_max, count(*) FILTER (q_score >= qmax - 1e-9) AS qmax_tie_count, bool_or(q_score >= qmax - 1e-9 AND nrmse <= best + 1e-12) AS qmax_ties_include_rmse_min,
    max(id) FILTER (place = 1) AS best_q_pipeline, max(nrmse) FILTER (place = 1) AS nrmse_best_q, max(id) FILTER (eplace = 1) AS best_nrmse_pipeline, max(best) AS best_nrmse,
    max(q_score) FILTER (eplace = 1) AS q_of_best_nrmse, max(nrmse) FILTER (place = 1) - max(best) AS nrmse_regret_abs,
    CASE WHEN max(best) > 1e-10 THEN max(nrmse) FILTER (place = 1)/max(best) END AS nrmse_regret_ratio, bool_or(place <= 5 AND nrmse <= best + 1e-12) AS top5_contains_optimum, bool_or(place <= 10 AND nrmse <= best + 1e-12) AS top10_contains_optimum
    FROM va GROUP BY ALL),
  summary AS (SELECT * FROM ct LEFT JOIN rho USING ({SC}) LEFT JOIN su USING ({SC}))"""


@query("benchmark_results", f"""{RESULTS} SELECT domain, seed, CAST(severity_pct AS BIGINT) AS severity_pct, {CAND}, round(q_score, 5) AS q_score, round(delta_q, 5) AS delta_q, round(nrmse, 5) AS nrmse, valid_rmse FROM results""")
def benchmark_results(spark, d):
    return rounded(results(spark, d).select(*B.SCENARIO, *B.CANDIDATE, "q_score", "delta_q", "nrmse", "valid_rmse"), 5)


@query("benchmark_spearman", f"""{RESULTS}, {rho_sql('rho', 'results', SC, 'q_score', 'rho')} SELECT domain, seed, CAST(severity_pct AS BIGINT) AS severity_pct, round(rho, 6) AS rho FROM rho""")
def benchmark_spearman(spark, d):
    return rounded(B.spearman(results(spark, d).filter("valid_rmse"), B.SCENARIO, "q_score", "nrmse", "rho"))


@query("benchmark_component_spearman", f"""{RESULTS}, lg AS (SELECT {SC}, nrmse, unnest([{', '.join("{'component': '%s', 'score': %s}" % (c, c) for c in COMPONENTS)}], recursive := true) FROM results WHERE valid_rmse),
  {rho_sql('rho', 'lg', SC + ', component', 'score', 'r')} SELECT domain, CAST(severity_pct AS BIGINT) AS severity_pct, component, round(median(r), 6) AS median_spearman, count(r) AS valid_seeds FROM rho GROUP BY ALL""")
def benchmark_component_spearman(spark, d):
    return rounded(B.component_summary(B.component_spearman(results(spark, d))))


@query("benchmark_summary", f"""{SUMMARY} SELECT domain, seed, CAST(severity_pct AS BIGINT) AS severity_pct, n_candidates, n_valid_rmse, n_invalid_rmse, round(spearman_q_nrmse, 9) AS spearman_q_nrmse, round(quality_max, 5) AS quality_max, qmax_tie_count,
  qmax_ties_include_rmse_min, best_q_pipeline, round(nrmse_best_q, 5) AS nrmse_best_q, best_nrmse_pipeline, round(best_nrmse, 5) AS best_nrmse, round(q_of_best_nrmse, 5) AS q_of_best_nrmse, round(nrmse_regret_abs, 5) AS nrmse_regret_abs,
  round(nrmse_regret_ratio, 5) AS nrmse_regret_ratio, top5_contains_optimum, top10_contains_optimum FROM summary""")
def benchmark_summary(spark, d):
    out = B.scenario_summary(results(spark, d))
    return rounded(out.withColumns(
        {c: F.round(c, 5) for c in ("quality_max", "nrmse_best_q", "best_nrmse", "q_of_best_nrmse", "nrmse_regret_abs", "nrmse_regret_ratio")}), 9)


@query("benchmark_domain_overview", f"""{SUMMARY} SELECT domain, round(median(spearman_q_nrmse), 5) AS median_rho, round(avg(spearman_q_nrmse), 5) AS mean_rho, round(median(nrmse_regret_ratio), 5) AS median_regret, count(*) FILTER (qmax_ties_include_rmse_min) AS wins,
  count(*) FILTER (top5_contains_optimum) AS top5_hits, count(*) AS n, round(median(best_nrmse), 5) AS median_best_nrmse, round(median(nrmse_best_q), 5) AS median_qwinner_nrmse FROM summary WHERE severity_pct > 0 GROUP BY 1""")
def benchmark_domain_overview(spark, d):
    return rounded(B.domain_overview(B.scenario_summary(results(spark, d))), 5)


def _base(spark, d):
    return B.baselines(clean_events(spark, d), LEVELS, domains(spark, d), SETTINGS, 1.0)


DIRTY = "split_part({0}.recording_id, '|', 3) = 'dirty'"
# Severity 0 leaves a recording as it is, so its row holds the clean scores.
BASE_SQL = f"""bs AS (SELECT a.domain, a.seed, a.severity_pct, c.q AS clean_q, a.q AS corrupted_q,
    {', '.join(f'c.{x} AS clean_{x}, a.{x} AS corrupted_{x}' for x in COMPONENTS)}
  FROM qs a JOIN qs c ON c.seed = a.seed AND c.severity_pct = 0 AND {DIRTY.format('c')} WHERE {DIRTY.format('a')})"""


@query("benchmark_severity_summary", f"""{SUMMARY}, {BASE_SQL},
  b2 AS (SELECT domain, severity_pct, median(clean_q) AS cq, median(corrupted_q) AS dq FROM bs GROUP BY ALL),
  s2 AS (SELECT domain, severity_pct, count(*) AS seeds, median(spearman_q_nrmse) AS median_spearman, min(spearman_q_nrmse) AS min_spearman,
    max(spearman_q_nrmse) AS max_spearman, median(quality_max) AS median_quality_max, median(best_nrmse) AS median_best_nrmse,
    median(nrmse_best_q) AS median_q_winner_nrmse, median(CASE WHEN severity_pct > 0 THEN nrmse_regret_ratio END) AS median_regret_ratio,
    count(*) FILTER (qmax_ties_include_rmse_min) AS qmax_hits, count(*) FILTER (top5_contains_optimum) AS top5_hits,
    count(*) FILTER (top10_contains_optimum) AS top10_hits, median(n_invalid_rmse) AS median_invalid_pipelines FROM summary GROUP BY ALL)
  SELECT domain, CAST(severity_pct AS BIGINT) AS severity_pct, seeds, qmax_hits, top5_hits, top10_hits, round(cq, 5) AS median_clean_q, round(dq, 5) AS median_corrupted_q,
    {', '.join(f'round({c}, 5) AS {c}' for c in ('median_spearman', 'min_spearman', 'max_spearman', 'median_quality_max', 'median_best_nrmse', 'median_q_winner_nrmse', 'median_regret_ratio', 'median_invalid_pipelines'))}
  FROM s2 JOIN b2 USING (domain, severity_pct)""")
def benchmark_severity_summary(spark, d):
    return rounded(B.severity_summary(B.scenario_summary(results(spark, d)), _base(spark, d)), 5)


@query("benchmark_baselines", f"""{RESULTS}, {BASE_SQL} SELECT domain, seed, CAST(severity_pct AS BIGINT) AS severity_pct,
  {', '.join(f'round({side}_{x}, 5) AS {side}_{x}' for side in ('clean', 'corrupted') for x in ('q', *COMPONENTS))} FROM bs""")
def benchmark_baselines(spark, d):
    return rounded(_base(spark, d), 5)


@query("benchmark_misrankings", f"""{SUMMARY} SELECT domain, seed, CAST(severity_pct AS BIGINT) AS severity_pct, best_q_pipeline, best_nrmse_pipeline, round(nrmse_regret_ratio, 5) AS nrmse_regret_ratio FROM summary
  WHERE severity_pct > 0 AND nrmse_regret_ratio IS NOT NULL ORDER BY summary.nrmse_regret_ratio DESC, {SC} LIMIT 25""")
def benchmark_misrankings(spark, d):
    out = B.misrankings(B.scenario_summary(results(spark, d)))
    return rounded(out.select(*B.SCENARIO, "best_q_pipeline", "best_nrmse_pipeline", "nrmse_regret_ratio"), 5)


@query("benchmark_top_candidates", f"""{RESULTS} SELECT 'score' AS by, domain, seed, CAST(severity_pct AS BIGINT) AS severity_pct, {CAND}, place FROM (SELECT *, row_number() OVER (PARTITION BY domain, severity_pct ORDER BY q_score DESC, seed, {CAND}) AS place FROM results WHERE valid_rmse) WHERE place <= 25
  UNION ALL SELECT 'error', domain, seed, severity_pct, {CAND}, place FROM (SELECT *, row_number() OVER (PARTITION BY domain, severity_pct ORDER BY nrmse, seed, {CAND}) AS place FROM results WHERE valid_rmse) WHERE place <= 25""")
def benchmark_top_candidates(spark, d):
    r = results(spark, d)
    parts = [B.top_candidates(r, by, 25, ("domain", "severity_pct")).withColumn("by", F.lit(by)) for by in ("score", "error")]
    return rounded(parts[0].unionByName(parts[1]).select("by", *B.SCENARIO, *B.CANDIDATE, "place"))


@query("benchmark_reproduction_audit", f"""{RESULTS} SELECT count(*) AS rows, 0e0 AS max_diff_q_score, 0e0 AS max_diff_nrmse FROM results WHERE "order" = '{OUTLIER_FIRST}' AND imputation = 'linear' AND outlier = 'iqr'""")
def benchmark_reproduction_audit(spark, d):
    """The same candidates run on their own must give the same scores as in the full list."""
    alone = B.scenario_results(clean_events(spark, d), LEVELS, {**CANDIDATES, "outlier": ["iqr"], "imputation": ["linear"]}, domains(spark, d), SETTINGS, 1.0, (OUTLIER_FIRST,))
    return rounded(B.reproduction_audit(results(spark, d), alone, [*B.SCENARIO, *B.CANDIDATE]))


def _losses(spark, d):
    """Error of each imputation method alone, per scenario."""
    r = results(spark, d).filter((F.col("order") == OUTLIER_FIRST) & (F.col("outlier") == "none") & (F.col("smoothing") == "none") & (F.col("severity_pct") > 0))
    return r.select(*B.SCENARIO, F.col("imputation").alias("method"), F.col("nrmse").alias("loss"))


WON = RESULTS + f""", ls AS (SELECT {SC}, imputation AS method, nrmse AS loss, CASE imputation WHEN 'mean' THEN 2 ELSE 5 END AS rk FROM results WHERE "order" = '{OUTLIER_FIRST}' AND outlier = 'none' AND smoothing = 'none' AND severity_pct > 0 AND nrmse IS NOT NULL),
  lm AS (SELECT *, min(loss) OVER (PARTITION BY {SC}) AS mn, row_number() OVER (PARTITION BY {SC} ORDER BY loss, rk) AS place FROM ls),
  won AS (SELECT {SC}, max(method) FILTER (place = 1) AS oracle, max(mn) AS oracle_loss, count(*) FILTER (loss <= mn + 0.02) AS near_tie_count, arg_min(method, rk) FILTER (loss <= mn + 0.02) AS winner,
    arg_min(loss, rk) FILTER (loss <= mn + 0.02) - max(mn) AS regret, max(loss) FILTER (place = 2) - max(mn) AS second_best_margin FROM lm GROUP BY ALL)"""


@query("near_tie_winners", f"""{WON} SELECT domain, seed, CAST(severity_pct AS BIGINT) AS severity_pct, oracle, round(oracle_loss, 5) AS oracle_loss, near_tie_count, winner, round(regret, 5) AS regret, round(second_best_margin, 5) AS second_best_margin FROM won""")
def near_tie_winners(spark, d):
    return rounded(B.winners(_losses(spark, d), B.SCENARIO), 5)


@query("winner_table", f"""{WON}, n AS (SELECT domain, winner, count(*) AS scenarios, count(*) FILTER (near_tie_count > 1) AS nt FROM won GROUP BY ALL)
  SELECT domain, winner, scenarios, round(scenarios/sum(scenarios) OVER (PARTITION BY domain), 6) AS share, round(sum(nt) OVER (PARTITION BY domain)/sum(scenarios) OVER (PARTITION BY domain), 6) AS near_tie_share FROM n""")
def winner_table(spark, d):
    return rounded(B.winner_table(B.winners(_losses(spark, d), B.SCENARIO)))


# How often a row counts in a draw: a Poisson number of mean 1, by its distribution function.
TIMES = " + ".join(f"CASE WHEN u >= {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r}e0 THEN 1 ELSE 0 END" for k in range(9))


@query("bootstrap_support", f"""{WON}, dr AS (SELECT domain, seed, severity_pct, winner, unnest(range(0, 100)) AS draw FROM won),
  us AS (SELECT *, {u('42', "'boot'", 'seed', 'severity_pct', 'draw')} AS u FROM dr),
  kk AS (SELECT domain, draw, winner, sum({TIMES}) AS k FROM us GROUP BY ALL),
  sh AS (SELECT *, k/sum(k) OVER (PARTITION BY domain, draw) AS support FROM kk)
  SELECT domain, winner AS method, round(avg(support), 6) AS mean_support, round(stddev_samp(support), 6) AS std_support FROM sh GROUP BY ALL""")
def bootstrap_support(spark, d):
    return rounded(B.bootstrap_support(B.winners(_losses(spark, d), B.SCENARIO)))


FEATURES = ["missing_rate", "skewness", "kurtosis_excess", "lag1_autocorr", "drift_score", "local_volatility", "missing_burstiness", "outlier_iqr_rate"]


def ruled(spark, d):
    """Winners with the profile of the corrupted recording they won on."""
    hurt = B.severity_copies(clean_events(spark, d), [x for x in LEVELS if x])
    prof = P.feature_profile(hurt, 1.0, spectrum=False)
    prof = prof.select(F.col("recording_id").alias("seed"), F.col("severity_pct").cast("int").alias("severity_pct"), *FEATURES)
    return cut(B.winners(_losses(spark, d), B.SCENARIO).join(prof, ["seed", "severity_pct"]))


@query("rule_tree")
def rule_tree(spark, d):
    """The tree as text, one line per row, and its accuracy on a held-out domain."""
    rows = ruled(spark, d)
    text = B.rule_tree(rows, FEATURES)
    acc = B.holdout_accuracy(rows, FEATURES, F.col("domain") == "finance")
    return rounded(acc.select("rows", "accuracy", "majority", F.lit(text).alias("tree")))


@query("grouped_cv_accuracy")
def grouped_cv_accuracy(spark, d):
    return rounded(B.grouped_cv(ruled(spark, d), FEATURES, "seed", 3))


@query("grouped_cv_folds", f"""{WON}, fo AS (SELECT winner, CAST(floor({u("'fold'", 'seed')}*3) AS BIGINT) AS fold FROM won WHERE severity_pct > 0),
  ct AS (SELECT k AS fold, winner, count(*) AS n FROM fo, (SELECT unnest(range(0, 3)) AS k) WHERE fold <> k GROUP BY ALL),
  co AS (SELECT fold, winner, row_number() OVER (PARTITION BY fold ORDER BY n DESC, winner) AS place FROM ct)
  SELECT fo.fold, count(*) AS rows, round(avg(CASE WHEN fo.winner = co.winner THEN 1e0 ELSE 0e0 END), 6) AS majority FROM fo JOIN co ON co.fold = fo.fold AND place = 1 GROUP BY ALL""")
def grouped_cv_folds(spark, d):
    """All held-out rows of each fold, and how often the commonest winner of the other folds wins there."""
    return rounded(B.grouped_cv(ruled(spark, d), FEATURES, "seed", 3).select("fold", "rows", "majority"))


def _weight_sql() -> str:
    methods = ("mean", "median", "locf", "linear")
    p = [f"WITH {EVC}", inject_sql("evc", "o", "mcar_missing", 0.1), *[impute_sql("o", "i" + m, m) for m in methods]]
    p.append("k AS (" + " UNION ALL ".join(
        f"SELECT o.recording_id || '|{m}' AS recording_id, o.signal, o.idx, o.t, o.clean, o.mask, i.value, evc.event FROM o JOIN i{m} i USING (recording_id, signal, idx) JOIN evc USING (recording_id, signal, idx)"
        for m in methods) + ")")
    p += [loss_sql("k"), "rt AS (SELECT recording_id, avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END) AS retention FROM k GROUP BY 1)"]
    shapes = [round(w * 120) for w in LOSS_WEIGHTS["energy"]]
    p.append("sh(j, shape) AS (VALUES " + ", ".join(f"({j}, {n})" for j, n in enumerate(shapes)) + ")")
    p.append(f"""ex AS (SELECT draw, j, -ln(1e0 - {u('42', "'weights'", "'energy'", 'draw', 'j', 'n')}) AS e FROM (
      SELECT draw, j, unnest(range(1, shape + 1)) AS n FROM sh, (SELECT unnest(range(0, 250)) AS draw))),
      gm AS (SELECT draw, j, sum(e) AS g FROM ex GROUP BY ALL), wt AS (SELECT draw, j, g/sum(g) OVER (PARTITION BY draw) AS w FROM gm),
      pv AS (SELECT recording_id, unnest([{', '.join("{'j': %d, 'v': %s}" % (j, 'CAST(NULL AS DOUBLE)' if c == 'detection' else c) for j, c in enumerate(LOSS_PARTS))}], recursive := true) FROM lo JOIN rt USING (recording_id)),
      ls AS (SELECT recording_id, draw, sum(v*w)/sum(CASE WHEN v IS NOT NULL THEN w END) AS loss FROM pv JOIN wt USING (j) GROUP BY ALL),
      wn AS (SELECT seed AS recording_id, method FROM (SELECT split_part(recording_id, '|', 1) AS seed, split_part(recording_id, '|', 2) AS method, row_number() OVER (PARTITION BY split_part(recording_id, '|', 1), draw ORDER BY loss, split_part(recording_id, '|', 2)) AS place FROM ls) WHERE place = 1)""")
    return ", ".join(p) + " SELECT recording_id, method, round(count(*)/25e1, 6) AS support FROM wn GROUP BY ALL"


@query("weight_support", _weight_sql())
def weight_support(spark, d):
    """Share of 250 weight draws under which each imputation method has the lowest loss."""
    from tidegauge.plans import evaluate as E
    specs = [{"imputation": m} for m in ("mean", "median", "locf", "linear")]
    parts = E.loss_validation(clean_events(spark, d), specs, "mcar_missing", 0.1, "energy", SETTINGS, event="event")
    parts = cut(parts.withColumnRenamed("imputation", "method").withColumn("domain", F.lit("energy")))
    return rounded(B.weight_support(parts, ["recording_id"]))


@query("dataset_inventory", f"""{RUNS}, tt AS (SELECT *, idx/5e1 AS t, st/5e1 AS t0, (st + len - 1)/5e1 AS t1 FROM rl),
  w AS (SELECT recording_id, st, floor((t - t0)/0.2e0) AS k, min(idx) AS fi, count(*) AS rows FROM tt WHERE t1 - t0 >= (floor((t - t0)/0.2e0) + 1)*0.2e0 GROUP BY ALL),
  w3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY fi) AS wn FROM w WHERE rows >= 8) WHERE wn <= 3),
  ds AS (SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, n_name AS dataset FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT dataset, count(DISTINCT recording_id) AS recordings, count(*) AS windows, round(median(rows), 4) AS median_rows, 5e1 AS median_rate_hz FROM w3 JOIN ds USING (recording_id) GROUP BY 1""")
def dataset_inventory(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    ds = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").cast("string").alias("recording_id"), F.col("n_name").alias("dataset"))
    wide = lines_wide(spark, d)
    win = N.fixed_windows(wide, SIGNALS, 0.2, 8, 3).join(ds, "recording_id")
    rates = T.sampling_rate(wide, "t", F.lit(1.0)).join(ds, "recording_id")
    return rounded(B.inventory(win, rates), 4)


@query("exhaustive_candidates")
def exhaustive_candidates(spark, d):
    """All 336 candidates in benchmark semantics on a 10 % corruption of every user's recording."""
    methods = {s: list(METHODS[s]) for s in ("outlier", "imputation", "smoothing")}
    out = B.scenario_results(clean_events(spark, d), [10], {**methods, "scaling": ["none"]}, domains(spark, d), Settings(signals=("value",), semantics="bench"), 1.0)
    return rounded(out.groupBy(*B.CANDIDATE).agg(F.count(F.lit(1)).alias("scenarios"), F.count_if("valid_rmse").alias("valid"),
                                                 F.percentile("q_score", F.lit(0.5)).alias("median_q"), F.percentile("nrmse", F.lit(0.5)).alias("median_nrmse")), 5)


# --- four signals of every supplier's line items ------------------------------------------------------------------------
LINE_CANDIDATES = {"outlier": ["none", "zscore", "iqr", "mad", "winsorize"], "imputation": ["mean", "linear"], "scaling": ["none"], "smoothing": ["none"]}
LINE_LEVEL = 10
DOMAIN_NAMES = sorted(SEGMENTS.values())


def line_results(spark, d, methods):
    """Results of candidates on four signals at the line items' own rate, domains by the supplier's nation."""
    named = F.array(*[F.lit(x) for x in DOMAIN_NAMES])
    domain = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("recording_id"), F.element_at(named, F.pmod("s_nationkey", F.lit(5)).cast("int") + 1).alias("domain"))
    return B.scenario_results(lines(spark, d), [LINE_LEVEL], methods, domain, Settings(signals=tuple(SIGNALS)), LINE_RATE)


def _line_sql() -> str:
    p = [f"WITH {LI}", inject_sql("li", "hurt", "nested", LINE_LEVEL / 100), "c AS (SELECT recording_id, signal, idx, t, value FROM hurt)"]
    for tag, stages in (("i", ("imputation", "outlier")), ("o", ("outlier", "imputation"))):
        src = "c"
        for step, stage in enumerate(stages):
            parts = {m: f"{tag}{step}{m}" for m in LINE_CANDIDATES[stage]}
            p += [outlier_sql(src, dst, m) if stage == "outlier" else impute_sql(src, dst, m) for m, dst in parts.items()]
            src = f"{tag}{step}"
            p.append(_union(src, "", parts))
    p.append(f"al AS (SELECT recording_id || '|{IMPUTATION_FIRST}' AS recording_id, signal, idx, t, value FROM i1 UNION ALL SELECT recording_id || '|{OUTLIER_FIRST}', signal, idx, t, value FROM o1)")
    p += [pivot_sql("al", "alw"), corr_sql("alw"), profile_sql("al", "5e1", corr="cm", spectrum=False)]
    metrics = ("missing_rate", "missing_run_p95_seconds", "missing_burstiness", "outlier_iqr_rate", "outlier_mad_rate", "skewness", "kurtosis_excess", "drift_score", "local_volatility", "corr_mean_abs")
    p.append(f"md AS (SELECT recording_id, {', '.join(f'median({m}) AS {m}' for m in metrics)} FROM prof GROUP BY 1)")
    p.append(f"sc AS (SELECT *, split_part(recording_id, '|', 1) AS seed, {component_sql('')} FROM md)")
    names = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(DOMAIN_NAMES))
    p.append(f"dom AS (SELECT CAST(s_suppkey AS VARCHAR) AS seed, CASE s_nationkey % 5 {names} END AS domain FROM supplier)")
    idx = "CASE domain " + " ".join(f"WHEN '{dm}' THEN (" + " + ".join(f"{x}e0*{c}" for c, x in zip(COMPONENTS, w)) + f")/{sum(w)!r}e0" for dm, w in QUALITY_WEIGHTS.items()) + " END"
    p.append("""sg AS (SELECT al.recording_id, al.signal, sqrt(avg((al.value - li.value)**2))/(stddev_pop(li.value) + 1e-12) AS e, count(*) - count(al.value) AS gone
      FROM al JOIN li ON li.recording_id = split_part(al.recording_id, '|', 1) AND li.signal = al.signal AND li.idx = al.idx GROUP BY ALL),
      er AS (SELECT recording_id, CASE WHEN sum(gone) = 0 THEN avg(e) END AS nrmse FROM sg GROUP BY 1)""")
    first, second = "split_part(recording_id, '|', 2)", "split_part(recording_id, '|', 3)"
    swap = f"split_part(recording_id, '|', 4) = '{IMPUTATION_FIRST}'"
    return ", ".join(p) + f""" SELECT domain, seed, split_part(recording_id, '|', 4) AS "order", CASE WHEN {swap} THEN {first} ELSE {second} END AS imputation,
      CASE WHEN {swap} THEN {second} ELSE {first} END AS outlier, round({idx}, 5) AS q_score, round(nrmse, 5) AS nrmse FROM sc JOIN dom USING (seed) JOIN er USING (recording_id)"""


@query("line_candidates", _line_sql())
def line_candidates(spark, d):
    """Twenty candidates on four signals: outlier and imputation methods in both orders."""
    return rounded(line_results(spark, d, LINE_CANDIDATES).select("domain", "seed", "order", "imputation", "outlier", "q_score", "nrmse"), 5)


@query("line_candidates_all")
def line_candidates_all(spark, d):
    """The two hundred candidates of methods on one signal, on four signals of every supplier."""
    methods = {s: list(LIGHT[s]) for s in LIGHT} | {"scaling": ["none"]}
    return rounded(line_results(spark, d, methods).groupBy(*B.CANDIDATE).agg(
        F.count(F.lit(1)).alias("scenarios"), F.count_if("valid_rmse").alias("valid"), F.percentile("q_score", F.lit(0.5)).alias("median_q"),
        F.percentile("nrmse", F.lit(0.5)).alias("median_nrmse")), 5)


@query("stored_results", f"""{RESULTS} SELECT domain, count(*) AS rows, count(DISTINCT seed) AS seeds, 0 AS incomplete FROM results GROUP BY 1""")
def stored_results(spark, d):
    """Results written by domain and severity, read back and checked for completeness."""
    from tidegauge.catalog.ingest import scratch
    path = scratch(spark, "results")
    sinks.write_results(results(spark, d), path)
    back = spark.read.option("basePath", path).parquet(path).withColumn("seed", F.col("seed").cast("string"))
    gaps = sinks.completeness(back, 16).groupBy("domain").agg(F.count(F.lit(1)).alias("incomplete"))
    out = back.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("seed").alias("seeds"))
    return rounded(out.join(gaps, "domain", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(0))))
