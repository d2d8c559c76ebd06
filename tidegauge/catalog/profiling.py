"""Time axis, profile and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.base import (CORR, EMB, EV, EV1, LI, SIGNALS, embeddings, events, events_wide, filled_sql, lines,
                                    lines_wide, profile_sql, query, rounded, timing_sql, welch_sql)
from tidegauge.domains import COMPONENT_LABELS, COMPONENTS, QUALITY_WEIGHTS
from tidegauge.functions.spectrum import spectral_shape, welch
from tidegauge.operators import columns
from tidegauge.operators import profile as P
from tidegauge.operators import quality as Q
from tidegauge.operators import timeaxis as T
from tidegauge.sources.tables import as_long, recordings, table

METRIC_LIST = ", ".join(f"round({m}, 6) AS {m}" for m in P.METRICS if m != "n")


def line_profile(spark, d):
    wide = lines_wide(spark, d)
    corr = P.mean_abs_correlation(wide.df, SIGNALS)
    return P.feature_profile(as_long(wide, SIGNALS), 50.0, corr=corr)


LINE_PROFILE = f"WITH {LI}, {CORR}, {profile_sql('li', corr='cm')}"
TIMES = timing_sql("ev")
TIMING_COLS = """recording_id, n AS n_rows, missing AS missing_timestamps, dup AS duplicate_steps, back AS backward_steps,
  round(med, 6) AS median_interval_seconds, round(eff, 6) AS effective_interval_seconds,
  CASE WHEN quantised THEN 'trimmed-mean interval for coarsely quantised clock'
    ELSE 'inverse median of positive intervals' END AS sampling_rate_estimation,
  round(CASE WHEN eff > 0 THEN 1/eff END, 6) AS sampling_rate_hz,
  round(CASE WHEN missing = 0 THEN t1 - t0 END, 6) AS duration_seconds, irregular AS irregular_intervals, valid,
  round(greatest(0.5e0, 10*med), 6) AS default_max_gap_seconds"""


@query("time_axis_diagnostics", f"WITH {EV}, {TIMES} SELECT {TIMING_COLS} FROM tm")
def time_axis_diagnostics(spark, d):
    return rounded(T.diagnostics(events_wide(spark, d)))


@query("time_axis_one_long_recording", f"WITH {EV1}, {TIMES} SELECT {TIMING_COLS} FROM tm")
def time_axis_one_long_recording(spark, d):
    return rounded(T.diagnostics(events_wide(spark, d, one=True, block=1024)))


@query("sampling_rate", f"""WITH {EV}, {TIMES} SELECT recording_id, round(1e0/med, 6) AS rate_hz,
  'Inferred from median timestamp step' AS reason FROM tm""")
def sampling_rate(spark, d):
    s = events_wide(spark, d)
    return rounded(T.sampling_rate(s, "t", F.lit(1.0)))


def order_recordings(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    o = table(spark, d, "orders")
    return recordings(o, F.col("o_custkey"), ["o_orderdate", "o_orderkey"], F.unix_micros(F.col("o_orderdate").cast("timestamp")),
                      {"price": F.col("o_totalprice")}, clock=F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6))


ORD = """ord AS (
  SELECT CAST(o_custkey AS VARCHAR) AS recording_id, 'price' AS signal,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
    epoch_us(o_orderdate)/1e6 - first_value(epoch_us(o_orderdate)/1e6) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t,
    o_totalprice AS value FROM orders)"""


@query("time_gate", f"""WITH {ORD}, {timing_sql('ord')} SELECT valid, count(DISTINCT recording_id) AS recordings, count(*) AS n_rows,
  sum(dup) AS duplicate_steps FROM (SELECT recording_id, valid, CASE WHEN idx = 0 THEN dup ELSE 0 END AS dup FROM ord JOIN tm USING (recording_id))
  GROUP BY valid""")
def time_gate(spark, d):
    s = order_recordings(spark, d)
    timing = T.diagnostics(s)
    good, bad = T.gate(s.df, timing, s.groups)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    dup = timing.select("recording_id", "duplicate_steps")
    both = both.join(dup, "recording_id")
    return rounded(both.groupBy("valid").agg(
        F.countDistinct("recording_id").alias("recordings"), F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("idx") == 0, F.col("duplicate_steps")).otherwise(0)).alias("duplicate_steps")))


@query("gap_profile", f"""WITH {EV}, {TIMES}, e2 AS (SELECT ev.*, 1/eff AS fs FROM ev JOIN tm USING (recording_id)),
  {filled_sql('ev', '1e0')}
  SELECT recording_id, signal, count(*) AS n, round(avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing_rate,
    count(gap) AS gap_count, coalesce(max(gap), 0) AS longest_gap_samples, round(coalesce(max(gap_s), 0e0), 6) AS longest_missing_run_seconds,
    round(coalesce(quantile_cont(gap_s, 0.95), 0e0), 6) AS missing_run_p95_seconds,
    round(coalesce(least(1e0, 0.65e0*max(gap)/sum(gap) + 2.8e0*avg(gap)/count(*)), 0e0), 6) AS missing_burstiness
  FROM f GROUP BY ALL""")
def gap_profile(spark, d):
    return _gaps(events(spark, d))


def _gaps(s):
    s = P.fill_by_index(s).stats({"n_rows": F.count(F.lit(1)), "last_t": F.max("t")})
    s = P.gap_columns(s, F.lit(1.0))
    out = s.summary({
        "n": F.count(F.lit(1)), "missing_rate": F.avg(F.col("value").isNull().cast("double")),
        "gap_count": F.count("gap_samples"), "mx": F.max("gap_samples"), "sm": F.sum("gap_samples"),
        "mn": F.avg("gap_samples"), "longest": F.max("gap_seconds")}, {"p95": (F.col("gap_seconds"), 0.95)})
    zero = F.lit(0.0)
    return rounded(out.select(
        *s.keys, "n", "missing_rate", "gap_count", F.coalesce("mx", F.lit(0)).alias("longest_gap_samples"),
        F.coalesce("longest", zero).alias("longest_missing_run_seconds"), F.coalesce("p95", zero).alias("missing_run_p95_seconds"),
        F.coalesce(F.least(F.lit(1.0), 0.65 * F.col("mx") / F.col("sm") + 2.8 * F.col("mn") / F.col("n")), zero)
        .alias("missing_burstiness")))


PROFILE_ONE = f"""WITH {EV1}, {TIMES}, {profile_sql('ev', '1/(SELECT eff FROM tm)', timing='tm')}
  SELECT recording_id, signal, n, zero_variance, {METRIC_LIST} FROM prof"""


@query("profile_one_long_recording", PROFILE_ONE)
def profile_one_long_recording(spark, d):
    """The whole table as a single recording, worked on in blocks."""
    wide = events_wide(spark, d, one=True, block=1024).cut()
    timing = T.diagnostics(wide)
    rate = timing.select("recording_id", F.col("sampling_rate_hz").alias("fs"))
    s = as_long(wide.attach(rate), ["value"], keep=("idx", "t", "fs"))
    return rounded(P.feature_profile(s, F.col("fs"), timing=timing))


@query("profile_features", f"{LINE_PROFILE} SELECT recording_id, signal, n, zero_variance, {METRIC_LIST} FROM prof")
def profile_features(spark, d):
    return rounded(line_profile(spark, d))


@query("profile_irregular_recordings", f"""WITH {EV}, {TIMES}, evf AS (SELECT ev.*, 1/eff AS fs FROM ev JOIN tm USING (recording_id)),
  {profile_sql('ev', '(SELECT 1/eff FROM tm WHERE tm.recording_id = f0.recording_id)', timing='tm')}
  SELECT recording_id, signal, n, zero_variance, {METRIC_LIST} FROM prof""")
def profile_irregular_recordings(spark, d):
    wide = events_wide(spark, d)
    timing = T.diagnostics(wide)
    rate = timing.select("recording_id", F.col("sampling_rate_hz").alias("fs"))
    s = as_long(wide.attach(rate), ["value"], keep=("idx", "t", "fs"))
    return rounded(P.feature_profile(s, F.col("fs"), timing=timing))


@query("spectral_entropy", f"""WITH {EMB}, {filled_sql('emb')}, {welch_sql('f', 'x')}
  SELECT recording_id, signal, round(-sum(p/tot*ln(p/tot + 1e-12))/ln(count(*)), 6) AS spectral_entropy,
    round(max(p)/max(tot), 6) AS dominant_frequency_ratio
  FROM (SELECT *, sum(p) OVER (PARTITION BY recording_id, signal) AS tot FROM pw) GROUP BY ALL""")
def spectral_entropy(spark, d):
    s = P.fill_by_index(embeddings(spark, d)).stats({"n_rows": F.count(F.lit(1))})
    return rounded(spectral_shape(welch(s.df, list(s.keys), "filled", F.col("n_rows")), list(s.keys)))


@query("cross_signal_correlation", f"""WITH {LI}, {CORR} SELECT recording_id, signal, round(cm, 6) AS corr_mean_abs FROM cm""")
def cross_signal_correlation(spark, d):
    return rounded(P.mean_abs_correlation(lines_wide(spark, d).df, SIGNALS))


@query("correlation_matrix", f"""WITH {LI}, {CORR} SELECT recording_id, signal_a, signal_b, round(r, 6) AS r FROM (
  SELECT recording_id, c.a AS signal_a, c.b AS signal_b, c.r AS r FROM cor UNION ALL SELECT recording_id, c.b, c.a, c.r FROM cor
  UNION ALL SELECT DISTINCT recording_id, signal, signal, 1e0 FROM li)""")
def correlation_matrix(spark, d):
    return rounded(P.correlation_matrix(lines_wide(spark, d).df, SIGNALS))


@query("aggregate_profile", LINE_PROFILE + " SELECT recording_id, count(*) AS n_features, " + ", ".join(
    f"round(median({m}), 6) AS {m}, round(max({m}), 6) AS max_{m}" for m in P.METRICS)
    + ", avg(CASE WHEN zero_variance THEN 1e0 ELSE 0e0 END) AS zero_variance_fraction FROM prof GROUP BY 1")
def aggregate_profile(spark, d):
    out = P.aggregate_profile(line_profile(spark, d))
    return rounded(out)


def component_sql(prefix="quality_"):
    return f"""100*(1 - least(1e0, missing_rate/0.45e0)) AS {prefix}completeness,
    100*(1 - least(1e0, 0.55e0*missing_burstiness + 0.45e0*missing_run_p95_seconds/(1 + missing_run_p95_seconds))) AS {prefix}continuity,
    100*(1 - least(1e0, greatest(outlier_iqr_rate, outlier_mad_rate)/0.25e0)) AS {prefix}plausibility,
    100*(1 - least(1e0, 0.6e0*abs(skewness)/3 + 0.4e0*greatest(0e0, kurtosis_excess)/10)) AS {prefix}distribution,
    100*(1 - least(1e0, 0.65e0*drift_score + 0.35e0*local_volatility/(1 + local_volatility))) AS {prefix}stability,
    100*least(1e0, 0.25e0 + 0.75e0*corr_mean_abs) AS {prefix}correlation"""


def index_sql(domain, prefix="quality_"):
    w = QUALITY_WEIGHTS[domain]
    return "(" + " + ".join(f"{x}e0*{prefix}{c}" for c, x in zip(COMPONENTS, w)) + f")/{sum(w)!r}e0"


SCORE_LIST = ", ".join(f"round(quality_{c}, 5) AS quality_{c}" for c in COMPONENTS)
LINE_SCORES = LINE_PROFILE + f", sc AS (SELECT *, {component_sql()} FROM prof)"
REC_SCORES = LINE_PROFILE + ", rec AS (SELECT recording_id, " + ", ".join(
    f"median({m}) AS {m}" for m in P.METRICS) + f" FROM prof GROUP BY 1), rs AS (SELECT *, {component_sql()} FROM rec)"


@query("quality_components", f"{LINE_SCORES} SELECT recording_id, signal, {SCORE_LIST} FROM sc")
def quality_components(spark, d):
    out = Q.with_components(line_profile(spark, d))
    return rounded(out.select("recording_id", "signal", *["quality_" + c for c in COMPONENTS]), 5)


@query("profile_table", f"""{LINE_SCORES} SELECT recording_id, signal, n, zero_variance, {METRIC_LIST}, {SCORE_LIST.replace(', 5)', ', 6)')},
  round({index_sql('finance')}, 6) AS quality_index FROM sc""")
def profile_table(spark, d):
    return rounded(Q.profile_table(line_profile(spark, d), "finance"))


@query("quality_index", f"""{REC_SCORES} SELECT recording_id, domain, round(q, 5) AS quality_index FROM (
  SELECT recording_id, unnest([{', '.join("{'domain': '%s', 'q': %s}" % (dom, index_sql(dom)) for dom in QUALITY_WEIGHTS)}], recursive := true) FROM rs)""")
def quality_index(spark, d):
    """Index of each recording under every domain's weights."""
    rec = Q.with_components(P.aggregate_profile(line_profile(spark, d)))
    rec = rec.withColumn("domain", F.explode(F.array(*[F.lit(x) for x in QUALITY_WEIGHTS])))
    return rounded(Q.with_index(rec, F.col("domain")).select("recording_id", "domain", "quality_index"), 5)


@query("quality_breakdown", f"""{REC_SCORES} SELECT recording_id, component, round(s, 5) AS score_0_100, round(w, 5) AS domain_weight,
  round(s*w, 5) AS weighted_points FROM (SELECT recording_id, unnest([{', '.join(
      "{'component': '%s', 's': quality_%s, 'w': %re0/%re0}" % (COMPONENT_LABELS[c], c, w, sum(QUALITY_WEIGHTS['network']))
      for c, w in zip(COMPONENTS, QUALITY_WEIGHTS['network']))}], recursive := true) FROM rs)""")
def quality_breakdown(spark, d):
    rec = Q.with_components(P.aggregate_profile(line_profile(spark, d)))
    return rounded(Q.breakdown(rec, "network", ["recording_id"]), 5)


MEAS = f"""WITH {LI}, {profile_sql('li')} SELECT recording_id, signal, n AS samples, v AS finite_values, n - v AS missing_values,
  runs AS gap_count, coalesce(gmax, 0) AS longest_gap_samples, round(coalesce(gmean, 0e0), 6) AS mean_gap_samples,
  round(coalesce(g95, 0e0), 6) AS p95_gap_samples, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  round(med, 6) AS median, round(mad, 6) AS mad, round(q1 - 1.5e0*(q3 - q1), 6) AS iqr_lower_bound,
  round(q3 + 1.5e0*(q3 - q1), 6) AS iqr_upper_bound, CAST(round(r_iqr*v) AS BIGINT) AS iqr_flagged, CAST(round(r_mad*v) AS BIGINT) AS mad_flagged,
  greatest(10, n//10) AS rolling_window_samples, round(roll/sdx1, 6) AS rolling_mean_range, round(sdx1, 6) AS sample_std,
  round(sdx, 6) AS population_std, round(sdd, 6) AS difference_std, round(m2/scale2, 6) AS central_moment_2,
  round(m3/scale3, 6) AS central_moment_3, round(m4/scale4, 6) AS central_moment_4
  FROM a JOIN d USING (recording_id, signal) JOIN q USING (recording_id, signal) JOIN q2 USING (recording_id, signal)
  JOIN (SELECT recording_id, signal, quantile_cont(gap, 0.95) AS g95, avg((value - mean_v)**2) AS m2, avg((value - mean_v)**3) AS m3,
    avg((value - mean_v)**4) AS m4, var_pop(value) AS scale2, var_pop(value)**1.5e0 AS scale3, var_pop(value)**2 AS scale4 FROM w GROUP BY ALL) USING (recording_id, signal)"""


@query("signal_measurements", MEAS)
def signal_measurements(spark, d):
    """Moments and the rolling range are shown in units of the standard deviation."""
    out = P.measurements(lines(spark, d), 50.0)
    var = F.col("central_moment_2")
    out = (out.withColumn("central_moment_3", F.try_divide("central_moment_3", F.pow(var, F.lit(1.5))))
           .withColumn("central_moment_4", F.try_divide("central_moment_4", F.pow(var, F.lit(2.0))))
           .withColumn("central_moment_2", F.try_divide(var, var)))
    out = out.withColumn("rolling_mean_range", F.try_divide("rolling_mean_range", "sample_std"))
    return rounded(out)


@query("box_and_whiskers", f"""WITH {EV}, b AS (SELECT recording_id, signal, quantile_cont(value, 0.25) AS q1, median(value) AS med,
  quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY ALL) SELECT recording_id, signal, round(max(q1), 6) AS q1, round(max(med), 6) AS median,
  round(max(q3), 6) AS q3, round(min(value) FILTER (value >= q1 - 1.5e0*(q3 - q1)), 6) AS whisker_low,
  round(max(value) FILTER (value <= q3 + 1.5e0*(q3 - q1)), 6) AS whisker_high FROM ev JOIN b USING (recording_id, signal) GROUP BY ALL""")
def box_and_whiskers(spark, d):
    return rounded(P.box_stats(events(spark, d)))


@query("value_histogram", f"""WITH {EV}, b AS (SELECT recording_id, signal, min(value) AS lo, max(value) AS hi FROM ev GROUP BY ALL)
  SELECT recording_id, signal, CAST(CASE WHEN hi > lo THEN least(floor((value - lo)/((hi - lo)/45)), 44) ELSE 0 END AS BIGINT) AS bin,
  count(*) AS count, round(max(lo), 6) AS low, round(max((hi - lo)/45), 6) AS width FROM ev JOIN b USING (recording_id, signal)
  WHERE value IS NOT NULL GROUP BY ALL""")
def value_histogram(spark, d):
    return rounded(P.histogram(events(spark, d)))


@query("signal_overview", f"""WITH {LI}, o AS (SELECT *, count(*) OVER (PARTITION BY recording_id, signal) AS n FROM li)
  SELECT recording_id, signal, round(100*avg(CASE WHEN value IS NULL THEN 0e0 ELSE 1e0 END), 1) AS available_pct,
  count(*) FILTER (value IS NULL) AS missing, min(value) AS low, max(value) AS high,
  count(*) FILTER (n <= 48 OR list_contains(list_transform(range(0, 48), lambda j: CAST(floor(j*((n - 1)/47e0) + CASE WHEN j = 47 THEN 1e-6 ELSE 0e0 END) AS BIGINT)), idx)) AS preview_points,
  round(sum(value) FILTER (n <= 48 OR list_contains(list_transform(range(0, 48), lambda j: CAST(floor(j*((n - 1)/47e0) + CASE WHEN j = 47 THEN 1e-6 ELSE 0e0 END) AS BIGINT)), idx)), 6) AS preview_sum
  FROM o GROUP BY ALL""")
def signal_overview(spark, d):
    out = P.signal_overview(lines(spark, d))
    total = F.aggregate(F.filter("preview", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("recording_id", "signal", "available_pct", "missing", "low", "high",
                              F.size("preview").alias("preview_points"), total.alias("preview_sum")))


# --- two hundred columns made of the vectors ----------------------------------------------------------------------------
MANY = 200
MANY_SQL = f"""ids AS (SELECT unnest(range(0, {MANY})) AS k),
  cells AS (SELECT CAST(label AS VARCHAR) AS recording_id, vec_id, k, CASE WHEN (vec_id + k) % 11 <> 0 THEN CAST(embedding[k % 64 + 1] AS DOUBLE) + (k // 64)*CAST(embedding[(7*k + 3) % 64 + 1] AS DOUBLE) END AS v FROM embeddings, ids)"""


def many_columns(spark, d):
    """(recording_id, c0 ... c199) of every vector, some cells missing by rule."""
    at = lambda i: F.element_at("embedding", i + 1).cast("double")
    cell = lambda k: F.when((F.col("vec_id") + k) % 11 != 0, at(k % 64) + (k // 64) * at((7 * k + 3) % 64))
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("recording_id"), *[cell(k).alias(f"c{k}") for k in range(MANY)])


@query("many_correlations", f"""WITH {MANY_SQL} SELECT recording_id, 'c' || a.k AS signal_a, 'c' || b.k AS signal_b, round(abs(corr(a.v, b.v)), 6) AS r
  FROM cells a JOIN cells b USING (recording_id, vec_id) WHERE a.k < b.k AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY recording_id, a.k, b.k""")
def many_correlations(spark, d):
    """All 19,900 pairs of 200 columns, per label."""
    return rounded(P.pairwise_correlation(many_columns(spark, d), [f"c{k}" for k in range(MANY)]))


@query("many_duplicates", f"""WITH {MANY_SQL}, f AS (SELECT vec_id, k, v FROM cells WHERE k < 100 UNION ALL SELECT vec_id, k + 100, v FROM cells WHERE k < 100)
  SELECT 'c' || a.k AS a, 'c' || b.k AS b, bool_and(CASE WHEN a.v IS NULL OR b.v IS NULL THEN a.v IS NULL AND b.v IS NULL ELSE abs(a.v - b.v) <= 1e-8 + 1e-5*abs(b.v) END) AS same
  FROM f a JOIN f b USING (vec_id) WHERE a.k < b.k GROUP BY a.k, b.k""")
def many_duplicates(spark, d):
    """Which of 200 columns, the second hundred a copy of the first, are equal in every row."""
    wide = many_columns(spark, d)
    return columns.duplicate_pairs(wide.select(*[F.col(f"c{k % 100}").alias(f"c{k}") for k in range(MANY)]), [f"c{k}" for k in range(MANY)])
