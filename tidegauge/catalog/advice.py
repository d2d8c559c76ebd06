"""Recommendation, candidate and row-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.base import EV, LI, LIW, SIGNALS, events, events_wide, lines, lines_wide, query, rounded, timing_sql
from tidegauge.catalog.cleaning import CHANGES, RUN, SPEC, cleaned, impute_sql
from tidegauge.catalog.profiling import LINE_PROFILE, line_profile
from tidegauge.domains import IMPUTATION_FIRST, METHODS, OUTLIER_FIRST
from tidegauge.operators import profile as P
from tidegauge.operators import quality as Q
from tidegauge.operators import sample as S
from tidegauge.operators import timeaxis as T
from tidegauge.operators.impute import impute
from tidegauge.plans import clean as C
from tidegauge.plans import recommend as R
from tidegauge.settings import cut, cut_in_place, small
from tidegauge.sources import sinks
from tidegauge.sources.tables import table


NO_DOMAIN = "eye_tracking"  # of recordings that nothing is known of


def advised(spark, d):
    """Aggregate profiles with the domain of the supplier's region, or the default one."""
    prof = P.aggregate_profile(line_profile(spark, d))
    both = prof.join(region_domains(spark, d), "recording_id", "left")
    return both.withColumn("domain", F.coalesce("domain", F.lit(NO_DOMAIN)))


def region_domains(spark, d):
    """(recording_id, domain): one row per supplier, five regions onto five domains."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    names = F.array(*[F.lit(x) for x in ("industrial", "energy", "physiological", "finance", "network")])
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").cast("string").alias("recording_id"), F.element_at(names, F.col("n_regionkey") + 1).alias("domain")))


REGION = """dm AS (SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, ['industrial', 'energy', 'physiological', 'finance', 'network'][n_regionkey + 1] AS domain
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
RULES = f"""{LINE_PROFILE}, {REGION}, rec AS (SELECT recording_id, {', '.join(f'median({m}) AS {m}, max({m}) AS max_{m}' for m in P.METRICS)} FROM prof GROUP BY 1),
  rr AS (SELECT recording_id, domain,
    CASE WHEN missing_rate <= 0 THEN 'none' WHEN n <= 182.5 THEN 'mean' WHEN longest_missing_run_seconds <= 0.1693 THEN CASE WHEN max_local_volatility <= 0.3987 THEN 'linear' ELSE 'locf' END
      WHEN missing_burstiness <= 0.248 THEN 'locf' ELSE 'linear' END AS imputation,
    CASE WHEN domain = 'finance' OR (kurtosis_excess > 8 AND outlier_mad_rate < 0.01) THEN 'none' WHEN spectral_entropy > 0.8184 THEN 'winsorize'
      WHEN max_outlier_iqr_rate <= 0.0233 THEN 'iqr' WHEN max_outlier_mad_rate <= 0.0762 THEN 'mad' ELSE 'zscore' END AS outlier,
    CASE WHEN domain IN ('finance', 'network') OR max_local_volatility > 0.5748 THEN 'none' WHEN skewness > 0.1067 THEN 'butterworth' WHEN dominant_frequency_ratio <= 0.4698 THEN 'savgol' ELSE 'moving_median' END AS smoothing,
    CASE WHEN domain = 'finance' THEN 'none' WHEN greatest(outlier_iqr_rate, outlier_mad_rate) > 0.03 OR kurtosis_excess > 3 THEN 'robust' ELSE 'standard' END AS scaling
  FROM (SELECT rec.*, coalesce(dm.domain, '{NO_DOMAIN}') AS domain FROM rec LEFT JOIN dm USING (recording_id)))"""


@query("recommend_rules", f"{RULES} SELECT recording_id, domain, outlier, imputation, scaling, smoothing FROM rr")
def recommend_rules(spark, d):
    return R.recommended_spec(R.recommend(advised(spark, d)))


@query("recommend_details", f"""{RULES} SELECT recording_id, domain, stage, method, status FROM (
  SELECT recording_id, domain, unnest([{{'stage': 'imputation', 'method': imputation, 'status': 'candidate'}}, {{'stage': 'outlier', 'method': outlier, 'status': 'unstable'}},
    {{'stage': 'smoothing', 'method': smoothing, 'status': 'candidate'}}, {{'stage': 'scaling', 'method': scaling, 'status': 'profile_based'}}], recursive := true) FROM rr)""")
def recommend_details(spark, d):
    return R.recommend(advised(spark, d)).select("recording_id", "domain", "stage", "method", "status")


@query("recommend_irregular", f"""WITH {EV}, {timing_sql('ev')} SELECT recording_id, 'eye_tracking' AS domain, 'none' AS smoothing, irregular FROM tm""")
def recommend_irregular(spark, d):
    """Irregular recordings: no smoothing without resampling."""
    wide = events_wide(spark, d)
    timing = T.diagnostics(wide)
    prof = P.feature_profile(events(spark, d), 1.0, timing=timing, spectrum=False)
    agg = P.aggregate_profile(prof, timing=timing).withColumn("domain", F.lit("eye_tracking"))
    rec = R.recommend(agg).filter(F.col("stage") == "smoothing")
    flag = agg.select("recording_id", F.col("irregular_timestamps").alias("irregular"))
    return rec.select("recording_id", "domain", F.col("method").alias("smoothing")).join(flag, "recording_id")


GRID = f"""g AS (SELECT row_number() OVER (ORDER BY a, b, c, e) AS pipeline_id, imputation, outlier, smoothing, 'none' AS scaling, "order" FROM
  (SELECT unnest(range(0, 2)) AS a, unnest(['{IMPUTATION_FIRST}', '{OUTLIER_FIRST}']) AS "order"), (SELECT unnest(range(0, 7)) AS b, unnest({list(METHODS['imputation'])}) AS imputation),
  (SELECT unnest(range(0, 6)) AS c, unnest({list(METHODS['outlier'])}) AS outlier), (SELECT unnest(range(0, 4)) AS e, unnest({list(METHODS['smoothing'])}) AS smoothing))"""


@query("spec_validity", f"""WITH {EV}, {timing_sql('ev')}, am AS (SELECT recording_id, count(value) = 0 AS all_missing FROM ev GROUP BY 1), {GRID}
  SELECT recording_id, pipeline_id, CASE WHEN irregular AND smoothing <> 'none' THEN 'smoothing needs regular timestamps or resampling'
    WHEN all_missing AND imputation IN ('mean', 'median', 'knn', 'mice') THEN 'method cannot handle an all-missing signal' END AS reason,
    NOT (irregular AND smoothing <> 'none') AND NOT (all_missing AND imputation IN ('mean', 'median', 'knn', 'mice')) AS valid FROM tm JOIN am USING (recording_id) CROSS JOIN g""")
def spec_validity(spark, d):
    """Each of the 336 candidates against the facts of each recording."""
    wide = events_wide(spark, d)
    facts = T.diagnostics(wide).select("recording_id", F.col("irregular_intervals").alias("irregular"))
    gone = wide.df.groupBy("recording_id").agg((F.count("value") == 0).alias("all_missing"))
    out = R.spec_validity(R.grid_for(facts.join(gone, "recording_id")))
    return out.select("recording_id", "pipeline_id", "reason", "valid")


@query("candidate_grid", f"""{RULES}, al AS (SELECT recording_id, [imputation] || list_filter(['linear', 'locf'], lambda x: x <> imputation) AS i, [outlier] || list_filter(['zscore', 'iqr'], lambda x: x <> outlier) AS o,
    [smoothing] || list_filter(['none', 'moving_median'], lambda x: x <> smoothing) AS s FROM rr)
  SELECT recording_id, CAST(4*a + 2*b + c + 1 AS BIGINT) AS candidate, i[a + 1] AS imputation, o[b + 1] AS outlier, s[c + 1] AS smoothing, 'none' AS scaling
  FROM al, range(0, 2) t1(a), range(0, 2) t2(b), range(0, 2) t3(c)""")
def candidate_grid(spark, d):
    spec = R.recommended_spec(R.recommend(advised(spark, d)))
    return R.compact_grid(spec.select("recording_id", "imputation", "outlier", "smoothing"),
                          {"imputation": ["linear", "locf"], "outlier": ["zscore", "iqr"], "smoothing": ["none", "moving_median"]})


PICKS = {"1-URGENT": ("iqr", "linear", None), "2-HIGH": ("", "locf", "savgol"), "3-MEDIUM": ("iqr", "linear", "none"), "4-NOT SPECIFIED": (None, "", None)}


@query("candidate_table", """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS recording_id, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'iqr' ELSE 'none' END AS outlier,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'linear' WHEN o_orderpriority = '2-HIGH' THEN 'locf' ELSE 'mean' END AS imputation,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'savgol' ELSE 'none' END AS smoothing, 'none' AS scaling FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""")
def candidate_table(spark, d):
    """Candidate rows as a user might leave them: blanks, doubles and empty rows."""
    o = table(spark, d, "orders")

    def cell(i: int):
        c = F.when(F.col("o_orderpriority") == "5-LOW", ("none", "mean", "none")[i])
        for k, v in PICKS.items():
            c = c.when(F.col("o_orderpriority") == k, F.lit(v[i]))
        return c
    rows = o.select(F.col("o_custkey").cast("string").alias("recording_id"), cell(0).alias("outlier"), cell(1).alias("imputation"), cell(2).alias("smoothing"))
    return R.candidate_table(rows, ["recording_id"])


@query("clean_run_recommended")
def clean_run_recommended(spark, d):
    """Every recording cleaned with its own recommendation, in one job."""
    spec = R.recommended_spec(R.recommend(advised(spark, d))).drop("domain")
    spec = spec.select("recording_id", *[F.col(x).alias("use_" + x) for x in C.STAGES])
    s = lines(spark, d)
    s = s.on(s.df.join(small(spec, s.groups), "recording_id"))
    methods = {"outlier": ["none", "winsorize", "iqr", "mad", "zscore"], "imputation": ["none", "mean", "linear", "locf"],
               "scaling": ["none", "standard", "robust"], "smoothing": ["none", "moving_median", "savgol", "butterworth"]}
    out = C.execute(s, methods, OUTLIER_FIRST, C.Settings(signals=tuple(SIGNALS)), {x: "use_" + x for x in C.STAGES})
    return rounded(out.df.groupBy("recording_id", "signal", *["use_" + x for x in C.STAGES]).agg(
        F.count("value").alias("available"), F.avg("value").alias("mean"), F.stddev_pop("physical").alias("spread"), F.count_if("detected").alias("flagged")))


@query("audit_record")
def audit_record(spark, d):
    s = cleaned(spark, d)
    s = s.cut() if s.blocked else s.on(cut_in_place(s.df))
    # A row per signal, read for the scores and for the changes.
    before = cut(C.profile_with_corr(C.as_values(s, "raw"), SIGNALS, 50.0))
    after = cut(C.profile_with_corr(C.as_values(s, "physical"), SIGNALS, 50.0))
    scored = [Q.with_index(Q.with_components(P.aggregate_profile(p)), "energy") for p in (before, after)]
    spec = scored[0].select("recording_id", *[F.lit(v).alias(k) for k, v in SPEC.items()], F.lit(OUTLIER_FIRST).alias("order"))
    return sinks.audit_records(*scored, spec, C.stage_changes(s, OUTLIER_FIRST), C.profile_changes(before, after), "energy",
                              parameters=C.stage_parameters(s, OUTLIER_FIRST))


@query("audit_fields", f"""{RUN}, pa AS (SELECT recording_id, signal, count(*) FILTER (detected) AS flagged, count(*) FILTER (after_outlier IS NULL AND after_imputation IS NOT NULL) AS filled FROM rn GROUP BY ALL)
  SELECT recording_id, 'executed' AS status, 'energy' AS domain, 'iqr' AS outlier, 42 AS seed, {CHANGES}, count(DISTINCT signal) AS signals,
    (SELECT sum(flagged)::BIGINT FROM pa WHERE pa.recording_id = rn.recording_id) AS flagged, (SELECT sum(filled)::BIGINT FROM pa WHERE pa.recording_id = rn.recording_id) AS filled FROM rn GROUP BY recording_id""")
def audit_fields(spark, d):
    """The audit records read back: settings, changes, and the parameters of all signals."""
    kinds = ("outlier", "imputation", "scaling", "smoothing", "cleaning", "overall")
    meta = ", ".join(f"{k}_changed_fraction DOUBLE" for k in kinds)
    a = audit_record(spark, d).select("recording_id", F.from_json("audit", f"execution_status STRING, domain STRING, seed INT, executed_pipeline STRUCT<outlier: STRING>, "
                                      f"execution_meta STRUCT<{meta.replace(' DOUBLE', ': DOUBLE')}>, stage_parameters ARRAY<STRUCT<outlier_flagged: BIGINT, imputed_values: BIGINT>>").alias("a"))
    total = lambda f: F.aggregate(F.col("a.stage_parameters"), F.lit(0).cast("long"), lambda s, p: s + p[f])
    return rounded(a.select("recording_id", F.col("a.execution_status").alias("status"), "a.domain", "a.executed_pipeline.outlier", "a.seed", "a.execution_meta.*",
                            F.size("a.stage_parameters").alias("signals"), total("outlier_flagged").alias("flagged"), total("imputed_values").alias("filled")))


@query("processed_table", f"""{RUN}, pv AS (SELECT recording_id, idx, max(value) FILTER (signal = 'quantity') AS quantity, max(value) FILTER (signal = 'price') AS price FROM rn GROUP BY ALL)
  SELECT recording_id, idx, round(pv.quantity, 5) AS quantity, round(pv.price, 5) AS price, round(liw.discount, 5) AS discount, round(liw.tax, 5) AS tax FROM liw JOIN pv USING (recording_id, idx)""")
def processed_table(spark, d):
    original = lines_wide(spark, d).df.drop("t")
    done = cleaned(spark, d)
    out = sinks.processed_table(original, done.df, ["quantity", "price"])
    return rounded(out.select("recording_id", "idx", *SIGNALS), 5)


FAR = ", ".join(f"coalesce(abs({c} - m_{c})/CASE WHEN d_{c} > 0 THEN d_{c} ELSE greatest(s_{c}, 1e-12) END, 0e0)" for c in SIGNALS)
PICKED = f"""WITH {LIW}, x AS (SELECT *, {' OR '.join(f'{c} IS NULL' for c in SIGNALS)} AS g, count(*) OVER (PARTITION BY recording_id) AS n FROM liw),
  gr AS (SELECT recording_id, min(idx) AS s, count(*) AS len FROM (SELECT *, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS k FROM x WHERE g) GROUP BY recording_id, k),
  lg AS (SELECT recording_id, s, len FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY len DESC, s) AS r FROM gr) WHERE r = 1),
  m1 AS (SELECT recording_id, {', '.join(f'median({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SIGNALS)} FROM x GROUP BY 1),
  m2 AS (SELECT recording_id, {', '.join(f'median(abs({c} - m_{c})) AS d_{c}' for c in SIGNALS)} FROM x JOIN m1 USING (recording_id) GROUP BY 1),
  ex AS (SELECT recording_id, idx AS e FROM (SELECT recording_id, idx, row_number() OVER (PARTITION BY recording_id ORDER BY greatest({FAR}) DESC, idx) AS r
    FROM x JOIN m1 USING (recording_id) JOIN m2 USING (recording_id)) WHERE r = 1),
  sz AS (SELECT DISTINCT recording_id, n FROM x),
  ce AS (SELECT recording_id, n, unnest([floor(i*(n - 1)/4e0) FOR i IN range(0, 5)]) AS c FROM sz UNION ALL SELECT recording_id, n, s FROM lg JOIN sz USING (recording_id)
    UNION ALL SELECT recording_id, n, s + len - 1 FROM lg JOIN sz USING (recording_id) UNION ALL SELECT recording_id, n, e FROM ex JOIN sz USING (recording_id)),
  wi AS (SELECT recording_id, greatest(0, least(n - 10, c - 5)) AS a FROM ce),
  fl AS (SELECT x.*, EXISTS (SELECT 1 FROM wi WHERE wi.recording_id = x.recording_id AND x.idx >= a AND x.idx < a + 10) AS hit FROM x),
  fr AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY idx) - 1 AS pos,
    count(*) FILTER (NOT hit) OVER (PARTITION BY recording_id) AS rest, 120 - count(*) FILTER (hit) OVER (PARTITION BY recording_id) AS room FROM fl)
  SELECT recording_id, idx, quantity, round(price, 6) AS price, discount, tax FROM fr WHERE n <= 120 OR hit
    OR list_contains(list_transform(range(0, room), lambda j: CAST(floor(j*((rest - 1)/CAST(room - 1 AS DOUBLE)) + CASE WHEN j = room - 1 THEN 1e-6 ELSE 0e0 END) AS BIGINT)), CAST(pos AS BIGINT))"""


@query("representative_rows", PICKED)
def representative_rows(spark, d):
    """120 rows of each recording."""
    s = S.representative_rows(lines_wide(spark, d), SIGNALS, 120)
    return rounded(s.df.select("recording_id", "idx", *SIGNALS))


def even_sql(n: str, k: int) -> str:
    return (f"({n} <= {k} OR list_contains(list_transform(range(0, {k}), lambda j: CAST(floor(j*(({n} - 1)/{k - 1}e0) + CASE WHEN j = {k - 1} THEN 1e-6 ELSE 0e0 END) AS BIGINT)), idx))")


@query("gap_keeping_decimation", f"""WITH {LI}, x AS (SELECT *, value IS NULL AS g, count(*) OVER (PARTITION BY recording_id, signal) AS n, lag(value IS NULL) OVER w AS gb, lead(value IS NULL) OVER w AS ga FROM li WINDOW w AS (PARTITION BY recording_id, signal ORDER BY idx))
  SELECT recording_id, signal, idx, round(value, 4) AS value FROM x WHERE {even_sql('n', 100)} OR g <> gb OR g <> ga""")
def gap_keeping_decimation(spark, d):
    s = S.decimate(lines(spark, d), 100)
    return rounded(s.df.select("recording_id", "signal", "idx", "value"), 4)


@query("flag_keeping_decimation", f"""WITH {EV}, q AS (SELECT recording_id, signal, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, median(value) AS md, count(value) AS nv FROM ev GROUP BY ALL),
  m AS (SELECT recording_id, signal, median(abs(value - md)) AS mad FROM ev JOIN q USING (recording_id, signal) GROUP BY ALL),
  x AS (SELECT ev.*, value IS NULL AS g, count(*) OVER (PARTITION BY recording_id, signal) AS n,
    coalesce(nv >= 4 AND ((q3 > q1 AND (value < q1 - 1.5e0*(q3 - q1) OR value > q3 + 1.5e0*(q3 - q1))) OR (mad > 0 AND abs(0.67448975e0*(value - md)/mad) > 3.5e0)), false) AS h
    FROM ev JOIN q USING (recording_id, signal) JOIN m USING (recording_id, signal)),
  y AS (SELECT *, lag(g) OVER w AS gb, lead(g) OVER w AS ga, lag(h) OVER w AS hb, lead(h) OVER w AS ha FROM x WINDOW w AS (PARTITION BY recording_id, signal ORDER BY idx))
  SELECT recording_id, signal, idx, round(value, 4) AS value FROM y WHERE {even_sql('n', 20)} OR h OR g <> gb OR g <> ga OR hb OR ha""")
def flag_keeping_decimation(spark, d):
    s = S.decimate(events(spark, d), 20, flagged=True)
    return rounded(s.df.select("recording_id", "signal", "idx", "value"), 4)


@query("method_difference_window", f"""WITH {EV}, {impute_sql('ev', 'a', 'linear')}, {impute_sql('ev', 'b', 'locf')},
  x AS (SELECT recording_id, signal, min(idx) FILTER (abs(a.value - b.value) > 1e-9 + 1e-7*abs(b.value) OR (a.value IS NULL) <> (b.value IS NULL)) AS f, max(idx) + 1 AS n FROM a JOIN b USING (recording_id, signal, idx) GROUP BY ALL)
  SELECT recording_id, signal, greatest(0, f - 60) AS start, least(n, greatest(greatest(0, f - 60) + 320, f + 60)) AS stop FROM x WHERE f IS NOT NULL""")
def method_difference_window(spark, d):
    s = impute(events(spark, d), ["linear", "locf"])
    return rounded(S.difference_window(s, ["imp_linear", "imp_locf"]))


@query("imputed_segments", f"""WITH {EV}, {impute_sql('ev', 'a', 'linear')}, x AS (SELECT *, before IS NULL AND value IS NOT NULL AS f FROM a),
  y AS (SELECT *, coalesce(lag(f) OVER w, false) AS fb, coalesce(lead(f) OVER w, false) AS fa FROM x WINDOW w AS (PARTITION BY recording_id, signal ORDER BY idx)),
  z AS (SELECT *, last_value(CASE WHEN f AND NOT fb THEN idx END IGNORE NULLS) OVER (PARTITION BY recording_id, signal ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM y)
  SELECT recording_id, signal, idx, st AS segment, round(value, 5) AS value FROM z WHERE f
  UNION ALL SELECT recording_id, signal, idx, idx + 1, round(before, 5) FROM z WHERE before IS NOT NULL AND fa
  UNION ALL SELECT recording_id, signal, idx, st, round(before, 5) FROM z WHERE before IS NOT NULL AND fb""")
def imputed_segments(spark, d):
    s = impute(events(spark, d), ["linear"])
    return rounded(S.filled_segments(s, "value", "imp_linear").drop("t"), 5)


@query("fingerprint")
def fingerprint(spark, d):
    dig = S.fingerprint(lines_wide(spark, d), SIGNALS)
    return dig.join(S.context_key(dig, {"domain": "energy", "rate": 50}), "recording_id")


ALTERED = "quantity = 13 AND idx % 31 = 3 AND price IS NOT NULL"


@query("fingerprint_changes", f"WITH {LIW} SELECT recording_id, count(*) AS rows, bool_or(coalesce({ALTERED}, false)) AS differs FROM liw GROUP BY 1")
def fingerprint_changes(spark, d):
    """Which recordings' digests tell that a cent was added to some prices; rows in another order change none."""
    s = lines_wide(spark, d)
    price = F.when(F.expr(ALTERED), F.col("price") + 0.01).otherwise(F.col("price"))
    altered = s.on(s.df.withColumn("price", price).repartition("idx"))
    key = lambda x, name: S.context_key(S.fingerprint(x, SIGNALS), {"domain": "energy"}).withColumnRenamed("context_key", name)
    both = key(s, "a").join(key(altered, "b"), "recording_id").join(S.fingerprint(s, SIGNALS).select("recording_id", "rows"), "recording_id")
    return rounded(both.select("recording_id", "rows", (F.col("a") != F.col("b")).alias("differs")))
