"""Outlier, imputation, scaling, smoothing and pipeline queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidegauge.catalog.base import (EV, LI, LIW, SIGNALS, corr_sql, events, events_wide, filled_sql, lines, lines_wide, pivot_sql,
                                    profile_sql, query, rounded, rounded_product, timing_sql)
from tidegauge.catalog.profiling import component_sql, index_sql
from tidegauge.domains import OUTLIER_FIRST
from tidegauge.operators import forest, knn, mice, scale, smooth
from tidegauge.operators import outliers as O
from tidegauge.operators import profile as P
from tidegauge.operators import timeaxis as T
from tidegauge.operators.impute import gap_limits, impute
from tidegauge.plans import clean as C
from tidegauge.sources.tables import as_long, recordings, table

KEYS = "recording_id, signal, idx"


# --- SQL for single stages: each reads CTE src(recording_id, signal, idx, t, value) and makes CTE dst ----------------
def outlier_sql(src: str, dst: str, method: str) -> str:
    """dst has value (cleaned) and flagged."""
    lim = {
        "zscore": ("count(value) AS nv, avg(value) AS m, stddev_pop(value) AS sd", "nv >= 8 AND sd > 0 AND abs(value - m)/sd > 3"),
        "iqr": ("count(value) AS nv, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3",
                "nv >= 8 AND q3 > q1 AND (value < q1 - 1.5e0*(q3 - q1) OR value > q3 + 1.5e0*(q3 - q1))"),
        "winsorize": ("quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi",
                      "abs(greatest(lo, least(hi, value)) - value) > 1e-8 + 1e-5*abs(value)"),
        "none": ("1 AS one", "false"),
        "mad": ("count(value) AS nv, median(value) AS med", "nv >= 8 AND mad > 0 AND abs(0.67448975e0*(value - med)/mad) > 3.5e0"),
    }[method]
    extra = ""
    if method == "mad":
        extra = (f" JOIN (SELECT recording_id, signal, median(abs(value - med)) AS mad FROM {src} JOIN {dst}_l USING (recording_id, signal)"
                 " GROUP BY ALL) USING (recording_id, signal)")
    out = {"winsorize": "CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END"}.get(
        method, f"CASE WHEN NOT ({lim[1]}) THEN value END")
    return f"""{dst}_l AS (SELECT recording_id, signal, {lim[0]} FROM {src} GROUP BY ALL),
{dst} AS (SELECT {KEYS}, t, {out} AS value, coalesce({lim[1]}, false) AS flagged, value AS before
  FROM {src} JOIN {dst}_l USING (recording_id, signal){extra})"""


def impute_sql(src: str, dst: str, method: str, max_gap: str | None = None) -> str:
    guess = {"mean": "avg(value) OVER wa", "median": "median(value) OVER wa", "locf": "pv",
             "linear": "(nv - pv)/(nt - pt)*(t - pt) + pv", "none": "CAST(NULL AS DOUBLE)"}[method]
    limit = "" if max_gap is None else f" AND nt - pt <= {max_gap} + 1e-12"
    return f"""{dst}_a AS (
  SELECT {KEYS}, t, value, last_value(value IGNORE NULLS) OVER wf AS pv,
    last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER wf AS pt,
    first_value(value IGNORE NULLS) OVER wb AS nv,
    first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER wb AS nt
  FROM {src}
  WINDOW wf AS (PARTITION BY recording_id, signal ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    wb AS (PARTITION BY recording_id, signal ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{dst} AS (
  SELECT {KEYS}, t, value AS before,
    coalesce(value, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL{limit} THEN {guess} END) AS value
  FROM {dst}_a WINDOW wa AS (PARTITION BY recording_id, signal))"""


def scale_sql(src: str, dst: str, method: str) -> str:
    c, w = {"standard": ("avg(value)", "stddev_pop(value)"), "minmax": ("min(value)", "max(value) - min(value)"),
            "robust": ("median(value)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")}[method]
    return f"""{dst}_l AS (SELECT recording_id, signal, {c} AS center, CASE WHEN {w} = 0 THEN 1e0 ELSE {w} END AS width FROM {src} GROUP BY ALL),
{dst} AS (SELECT {KEYS}, t, value AS before, (value - center)/width AS value, center, width FROM {src} JOIN {dst}_l USING (recording_id, signal))"""


def segment_sql(src: str, dst: str, max_gap: str | None = None) -> str:
    """dst: observed rows with seg, pos in the segment and its length."""
    gap = "" if max_gap is None else f" OR t - lag(t) OVER w > {max_gap}"
    return f"""{dst} AS (
  SELECT {KEYS}, t, value, seg, row_number() OVER (PARTITION BY recording_id, signal, seg ORDER BY idx) - 1 AS pos,
    count(*) OVER (PARTITION BY recording_id, signal, seg) AS len
  FROM (SELECT *, sum(opens) OVER (PARTITION BY recording_id, signal ORDER BY idx) AS seg FROM (
    SELECT {KEYS}, t, value, CASE WHEN value IS NOT NULL AND (lag(value) OVER w IS NULL{gap}) THEN 1 ELSE 0 END AS opens
    FROM {src} WINDOW w AS (PARTITION BY recording_id, signal ORDER BY idx)))
  WHERE value IS NOT NULL)"""


def median_sql(src: str, dst: str, max_gap: str | None = None) -> str:
    """Nine positions around each sample, held at the segment's ends, and their median."""
    return f"""{segment_sql(src, dst + '_s', max_gap)},
{dst}_p AS (
  SELECT recording_id, signal, seg, pos, greatest(0, least(len - 1, pos + k)) AS at
  FROM {dst}_s, (SELECT unnest(range(-4, 5)) AS k) WHERE len >= 9),
{dst}_m AS (
  SELECT p.recording_id, p.signal, p.seg, p.pos, median(v.value) AS smooth
  FROM {dst}_p p JOIN {dst}_s v ON v.recording_id = p.recording_id AND v.signal = p.signal AND v.seg = p.seg AND v.pos = p.at
  GROUP BY ALL),
{dst} AS (
  SELECT s.recording_id, s.signal, s.idx, s.t, s.value AS before, CASE WHEN o.len < 9 THEN o.value ELSE m.smooth END AS value
  FROM {src} s LEFT JOIN {dst}_s o USING (recording_id, signal, idx)
  LEFT JOIN {dst}_m m ON m.recording_id = o.recording_id AND m.signal = o.signal AND m.seg = o.seg AND m.pos = o.pos)"""


ROWS = "SELECT recording_id, signal, idx, round(value, 6) AS value"


def emit(s, *extra):
    return rounded(s.df.select("recording_id", "signal", "idx", *extra))


def _outlier(method):
    @query("outlier_" + method if method != "winsorize" else "winsorize",
           f"WITH {EV}, {outlier_sql('ev', 'o', method)} {ROWS}, flagged FROM o")
    def run(spark, d):
        s = O.handle(events(spark, d), [method])
        return emit(s, F.col("out_" + method).alias("value"), F.col("flag_" + method).alias("flagged"))


for _m in ("zscore", "iqr", "mad", "winsorize"):
    _outlier(_m)


@query("outlier_audit", f"""WITH {LI}, {outlier_sql('li', 'z', 'zscore')}, {outlier_sql('li', 'i', 'iqr')}, {outlier_sql('li', 'm', 'mad')},
  {outlier_sql('li', 'w', 'winsorize')},
  md AS (SELECT recording_id, signal, median(abs(value - med)) AS mad FROM li JOIN m_l USING (recording_id, signal) GROUP BY ALL)
  SELECT z_l.recording_id, z_l.signal, z_l.nv AS available, round(m + 1e-9, 4) AS mean, round(sd, 6) AS std, round(q1, 6) AS q1, round(q3, 6) AS q3,
    round(q1 - 1.5e0*(q3 - q1), 6) AS lower, round(q3 + 1.5e0*(q3 - q1), 6) AS upper, round(med, 6) AS median, round(mad, 6) AS mad,
    round(lo, 6) AS winsor_low, round(hi, 6) AS winsor_high,
    {', '.join(f"(SELECT count(*) FILTER (flagged) FROM {c} WHERE {c}.recording_id = z_l.recording_id AND {c}.signal = z_l.signal) AS flagged_{n}"
               for c, n in (('z', 'zscore'), ('i', 'iqr'), ('m', 'mad'), ('w', 'winsorize')))},
    CASE WHEN z_l.nv < 8 THEN 'skipped_insufficient_observations' WHEN sd > 0 THEN 'applied' ELSE 'no_spread' END AS zscore_status,
    CASE WHEN z_l.nv < 8 THEN 'skipped_insufficient_observations' WHEN q3 > q1 THEN 'applied' ELSE 'no_spread' END AS iqr_status,
    CASE WHEN z_l.nv < 8 THEN 'skipped_insufficient_observations' WHEN mad > 0 THEN 'applied' ELSE 'no_spread' END AS mad_status
  FROM z_l JOIN i_l USING (recording_id, signal) JOIN m_l USING (recording_id, signal) JOIN md USING (recording_id, signal) JOIN w_l USING (recording_id, signal)""")
def outlier_audit(spark, d):
    out = O.audit(lines(spark, d))
    # Means of cents often lie half way between two roundings: the offset decides those alike in both engines.
    return rounded(out.withColumn("mean", F.round(F.col("mean") + 1e-9, 4)))


@query("isolation_forest")
def isolation_forest(spark, d):
    """Share of flagged rows and the highest score per recording."""
    s = lines_wide(spark, d)
    scores = forest.row_scores(s, SIGNALS)
    return rounded(scores.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") > 0.5).alias("flagged"), F.max("score").alias("highest")))


def _impute(method):
    @query("impute_" + method, f"WITH {EV}, {impute_sql('ev', 'o', method)} {ROWS} FROM o")
    def run(spark, d):
        s = impute(events(spark, d), [method])
        return emit(s, F.col("imp_" + method).alias("value"))


for _m in ("mean", "median", "locf", "linear"):
    _impute(_m)

DAY = 86400.0


@query("impute_within_gap_limit", f"WITH {EV}, {impute_sql('ev', 'o', 'linear', '86400e0')} {ROWS} FROM o")
def impute_within_gap_limit(spark, d):
    s = impute(events(spark, d), ["linear"], DAY)
    return emit(s, F.col("imp_linear").alias("value"))


@query("impute_one_long_recording", f"WITH {EV.replace('CAST(user_id AS VARCHAR)', chr(39) + 'all' + chr(39)).replace('PARTITION BY user_id ', '')}, {impute_sql('ev', 'o', 'linear')} {ROWS} FROM o")
def impute_one_long_recording(spark, d):
    """The block plan: the whole table is one recording."""
    s = impute(events(spark, d, one=True, block=1024), ["linear"])
    return emit(s, F.col("imp_linear").alias("value"))


@query("gap_limits", f"""WITH {EV}, {impute_sql('ev', 'o', 'linear', '86400e0')}, {impute_sql('ev', 'u', 'linear')}
  SELECT recording_id, signal, count(*) FILTER (o.before IS NULL) AS missing, count(*) FILTER (o.before IS NULL AND o.value IS NOT NULL) AS fillable,
    count(*) FILTER (o.before IS NULL AND u.value IS NULL) AS boundary FROM o JOIN u USING (recording_id, signal, idx) GROUP BY ALL""")
def gap_limit_counts(spark, d):
    return rounded(gap_limits(events(spark, d), DAY))


KNN = f"""WITH {LIW}, st AS (SELECT recording_id, count(*) AS n, {', '.join(f'avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END AS s_{c}' for c in SIGNALS)} FROM liw GROUP BY 1),
z AS (SELECT recording_id, idx, {', '.join(f'{c}, ({c} - a_{c})/s_{c} AS z_{c}' for c in SIGNALS)},
  greatest(2, least(7, CAST(floor(sqrt(greatest(4, n))) AS BIGINT)//4)) AS k, a_price, a_discount FROM liw JOIN st USING (recording_id)),
q AS (SELECT recording_id, 'price' AS signal, idx, k, z_quantity, z_price, z_discount, z_tax, a_price AS mean FROM z WHERE price IS NULL
  UNION ALL SELECT recording_id, 'discount', idx, k, z_quantity, z_price, z_discount, z_tax, a_discount FROM z WHERE discount IS NULL),
p AS (
  SELECT q.recording_id, q.signal, q.idx, q.k, q.mean, d.idx AS di, CASE q.signal WHEN 'price' THEN d.price ELSE d.discount END AS y,
    (coalesce((q.z_quantity - d.z_quantity)**2, 0e0) + coalesce((q.z_price - d.z_price)**2, 0e0) + coalesce((q.z_discount - d.z_discount)**2, 0e0)
      + coalesce((q.z_tax - d.z_tax)**2, 0e0))*4/nullif(CASE WHEN q.z_price IS NULL OR d.z_price IS NULL THEN 0 ELSE 1 END
      + CASE WHEN q.z_discount IS NULL OR d.z_discount IS NULL THEN 0 ELSE 1 END + 2, 0) AS d2
  FROM q JOIN z d ON d.recording_id = q.recording_id AND CASE q.signal WHEN 'price' THEN d.price ELSE d.discount END IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, signal, idx ORDER BY CASE WHEN d2 > 0 THEN round(d2 * pow(10, 11 - floor(log10(d2)))) / pow(10, 11 - floor(log10(d2))) ELSE 0 END, di) AS rk FROM p),
o AS (SELECT recording_id, signal, idx, CASE WHEN min(d2) = 0 THEN avg(y) FILTER (d2 = 0) ELSE sum(y/sqrt(d2)) FILTER (d2 > 0)/sum(1/sqrt(d2)) FILTER (d2 > 0) END AS estimate
  FROM r WHERE rk <= k GROUP BY ALL)
SELECT recording_id, signal, idx, round(estimate, 5) AS estimate FROM o"""


@query("knn_impute", KNN)
def knn_impute(spark, d):
    return rounded(rounded_product(knn.estimates(lines_wide(spark, d), SIGNALS), 5), 5)


TAX_GONE = "l_linenumber = 7 AND l_quantity = 50"


@query("knn_impute_one_long_recording", f"""WITH li AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, l_extendedprice AS price,
    CASE WHEN NOT ({TAX_GONE}) THEN l_tax END AS tax FROM lineitem),
  z AS (SELECT idx, tax, price, greatest(2, least(7, CAST(floor(sqrt(greatest(4, (SELECT count(*) FROM li)))) AS BIGINT)//4)) AS k FROM li),
  p AS (SELECT q.idx, q.k, d.idx AS di, d.tax AS y, 2*(q.price - d.price)**2 AS d2 FROM z q JOIN z d ON q.tax IS NULL AND d.tax IS NOT NULL AND abs(q.price - d.price) < 5e3),
  r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY CASE WHEN d2 > 0 THEN round(d2 * pow(10, 11 - floor(log10(d2)))) / pow(10, 11 - floor(log10(d2))) ELSE 0 END, di) AS rk FROM p)
  SELECT 'all' AS recording_id, 'tax' AS signal, idx, round(CASE WHEN min(d2) = 0 THEN avg(y) FILTER (d2 = 0) ELSE sum(y/sqrt(d2)) FILTER (d2 > 0)/sum(1/sqrt(d2)) FILTER (d2 > 0) END, 5) AS estimate
  FROM r WHERE rk <= k GROUP BY idx""")
def knn_impute_one_long_recording(spark, d):
    """The block plan: the whole table is one recording, its neighbours found by price as it is (cents make exact ties)."""
    li = table(spark, d, "lineitem")
    s = recordings(li, F.lit("all"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_orderkey"),
                   {"price": F.col("l_extendedprice"), "tax": F.when(~F.expr(TAX_GONE), F.col("l_tax"))}, rate_hz=50.0, block=4096)
    return rounded(rounded_product(knn.estimates(s, ["price", "tax"], scaled=False), 5), 5)


@query("mice_impute")
def mice_impute(spark, d):
    return rounded(mice.estimates(lines_wide(spark, d), SIGNALS), 5)


def _scale(method):
    @query("scale_" + method, f"WITH {EV}, {scale_sql('ev', 'o', method)} {ROWS} FROM o")
    def run(spark, d):
        return emit(scale.scale(events(spark, d), method), "value")


for _m in ("standard", "minmax", "robust"):
    _scale(_m)


@query("scale_inverse", f"""WITH {LI}, {scale_sql('li', 'o', 'robust')} SELECT recording_id, signal, count(value) AS available,
  round(min(value*width + center), 6) AS low, round(max(value*width + center), 6) AS high, round(max(center), 6) AS center, round(max(width), 6) AS width,
  true AS same FROM o GROUP BY ALL""")
def scale_inverse(spark, d):
    """Back in physical units, compared with the input."""
    s = lines(spark, d).with_column("raw", F.col("value"))
    s = scale.scale(s, "robust").with_column("back", scale.restored(F.col("value")))
    return rounded(s.summary({
        "available": F.count("value"), "low": F.min("back"), "high": F.max("back"), "center": F.max("center"), "width": F.max("width"),
        "same": F.bool_and(F.coalesce(F.abs(F.col("back") - F.col("raw")) <= 1e-9 * F.abs(F.col("raw")) + 1e-9, F.lit(True)))}))


@query("smooth_moving_median", f"WITH {LI}, {median_sql('li', 'o')} {ROWS} FROM o")
def smooth_moving_median(spark, d):
    s = smooth.smooth(lines(spark, d), ["moving_median"])
    return emit(s, F.col("smo_moving_median").alias("value"))


@query("smooth_split_at_interruptions", f"WITH {EV}, {median_sql('ev', 'o', '86400e0')} {ROWS} FROM o")
def smooth_split_at_interruptions(spark, d):
    """Segments also end where observed neighbours are more than a day apart."""
    s = smooth.smooth(events(spark, d), ["moving_median"], max_gap=DAY)
    return emit(s, F.col("smo_moving_median").alias("value"))


def hat_values() -> str:
    """Least-squares cubic smoother matrices of every odd window, as SQL rows (w, i, j, c)."""
    rows = []
    for w in range(9, 22, 2):
        x = np.arange(w) - w // 2
        v = np.vander(x.astype(float), 4)
        h = v @ np.linalg.inv(v.T @ v) @ v.T
        rows += [f"({w},{i},{j},{float(h[i, j])!r}e0)" if "e" not in repr(float(h[i, j])) else f"({w},{i},{j},{float(h[i, j])!r})"
                 for i in range(w) for j in range(w)]
    return ", ".join(rows)


SAVGOL = f"""WITH {LI}, {segment_sql('li', 'sg')}, hat(w, i, j, c) AS (VALUES {hat_values()}),
  p AS (SELECT *, least(21, CASE WHEN len % 2 = 1 THEN len ELSE len - 1 END) AS w FROM sg WHERE len >= 9),
  e AS (SELECT *, CASE WHEN pos < w//2 THEN pos WHEN pos >= len - w//2 THEN w - (len - pos) ELSE w//2 END AS i,
    CASE WHEN pos < w//2 THEN 0 WHEN pos >= len - w//2 THEN len - w ELSE pos - w//2 END AS base FROM p),
  m AS (SELECT e.recording_id, e.signal, e.idx, sum(h.c*x.value) AS smooth
    FROM e JOIN hat h ON h.w = e.w AND h.i = e.i JOIN sg x ON x.recording_id = e.recording_id AND x.signal = e.signal AND x.idx = e.idx - e.pos + e.base + h.j
    GROUP BY ALL)
  SELECT recording_id, signal, idx, round(coalesce(smooth, value), 5) AS value FROM li LEFT JOIN m USING (recording_id, signal, idx)"""


@query("smooth_savgol", SAVGOL)
def smooth_savgol(spark, d):
    s = smooth.smooth(lines(spark, d), ["savgol"])
    return rounded(s.df.select("recording_id", "signal", "idx", F.col("smo_savgol").alias("value")), 5)


def impulse_values(taps: int = 80) -> str:
    h = smooth.butterworth_response(taps)
    return ", ".join(f"({k}, CAST('{float(v)!r}' AS DOUBLE))" for k, v in enumerate(h))


BUTTER = f"""WITH {LI}, {segment_sql('li', 'sg')}, h(k, c) AS (VALUES {impulse_values()}),
  p AS (SELECT *, recording_id || '/' || signal || '/' || seg AS g FROM sg WHERE len > 12),
  ends AS (SELECT g, min(len) AS len, arg_min(value, pos) AS x0, arg_max(value, pos) AS x1 FROM p GROUP BY g),
  ext AS (SELECT g, pos + 12 AS q, value AS x FROM p
    UNION ALL SELECT g, 12 - pos, 2*x0 - value FROM p JOIN ends USING (g) WHERE pos BETWEEN 1 AND 12
    UNION ALL SELECT g, 12 + ends.len - 1 + (ends.len - 1 - pos), 2*x1 - value FROM p JOIN ends USING (g) WHERE ends.len - 1 - pos BETWEEN 1 AND 12),
  f0 AS (SELECT g, arg_min(x, q) AS s FROM ext GROUP BY g),
  fw AS (SELECT a.g, a.q, max(s) + sum(h.c*(b.x - s)) AS y FROM ext a JOIN f0 USING (g) CROSS JOIN h JOIN ext b ON b.g = a.g AND b.q = a.q - h.k GROUP BY a.g, a.q),
  b0 AS (SELECT g, arg_max(y, q) AS s FROM fw GROUP BY g),
  bw AS (SELECT a.g, a.q, max(s) + sum(h.c*(b.y - s)) AS y FROM fw a JOIN b0 USING (g) CROSS JOIN h JOIN fw b ON b.g = a.g AND b.q = a.q + h.k GROUP BY a.g, a.q),
  m AS (SELECT p.recording_id, p.signal, p.idx, y FROM p JOIN bw ON bw.g = p.g AND bw.q = p.pos + 12)
  SELECT recording_id, signal, idx, round(coalesce(y, value), 5) AS value FROM li LEFT JOIN m USING (recording_id, signal, idx)"""


@query("smooth_butterworth", BUTTER)
def smooth_butterworth(spark, d):
    s = smooth.smooth(lines(spark, d), ["butterworth"])
    return rounded(s.df.select("recording_id", "signal", "idx", F.col("smo_butterworth").alias("value")), 5)


def timed_events(spark, d):
    """Events with the sampling rate and regularity of their recording."""
    wide = events_wide(spark, d)
    timing = T.diagnostics(wide)
    side = timing.select("recording_id", F.col("sampling_rate_hz").alias("fs"), F.col("irregular_intervals").alias("irregular"))
    return as_long(wide.attach(side), ["value"], keep=("idx", "t", "fs", "irregular")), timing


RESAMPLED = f"""WITH {EV}, {timing_sql('ev')}, {segment_sql('ev', 'sg')},
  p AS (SELECT sg.*, (t - first_value(t) OVER g)/eff AS gp FROM sg JOIN tm USING (recording_id) WINDOW g AS (PARTITION BY recording_id, seg ORDER BY idx)),
  b AS (SELECT *, lead(gp) OVER g AS gn, lead(value) OVER g AS vn FROM p WHERE len >= 9 WINDOW g AS (PARTITION BY recording_id, seg ORDER BY idx)),
  grid AS (SELECT recording_id, seg, unnest(range(0, greatest(2, CAST(ceil(g1) AS BIGINT) + 1))) AS q, g1, v1 FROM (SELECT recording_id, seg, max(gp) AS g1, arg_max(value, gp) AS v1 FROM b GROUP BY ALL)),
  gv AS (SELECT grid.recording_id, grid.seg, q, CASE WHEN q >= g1 THEN v1 ELSE (vn - value)/(gn - gp)*(q - gp) + value END AS x
    FROM grid ASOF LEFT JOIN b ON b.recording_id = grid.recording_id AND b.seg = grid.seg AND b.gp <= grid.q),
  gs AS (SELECT *, count(*) OVER (PARTITION BY recording_id, seg) AS n FROM gv),
  gm AS (SELECT recording_id, seg, q, CASE WHEN n < 9 THEN x ELSE list_sort(list_concat(list_concat(
      list_resize([]::DOUBLE[], greatest(0, 4 - q), first_value(x) OVER a), list(x) OVER w),
      list_resize([]::DOUBLE[], greatest(0, 4 - (n - 1 - q)), last_value(x) OVER a)))[5] END AS y
    FROM gs WINDOW a AS (PARTITION BY recording_id, seg ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
      w AS (PARTITION BY recording_id, seg ORDER BY q ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
  m AS (SELECT b.recording_id, b.idx, CASE WHEN b.gp = floor(b.gp) OR hi.y IS NULL THEN lo.y ELSE (hi.y - lo.y)*(b.gp - lo.q) + lo.y END AS y
    FROM b JOIN gm lo ON lo.recording_id = b.recording_id AND lo.seg = b.seg AND lo.q = floor(b.gp)
    LEFT JOIN gm hi ON hi.recording_id = b.recording_id AND hi.seg = b.seg AND hi.q = floor(b.gp) + 1)
  SELECT recording_id, signal, idx, round(coalesce(y, value), 5) AS value FROM ev LEFT JOIN m USING (recording_id, idx)"""


@query("smooth_resampled", RESAMPLED)
def smooth_resampled(spark, d):
    s, _ = timed_events(spark, d)
    s = smooth.smooth(s, ["moving_median"], irregular=F.col("irregular"), resample=True, fs=F.col("fs"))
    return rounded(s.df.select("recording_id", "signal", "idx", F.col("smo_moving_median").alias("value")), 5)


@query("smoothing_settings_log", f"""WITH {LI}, {segment_sql('li', 'sg')} SELECT recording_id, signal, CASE WHEN len < 9 THEN 'skipped' ELSE 'applied' END AS status,
  CASE WHEN len >= 9 THEN least(21, CASE WHEN len % 2 = 1 THEN len ELSE len - 1 END) END AS window_samples, count(*) AS segments,
  CAST(sum(len) AS BIGINT) AS samples FROM sg WHERE pos = 0 GROUP BY ALL""")
def smoothing_settings_log(spark, d):
    return rounded(smooth.settings_log(lines(spark, d), "savgol"))


# --- whole runs -----------------------------------------------------------------
SPEC = {"outlier": "iqr", "imputation": "linear", "scaling": "standard", "smoothing": "moving_median"}
RUN = f"""WITH {LI}, {outlier_sql('li', 's1', 'iqr')}, {impute_sql('s1', 's2', 'linear')}, {scale_sql('s2', 's3', 'standard')}, {median_sql('s3', 's4')},
  rn AS (SELECT li.recording_id, li.signal, li.idx, li.t, li.value AS raw, s1.value AS after_outlier, s1.flagged AS detected, s2.value AS after_imputation,
    s3.value AS after_scaling, s4.value AS value, s4.value*s3.width + s3.center AS physical
  FROM li JOIN s1 USING (recording_id, signal, idx) JOIN s2 USING (recording_id, signal, idx) JOIN s3 USING (recording_id, signal, idx) JOIN s4 USING (recording_id, signal, idx))"""


def cleaned(spark, d, spec=None, order=OUTLIER_FIRST):
    return C.run_one(lines(spark, d), spec or SPEC, order, C.Settings(signals=tuple(SIGNALS)))


@query("clean_run", f"{RUN} SELECT recording_id, signal, idx, round(value, 6) AS value, round(physical, 5) AS physical, detected FROM rn")
def clean_run(spark, d):
    s = cleaned(spark, d)
    return rounded(s.df.select("recording_id", "signal", "idx", "value", F.round("physical", 5).alias("physical"), "detected"))


REVERSE = f"""WITH {LI}, {impute_sql('li', 's1', 'median')}, {outlier_sql('s1', 's2', 'winsorize')}
  SELECT recording_id, signal, idx, round(value, 5) AS value, flagged AS detected FROM s2"""


@query("clean_run_imputation_first", REVERSE)
def clean_run_imputation_first(spark, d):
    s = cleaned(spark, d, {"imputation": "median", "outlier": "winsorize"}, "imputation_outlier_smoothing_scaling")
    return rounded(s.df.select("recording_id", "signal", "idx", "value", "detected"), 5)


def close_sql(a, b):
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0e0 WHEN {a} IS NULL OR {b} IS NULL THEN 1e0 WHEN abs({a} - {b}) <= 1e-8 + 1e-5*abs({b}) THEN 0e0 ELSE 1e0 END"


CHANGES = ", ".join(f"round(avg({close_sql(a, b)}), 6) AS {n}_changed_fraction" for a, b, n in (
    ("raw", "after_outlier", "outlier"), ("after_outlier", "after_imputation", "imputation"), ("after_imputation", "after_scaling", "scaling"),
    ("after_scaling", "value", "smoothing"), ("raw", "physical", "cleaning"), ("raw", "value", "overall")))


@query("changed_fraction", f"{RUN} SELECT recording_id, {CHANGES} FROM rn GROUP BY 1")
def changed_fraction(spark, d):
    return rounded(C.stage_changes(cleaned(spark, d), OUTLIER_FIRST))


@query("stage_metrics", f"""{RUN}, sp AS (SELECT recording_id, signal, min(after_scaling) AS lo, max(after_scaling) AS hi, stddev_pop(after_scaling) AS sd FROM rn GROUP BY ALL)
  SELECT recording_id, round(avg(CASE WHEN after_outlier IS NULL AND after_imputation IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS imputed_fraction,
  round(avg(CASE WHEN detected AND raw IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS outlier_affected_fraction,
  round(avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END), 6) AS remaining_missing_fraction,
  (SELECT round(median(lo), 6) FROM sp WHERE sp.recording_id = rn.recording_id) AS scaled_min_median,
  (SELECT round(median(hi), 6) FROM sp WHERE sp.recording_id = rn.recording_id) AS scaled_max_median,
  (SELECT round(median(sd), 6) FROM sp WHERE sp.recording_id = rn.recording_id) AS scaled_std_median FROM rn GROUP BY recording_id""")
def stage_metrics(spark, d):
    return rounded(C.stage_metrics(cleaned(spark, d), OUTLIER_FIRST))


@query("stage_parameters", f"""{RUN} SELECT recording_id, signal, round(min(after_outlier), 6) AS outlier_lowest_kept, round(max(after_outlier), 6) AS outlier_highest_kept,
  count(*) FILTER (detected) AS outlier_flagged, count(*) FILTER (after_outlier IS NULL AND after_imputation IS NOT NULL) AS imputed_values,
  round(min(after_imputation) FILTER (after_outlier IS NULL), 6) AS imputed_lowest, round(max(after_imputation) FILTER (after_outlier IS NULL), 6) AS imputed_highest,
  round(avg(after_imputation), 6) AS scaling_center, round(CASE WHEN stddev_pop(after_imputation) > 0 THEN stddev_pop(after_imputation) ELSE 1e0 END, 6) AS scaling_width,
  count(*) FILTER (value IS NULL) AS remaining_missing, count(*) AS rows FROM rn GROUP BY ALL""")
def stage_parameters(spark, d):
    return rounded(C.stage_parameters(cleaned(spark, d), OUTLIER_FIRST))


def volatility_sql(pre: str, column: str) -> str:
    return f"""{pre}s AS (SELECT recording_id, signal, idx, t, {column} AS value FROM rn), {filled_sql(pre + 's', pre=pre)},
  {pre}g AS (SELECT *, x - lag(x) OVER (PARTITION BY recording_id, signal ORDER BY idx) AS dx FROM {pre}f),
  {pre}v AS (SELECT recording_id, signal, CASE WHEN count(value) < 4 THEN 0e0 ELSE stddev_pop(dx)/(stddev_pop(x) + 1e-12) END AS vol FROM {pre}g GROUP BY ALL),
  {pre}m AS (SELECT recording_id, median(vol) AS vol FROM {pre}v GROUP BY 1)"""


@query("smoothing_volatility", f"""{RUN}, {volatility_sql('vb', 'after_scaling')}, {volatility_sql('va', 'value')}
  SELECT recording_id, round(b.vol, 6) AS volatility_before, round(a.vol, 6) AS volatility_after, round(a.vol - b.vol, 6) AS volatility_delta FROM vbm b JOIN vam a USING (recording_id)""")
def smoothing_volatility(spark, d):
    return rounded(C.smoothing_volatility(cleaned(spark, d), OUTLIER_FIRST))


DELTAS = ["missing_rate", "outlier_iqr_rate", "local_volatility", "drift_score", "lag1_autocorr", "spectral_entropy", "corr_mean_abs"]


@query("profile_delta", f"""{RUN}, {corr_sql()}, {profile_sql('li', corr='cm')}, ph AS (SELECT recording_id, signal, idx, t, physical AS value FROM rn),
  {pivot_sql('ph', 'phw')}, {corr_sql('phw').replace('cor AS', 'cor2 AS').replace('FROM cor', 'FROM cor2').replace('cm AS (', 'cm2 AS (')}, {profile_sql('ph', pre='z', corr='cm2')}
  SELECT recording_id, signal, {', '.join(f'round(a.{m}, 6) AS before_{m}, round(b.{m}, 6) AS after_{m}, round(b.{m} - a.{m}, 6) AS delta_{m}' for m in DELTAS)}
  FROM prof a JOIN zprof b USING (recording_id, signal)""")
def profile_delta(spark, d):
    s = cleaned(spark, d).cut()
    before = C.profile_with_corr(C.as_values(s, "raw"), SIGNALS, 50.0)
    after = C.profile_with_corr(C.as_values(s, "physical"), SIGNALS, 50.0)
    out = C.profile_changes(before, after)
    return rounded(out.select("recording_id", "signal", *[f"{k}_{m}" for m in DELTAS for k in ("before", "after", "delta")]))


COMPARED = ["none", "zscore", "iqr", "mad", "winsorize"]


def _comparison_sql() -> str:
    parts = [f"WITH {LI}"]
    for m in COMPARED:
        parts += [outlier_sql("li", "a_" + m, m), impute_sql("a_" + m, "b_" + m, "linear")]
    union = " UNION ALL ".join(f"SELECT recording_id || '|{m}' AS recording_id, signal, idx, t, value FROM b_{m}" for m in COMPARED)
    raw = "SELECT recording_id || '|raw' AS recording_id, signal, idx, t, value FROM li"
    parts += [f"al AS ({union} UNION ALL {raw})", pivot_sql("al", "alw"), corr_sql("alw"), profile_sql("al", corr="cm"),
              "rec AS (SELECT recording_id, " + ", ".join(f"median({m}) AS {m}" for m in P.METRICS) + " FROM prof GROUP BY 1)",
              f"rs AS (SELECT *, {component_sql()} FROM rec)",
              f"qq AS (SELECT split_part(recording_id, '|', 1) AS r, split_part(recording_id, '|', 2) AS method, *, {index_sql('energy')} AS q FROM rs)"]
    return ", ".join(parts) + """ SELECT a.r AS recording_id, a.method, round(a.q, 5) AS quality_index, round(a.q - b.q, 5) AS quality_delta, round(a.missing_rate, 6) AS missing_rate,
      round(greatest(a.outlier_iqr_rate, a.outlier_mad_rate), 6) AS outlier_rate, round(a.local_volatility, 6) AS local_volatility
      FROM qq a JOIN qq b ON a.r = b.r AND b.method = 'raw' WHERE a.method <> 'raw'"""


@query("method_comparison", _comparison_sql())
def method_comparison(spark, d):
    """Five outlier methods before linear imputation; every series is copied per method once."""
    out = C.compare_stage(lines(spark, d), "outlier", COMPARED, {"imputation": "linear"}, OUTLIER_FIRST, C.Settings(signals=tuple(SIGNALS)), "energy", 50.0)
    return rounded(out.select("recording_id", "method", F.round("quality_index", 5).alias("quality_index"), F.round("quality_delta", 5).alias("quality_delta"),
                              "missing_rate", "outlier_rate", "local_volatility"))
