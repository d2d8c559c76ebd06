"""Reading, column roles, validity and recording detection queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidegauge.catalog.base import EV, LIW, events_wide, lines_wide, query, rounded, timing_sql
from tidegauge.domains import DOMAIN_KEYWORDS, SIGNAL_PRIORITY
from tidegauge.functions.series import Series, measure, ordered_index
from tidegauge.operators import columns as M
from tidegauge.operators import timeaxis as T
from tidegauge.operators import validity as V
from tidegauge.settings import checkpoint_dir
from tidegauge.sources import blocks as B
from tidegauge.sources import delimited as D
from tidegauge.sources.sinks import write_table
from tidegauge.sources.tables import recordings, table


def text_lines(spark, d):
    """Line items as an export would hold them: text with units, decimal commas and missing tokens."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("Participant"),
        F.concat(F.translate(F.col("l_quantity").cast("string"), ".", ","), F.lit(" kg")).alias("quantity"),
        F.when(F.col("l_returnflag") == "R", " NA ").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("%"))).alias("share"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise(F.col("l_linenumber").cast("string")).alias("mixed"),
        F.when(F.col("l_returnflag") == "A", "--").otherwise(F.col("l_linestatus")).alias("status"))


@query("numeric_promotion", """WITH x AS (SELECT l_quantity AS q, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS s FROM lineitem)
  SELECT count(q) AS quantity_n, round(sum(q), 4) AS quantity_sum, count(s) AS share_n, round(CAST(sum(s) AS DOUBLE), 4) AS share_sum,
  'string,double,double,string,string' AS types FROM x""")
def numeric_promotion(spark, d):
    out = M.promote(text_lines(spark, d))
    kinds = ",".join(k for _, k in out.dtypes)
    return rounded(out.agg(F.count("quantity").alias("quantity_n"), F.sum("quantity").alias("quantity_sum"), F.count("share").alias("share_n"),
                           F.sum("share").alias("share_sum"), F.lit(kinds).alias("types")), 4)


@query("missing_tokens", """SELECT l_suppkey AS supplier, count(*) FILTER (l_returnflag = 'R') AS share_missing, count(*) FILTER (l_returnflag = 'A') AS status_missing
  FROM lineitem GROUP BY 1""")
def missing_tokens(spark, d):
    t = text_lines(spark, d)
    return rounded(t.groupBy(F.col("Participant").cast("long").alias("supplier")).agg(
        F.count_if(M.missing_to_null(F.col("share")).isNull()).alias("share_missing"),
        F.count_if(M.missing_to_null(F.col("status")).isNull()).alias("status_missing")))


@query("signal_columns", """SELECT * FROM (VALUES ('load', true, true), ('demand', true, true), ('constant', false, false), ('sample_id', true, false),
  ('elapsed', true, false)) t(name, varies, signal) WHERE (SELECT count(*) FROM lineitem) > 0""")
def signal_columns(spark, d):
    li = table(spark, d, "lineitem")
    return M.signal_table(li.select(F.col("l_quantity").alias("load"), F.col("l_extendedprice").alias("demand"), F.lit(1.0).alias("constant"),
                                    F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("elapsed")))


@query("duplicate_signals", """SELECT * FROM (SELECT 'quantity' AS a, 'price' AS b, bool_and(abs(l_quantity - l_extendedprice) <= 1e-8 + 1e-5*abs(l_extendedprice)) AS same FROM lineitem
  UNION ALL SELECT 'quantity', 'copy', true UNION ALL SELECT 'quantity', 'flagged', false UNION ALL SELECT 'price', 'copy', bool_and(abs(l_quantity - l_extendedprice) <= 1e-8 + 1e-5*abs(l_quantity)) FROM lineitem
  UNION ALL SELECT 'price', 'flagged', false UNION ALL SELECT 'copy', 'flagged', false)""")
def duplicate_signals(spark, d):
    li = table(spark, d, "lineitem")
    t = li.select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * (1 + 1e-9)).alias("copy"),
                  F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("flagged"))
    return M.duplicate_pairs(t, t.columns)


@query("preferred_clock", f"""WITH {EV}, {timing_sql('ev')} SELECT recording_id, CASE WHEN n >= 2 THEN 'recording_time' ELSE 'clock' END AS "column", n >= 2 AS valid FROM tm""")
def preferred_clock(spark, d):
    """Three candidates: one without a known unit, one that repeats values, and the real clock."""
    s = events_wide(spark, d)
    clocks = {"clock": F.lit(None).cast("double"), "time_of_pair": F.floor(F.col("idx") / 2).cast("double"), "recording_time": F.col("t")}
    return T.preferred_clock(s, clocks)


@query("unit_guidance", f"""WITH {LIW} SELECT recording_id, 'microseconds' AS unit, 'verified' AS confidence, 5e1 AS rate_hz FROM liw GROUP BY 1 HAVING count(*) >= 10""")
def unit_guidance(spark, d):
    """A microsecond clock without a unit in its name, next to a duration in milliseconds."""
    s = lines_wide(spark, d).stats({"_n": F.count(F.lit(1))})
    s = s.on(s.df.withColumn("clock", F.col("idx") * 20000.0).withColumn("duration", (F.col("_n") - 1) * 20.0))
    return rounded(T.unit_guidance(s, "clock", ["Recording timestamp", "Gaze point X"], "Recording timestamp", "duration"))


@query("unit_guidance_by_rate", f"""WITH {LIW} SELECT recording_id, 'milliseconds' AS unit, 'unverified' AS confidence, 5e1 AS rate_hz FROM liw GROUP BY 1 HAVING count(*) >= 10""")
def unit_guidance_by_rate(spark, d):
    s = lines_wide(spark, d)
    s = s.with_column("clock", F.col("idx") * 20.0)
    return rounded(T.unit_guidance(s, "clock", ["timestamp", "gaze_x"], "timestamp"))


# Line items under the names of an energy log.
ROLES = {"elapsed_time": "l_linenumber", "sample_id": "l_orderkey", "voltage": "l_tax", "load_copy": "l_quantity*(1 + 1e-9)", "Load kW": "l_quantity",
         "temperature": "l_partkey", "demand": "l_discount", "power": "l_extendedprice", "solar_constant": "1e0", "consumption": "l_suppkey"}


def _roles_sql() -> str:
    names = list(ROLES)
    words = [(d, i, w) for i, (d, ws) in enumerate(DOMAIN_KEYWORDS.items()) for w in ws]
    first = ", ".join(f"('{w}', {i})" for i, w in enumerate(SIGNAL_PRIORITY["energy"]))
    same = [(a, b, f"bool_and(abs({ROLES[a]} - {ROLES[b]}) <= 1e-8 + 1e-5*abs({ROLES[b]}))") for a in names for b in names if a != b]
    return f"""WITH st AS (SELECT unnest({names}) AS name, unnest([{', '.join(f'min({c}) < max({c})' for c in ROLES.values())}]) AS varies FROM lineitem),
      ro AS (SELECT *, regexp_matches(lower(name), 'time|elapsed|duration|date|clock') AS time_candidate,
        varies AND NOT regexp_matches(lower(name), 'time|elapsed|duration|date|clock|sample_?id') AS signal FROM st),
      kw(d, i, w) AS (VALUES {', '.join(f"('{d}', {i}, '{w}')" for d, i, w in words)}),
      dm AS (SELECT d AS domain FROM ro, kw GROUP BY d, i
        ORDER BY sum((len(name) - len(replace(lower(name), w, '')))/len(w)*CASE WHEN signal THEN 2 ELSE 1 END) DESC, i LIMIT 1),
      pr(w, i) AS (VALUES {first}),
      ra AS (SELECT name, row_number() OVER (ORDER BY coalesce((SELECT min(i) FROM pr WHERE contains(replace(lower(name), ' ', '_'), w)), 99), len(name), lower(name)) AS place
        FROM ro WHERE signal),
      sm AS (SELECT unnest({[a for a, _, _ in same]}) AS a, unnest({[b for _, b, _ in same]}) AS b, unnest([{', '.join(x for *_, x in same)}]) AS same FROM lineitem),
      gr AS (SELECT r.name, r.place, coalesce((SELECT arg_min(e.name, e.place) FROM ra e JOIN sm ON sm.a = e.name AND sm.b = r.name AND sm.same WHERE e.place < r.place), r.name) AS first_equal FROM ra r),
      df AS (SELECT name, row_number() OVER (ORDER BY place) <= 5 AS chosen FROM gr WHERE first_equal = name)
      SELECT ro.name, time_candidate, signal, (SELECT domain FROM dm) AS domain, place, first_equal, coalesce(chosen, false) AS by_default
      FROM ro LEFT JOIN gr USING (name) LEFT JOIN df USING (name)"""


@query("column_roles", _roles_sql())
def column_roles(spark, d):
    """What each column is: clock, signal of the domain found, its place, the signal it repeats, chosen by default."""
    t = table(spark, d, "lineitem").select(*[F.expr(e).alias(n) for n, e in ROLES.items()])
    columns, signals = M.column_table(spark, t.columns), M.numeric_signals(t)
    domain = M.infer_domain(columns, signals).first()["domain"]
    ranked = [r["name"] for r in M.ranked_signals(columns.filter(F.col("name").isin(signals)), domain).collect()]
    first = {n: g[0] for g in M.duplicate_groups(t, ranked) for n in g}
    chosen = M.default_signals(t, ranked)
    clocks = [r["name"] for r in M.time_candidates(columns).collect()]
    rows = [(n, n in clocks, n in ranked, domain, ranked.index(n) + 1 if n in ranked else None, first.get(n, n) if n in ranked else None, n in chosen) for n in t.columns]
    return spark.createDataFrame(rows, "name string, time_candidate boolean, signal boolean, domain string, place long, first_equal string, by_default boolean")


# clock column: how an export writes it (Spark), the number it stands for (SQL), unit found, seconds per unit
CLOCKS = {
    "Recording time [ms]": ("CAST(unix_micros(ts) div 1000 AS STRING)", "CAST(epoch_us(ts) // 1000 AS DOUBLE)", "milliseconds", "1e-3"),
    "date_text": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "CAST(epoch_us(ts) // 1000000 AS DOUBLE)", "date/time", "1e0"),
    "day": ("if(event_type = 'error', 'not known', CAST(unix_micros(ts) div 86400000000 AS STRING))",
            "CASE WHEN event_type <> 'error' THEN CAST(epoch_us(ts) // 86400000000 AS DOUBLE) END", "days", "86400e0"),
    "tick": ("CAST(event_id AS STRING)", "CAST(event_id AS DOUBLE)", None, None),
}


def _clocks_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    parts = " UNION ALL ".join(
        f"SELECT CAST(user_id AS VARCHAR) AS recording_id, '{n}' AS col, {text(u)} AS unit, {k or 'NULL'} AS scale, event_id AS o, {v} AS c FROM events"
        for n, (_, v, u, k) in CLOCKS.items())
    return f"""WITH x AS ({parts}), y AS (SELECT *, c - lag(c) OVER (PARTITION BY recording_id, col ORDER BY o) AS step FROM x WHERE c IS NOT NULL),
      m AS (SELECT recording_id, col, count(*) AS n, arg_min(c, o) AS origin, count(*) FILTER (step <= 0) AS bad, median(step) FILTER (step > 0) AS md,
        min(step) FILTER (step > 0) AS lo, max(step) FILTER (step > 0) AS hi FROM y GROUP BY ALL),
      a AS (SELECT recording_id, col, unit, scale, count(*) FILTER (c IS NULL) AS missing FROM x GROUP BY ALL)
      SELECT recording_id, col AS "column", 'auto' AS unit_selection, unit AS original_unit, CAST(scale AS DOUBLE) AS seconds_per_original_unit, origin,
        missing AS missing_timestamps, coalesce(bad, 0) AS non_increasing_steps, coalesce(greatest(hi - md, md - lo) > 0.05e0*md, false) AS irregular_intervals,
        CASE WHEN coalesce(n, 0) < 2 OR md IS NULL THEN 'Needs two usable values and a positive interval' WHEN scale IS NULL THEN 'Timestamp unit is ambiguous' ELSE 'ok' END AS status
      FROM a LEFT JOIN m USING (recording_id, col)"""


@query("clock_parsing", _clocks_sql())
def clock_parsing(spark, d):
    """Text clocks of every user's events: a number with its unit in the name, dates, days with holes, and an unknown unit."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = e.select("user_id", "event_id", *[F.expr(x[0]).alias(n) for n, x in CLOCKS.items()])
    out = None
    for n in CLOCKS:
        parsed = T.parse_clock(text, n)
        s = recordings(parsed, F.col("user_id"), ["event_id"], F.col("event_id"), {"clock": F.col("clock")}, rate_hz=1.0)
        is_date = bool(parsed.select("is_date").first()[0]) if parsed.take(1) else False
        one = T.axis_metadata(s, "clock", n, is_date=is_date)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def gaze_table(spark, d):
    """Line items shaped like a binocular gaze export."""
    li = table(spark, d, "lineitem")
    n, q, f, st = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    return li.select(
        F.col("l_suppkey").cast("string").alias("recording_id"),
        F.when(n == 7, 0.0).otherwise(q).alias("Point of Regard Left X [px]"), F.when(n.isin(6, 7), 0.0).otherwise(q).alias("Point of Regard Left Y [px]"),
        F.when(n == 1, None).otherwise(q).alias("Gaze Right X (px)"), q.alias("Gaze Right Y (px)"),
        F.when(f == "R", " Blink ").otherwise("Fixation").alias("Category Left"), F.when(f == "A", "blinking").otherwise("Saccade").alias("Category Right"),
        F.when(st == "O", " INVALID").otherwise("Valid").alias("Validity left"), F.when(n == 2, "Invalid").otherwise("Valid").alias("Validity right"),
        F.when((f == "N") & (n == 3), 1).otherwise(0).alias("missing"), F.when(f == "N", "Mouse").otherwise(" Eye Tracker ").alias("Sensor"))


GZ = """gz AS (SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS lx, CASE WHEN l_linenumber IN (6, 7) THEN 0 ELSE l_quantity END AS ly,
  CASE WHEN l_linenumber <> 1 THEN l_quantity END AS rx, l_quantity AS ry, l_returnflag = 'R' AS lb, l_returnflag = 'A' AS rb, l_linestatus = 'O' AS li, l_linenumber = 2 AS ri,
  l_returnflag = 'N' AND l_linenumber = 3 AS mi, l_returnflag <> 'N' AS et FROM lineitem)"""
LEFT_GAZE = ["Point of Regard Left X [px]", "Point of Regard Left Y [px]"]
RIGHT_GAZE = ["Gaze Right X (px)", "Gaze Right Y (px)"]


@query("gaze_availability", f"""WITH {GZ}, o AS (SELECT recording_id, 'Left' AS eye, '{LEFT_GAZE[0]}' AS x_column, '{LEFT_GAZE[1]}' AS y_column, lx IS NULL OR ly IS NULL AS g, lx = 0 AND ly = 0 AS z, lb AS b FROM gz
  UNION ALL SELECT recording_id, 'Right', '{RIGHT_GAZE[0]}', '{RIGHT_GAZE[1]}', rx IS NULL OR ry IS NULL, coalesce(rx = 0 AND ry = 0, false), rb FROM gz)
  SELECT recording_id, eye, x_column, y_column, count(*) FILTER (g) AS explicit_missing_pairs, count(*) FILTER (z) AS paired_zero, count(*) FILTER (b) AS blink_labels, count(*) FILTER (g OR z OR b) AS unavailable,
  round(100e0*count(*) FILTER (z)/count(*), 6) AS paired_zero_pct, round(100e0*count(*) FILTER (b)/count(*), 6) AS blink_labels_pct, round(100e0*count(*) FILTER (g OR z OR b)/count(*), 6) AS unavailable_pct FROM o GROUP BY ALL""")
def gaze_availability(spark, d):
    return rounded(V.availability(gaze_table(spark, d), ["recording_id"]))


@query("gaze_validity", f"""WITH {GZ} SELECT recording_id, count(*) FILTER (lx IS NOT NULL AND NOT (lx = 0 AND ly = 0) AND NOT lb) AS left_pairs,
  round(sum(lx) FILTER (NOT (lx = 0 AND ly = 0) AND NOT lb), 4) AS left_sum, count(rx) FILTER (NOT coalesce(rx = 0 AND ry = 0, false) AND NOT rb) AS right_pairs,
  count(*) FILTER (NOT (lx = 0 AND ly = 0)) AS left_pairs_zero_only FROM gz GROUP BY 1""")
def gaze_validity(spark, d):
    g = gaze_table(spark, d)
    full = V.gaze_validity(g, V.ZERO_BLINK).groupBy("recording_id").agg(
        F.count(f"`{LEFT_GAZE[0]}`").alias("left_pairs"), F.sum(f"`{LEFT_GAZE[0]}`").alias("left_sum"), F.count(f"`{RIGHT_GAZE[0]}`").alias("right_pairs"))
    zero = V.gaze_validity(g, V.ZERO).groupBy("recording_id").agg(F.count(f"`{LEFT_GAZE[0]}`").alias("left_pairs_zero_only"))
    return rounded(full.join(zero, "recording_id"), 4)


@query("gaze_validity_log", f"""WITH {GZ}, o AS (SELECT recording_id, 'Left' AS eye, '{LEFT_GAZE[0]}' AS x_column, lx IS NULL OR ly IS NULL AS g, lx = 0 AND ly = 0 AS z, lb AS b FROM gz
  UNION ALL SELECT recording_id, 'Right', '{RIGHT_GAZE[0]}', rx IS NULL OR ry IS NULL, coalesce(rx = 0 AND ry = 0, false), rb FROM gz)
  SELECT recording_id, eye, x_column, count(*) FILTER (z) AS paired_zero, count(*) FILTER (b) AS blink_labels, count(*) FILTER (g OR z OR b) AS unavailable_after, count(*) FILTER ((z OR b) AND NOT g) AS newly_unavailable FROM o GROUP BY ALL""")
def gaze_validity_log(spark, d):
    return rounded(V.gaze_validity_log(gaze_table(spark, d), V.ZERO_BLINK, ["recording_id"]))


@query("validity_options", f"""WITH {GZ}, o AS (SELECT recording_id, 'eye_tracker_rows' AS key, count(*) FILTER (NOT et) AS rows, count(*) FILTER (et) AS seen FROM gz GROUP BY 1
  UNION ALL SELECT recording_id, 'missing_flags', count(*) FILTER (mi), 1 FROM gz GROUP BY 1 UNION ALL SELECT recording_id, 'validity_flags', count(*) FILTER (li OR ri), 1 FROM gz GROUP BY 1)
  SELECT recording_id, key, rows FROM o WHERE rows > 0 AND seen > 0""")
def validity_options(spark, d):
    return rounded(V.validity_options(gaze_table(spark, d), ["recording_id"]))


@query("gaze_rows", f"WITH {GZ} SELECT recording_id, count(*) FILTER (et) AS kept_rows, count(*) FILTER (NOT et) AS excluded_rows, count(*) FILTER (et) AS remaining FROM gz GROUP BY 1")
def gaze_rows(spark, d):
    g = gaze_table(spark, d)
    left = V.gaze_rows(g).groupBy("recording_id").agg(F.count(F.lit(1)).alias("remaining"))
    return rounded(V.gaze_rows_log(g, ["recording_id"]).join(left, "recording_id"))


@query("flag_validity", f"""WITH {GZ} SELECT recording_id, count(lx) FILTER (NOT mi AND NOT li) AS left_x, count(rx) FILTER (NOT mi AND NOT ri) AS right_x, round(sum(ry) FILTER (NOT mi AND NOT ri), 4) AS right_y_sum FROM gz GROUP BY 1""")
def flag_validity(spark, d):
    g = V.flag_validity(gaze_table(spark, d), LEFT_GAZE + RIGHT_GAZE, True, True)
    # The point-of-regard names carry no gaze word, so only the gaze columns follow the eye labels.
    g = V.flag_validity(g.withColumnsRenamed({LEFT_GAZE[0]: "Gaze Left X", LEFT_GAZE[1]: "Gaze Left Y"}), ["Gaze Left X", "Gaze Left Y"], False, True)
    return rounded(g.groupBy("recording_id").agg(F.count("`Gaze Left X`").alias("left_x"), F.count(f"`{RIGHT_GAZE[0]}`").alias("right_x"), F.sum(f"`{RIGHT_GAZE[1]}`").alias("right_y_sum")), 4)


@query("flag_validity_log", f"""WITH {GZ}, o AS (SELECT recording_id, '{RIGHT_GAZE[0]}' AS signal, 'missing == 1' AS reason, mi AS f, rx IS NULL AS g FROM gz UNION ALL SELECT recording_id, '{RIGHT_GAZE[1]}', 'missing == 1', mi, ry IS NULL FROM gz
  UNION ALL SELECT recording_id, '{RIGHT_GAZE[0]}', 'Validity right == Invalid', ri, rx IS NULL OR mi FROM gz UNION ALL SELECT recording_id, '{RIGHT_GAZE[1]}', 'Validity right == Invalid', ri, ry IS NULL OR mi FROM gz)
  SELECT recording_id, signal, reason, count(*) FILTER (f) AS flagged_rows, count(*) FILTER (f AND NOT g) AS new_missing FROM o GROUP BY ALL""")
def flag_validity_log(spark, d):
    return rounded(V.flag_validity_log(gaze_table(spark, d), RIGHT_GAZE, True, True, ["recording_id"]))


@query("paired_zeros", f"""WITH {GZ} SELECT recording_id, '{LEFT_GAZE[0]}' AS x, '{LEFT_GAZE[1]}' AS y, count(*) FILTER (lx = 0 AND ly = 0) AS rows FROM gz GROUP BY 1 HAVING count(*) FILTER (lx = 0 AND ly = 0) > 0""")
def paired_zeros(spark, d):
    return rounded(V.paired_zeros(gaze_table(spark, d), ["recording_id"]))


@query("paired_zero_mask", f"""WITH {GZ} SELECT recording_id, signal, count(*) FILTER (z) AS flagged_rows, count(*) FILTER (z AND NOT g) AS new_missing, count(*) FILTER (NOT z AND NOT g) AS left_over FROM (
  SELECT recording_id, '{LEFT_GAZE[0]}' AS signal, lx = 0 AND ly = 0 AS z, lx IS NULL AS g FROM gz UNION ALL SELECT recording_id, '{LEFT_GAZE[1]}', lx = 0 AND ly = 0, ly IS NULL FROM gz) GROUP BY ALL""")
def paired_zero_mask(spark, d):
    g = gaze_table(spark, d)
    log = V.mask_paired_zeros_log(g, LEFT_GAZE, ["recording_id"])
    m = V.mask_paired_zeros(g, LEFT_GAZE)
    left = m.groupBy("recording_id").agg(*[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(LEFT_GAZE)])
    left = left.select("recording_id", F.inline(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(f"c{i}").alias("left_over")) for i, c in enumerate(LEFT_GAZE)])))
    return rounded(log.join(left, ["recording_id", "signal"]))


def day_log(spark, d):
    """All events as one source, in order, with a day label and a user label."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, d, "events").select(F.lit("log").alias("source"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("Recording name"),
                                         F.col("user_id").cast("string").alias("Participant"), "value")
    longest, groups = measure(e, ["source"])
    return Series(ordered_index(e, ["source"], ["event_id"], F.col("event_id"), longest, groups), ("source",), longest, groups)


DAYS = """dl AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, strftime(ts, '%Y-%m-%d') AS label, value FROM events),
  ch AS (SELECT *, CASE WHEN lag(label) OVER (ORDER BY idx) = label THEN 0 ELSE 1 END AS o FROM dl),
  bl AS (SELECT *, sum(o) OVER (ORDER BY idx) - 1 AS block FROM ch),
  rn AS (SELECT block, min(idx) AS start, max(idx) + 1 AS stop, max(label) AS label FROM bl GROUP BY 1)"""


@query("recording_blocks", f"""WITH {DAYS} SELECT 'log' AS source, 'Recording name' AS "column", CAST(block AS BIGINT) AS block, start, stop, label FROM rn
  WHERE (SELECT count(*) BETWEEN 2 AND 150 AND median(stop - start) >= 30 AND avg(CASE WHEN stop - start >= 30 THEN 1e0 ELSE 0e0 END) >= 0.8 FROM rn)""")
def recording_blocks(spark, d):
    return rounded(B.detect_blocks(day_log(spark, d), ["event_id", "Recording name", "Participant", "value"]))


@query("recordings_from_blocks", f"""WITH {DAYS} SELECT 'log#' || min(idx) AS recording_id, max(label) AS label, count(*) AS rows, round(sum(value), 4) AS total FROM bl GROUP BY block""")
def recordings_from_blocks(spark, d):
    s = B.with_blocks(day_log(spark, d), "Recording name")
    return rounded(s.df.groupBy("recording_id").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")), 4)


@query("adapter", """SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, round(sum(l_orderkey/1e6), 4) AS clock_sum, count(*) FILTER (l_returnflag <> 'R' OR l_linestatus = 'O') AS gaze_n,
  round(sum(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN (l_quantity + l_tax)/2 WHEN l_returnflag <> 'R' THEN l_quantity WHEN l_linestatus = 'O' THEN l_tax END), 4) AS gaze_sum FROM lineitem GROUP BY 1""")
def adapter(spark, d):
    """Two eyes as text with decimal commas, each with its own missing samples, on a microsecond clock."""
    li = table(spark, d, "lineitem")
    comma = lambda c: F.translate(F.col(c).cast("string"), ".", ",")
    raw = li.select(F.col("l_suppkey").cast("string").alias("recording_id"), F.col("l_orderkey").cast("string").alias("Recording timestamp"),
                    F.when(F.col("l_returnflag") != "R", comma("l_quantity")).otherwise("").alias("left x"), F.when(F.col("l_linestatus") == "O", comma("l_tax")).otherwise("-").alias("right x"))
    out = D.adapt(raw, {"gaze_x": ["left x", "right x"]}, "Recording timestamp", 1e-6, ["recording_id"])
    return rounded(out.groupBy("recording_id").agg(F.sum("timestamp").alias("clock_sum"), F.count("gaze_x").alias("gaze_n"), F.sum("gaze_x").alias("gaze_sum")), 4)


def scratch(spark, name: str) -> str:
    """A new folder below the checkpoint folder all executors share."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("delimited_round_trip", """SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total, ';' AS separator, ',' AS decimal, 'utf-8-sig' AS encoding FROM events GROUP BY 1""")
def delimited_round_trip(spark, d):
    """The events as text files with semicolons and decimal commas: written, sniffed and read back."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = scratch(spark, "delimited")
    e = table(spark, d, "events").select("event_type", F.translate(F.format_string("%.2f", F.col("value")), ".", ",").alias("reading"))
    e.write.option("header", True).option("sep", ";").csv(path)
    told = D.dialects(spark, path).agg(F.min("separator").alias("separator"), F.min("decimal").alias("decimal"), F.min("encoding").alias("encoding")).first()
    back = D.read_delimited(spark, path)
    return rounded(back.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("reading").alias("total"))
                   .select("*", *[F.lit(told[c]).alias(c) for c in ("separator", "decimal", "encoding")]), 4)


@query("delimited_mixed_folder", """SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total,
  count(*) FILTER (event_id % 3 = 0) AS noted, 3 AS layouts FROM events GROUP BY 1""")
def delimited_mixed_folder(spark, d):
    """The events as files of three layouts in one folder: other separators, decimal marks, column orders and columns."""
    path = scratch(spark, "mixed")
    e = table(spark, d, "events").select("event_type", F.format_string("%.2f", F.col("value")).alias("reading"), "event_id")
    comma = F.translate("reading", ".", ",").alias("reading")
    part = lambda k: e.filter(F.pmod("event_id", F.lit(3)) == k)
    part(0).select("event_type", comma, F.lit("x").alias("note")).write.option("header", True).option("sep", ";").csv(f"{path}/a")
    part(1).select("reading", "event_type").write.option("header", True).option("sep", "|").csv(f"{path}/b")
    part(2).select("event_type", "reading").write.option("header", True).csv(f"{path}/c")
    told = D.layouts(spark, f"{path}/*").filter("status = 'ok'").agg(F.count_distinct("separator", "header").alias("layouts")).first()
    back = D.read_delimited(spark, f"{path}/*")
    return rounded(back.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("reading").alias("total"), F.count("note").alias("noted"))
                   .withColumn("layouts", F.lit(told["layouts"])), 4)


@query("export_table", """SELECT CAST(l_suppkey AS VARCHAR) AS supplier, count(*) AS rows, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1""")
def export_table(spark, d):
    """A table written as CSV and read back with its declared types."""
    path = scratch(spark, "export")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("supplier"), F.col("l_extendedprice").alias("price"))
    write_table(li, path)
    back = spark.read.option("header", True).schema("supplier string, price double").csv(path)
    return rounded(back.groupBy("supplier").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("total")), 2)
