"""Registry, the recordings made from the given tables, and shared SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.series import Series
from tidegauge.settings import BLOCK_ROWS
from tidegauge.sources.tables import as_long, recordings, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIGNALS = ["quantity", "price", "discount", "tax"]
LINE_RATE = 50.0


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded_product(df: DataFrame, digits: int) -> DataFrame:
    """Like `rounded`, doubles as the SQL engine rounds them: the product with a power of ten decides what lies half way."""
    unit = F.lit(10.0 ** digits)
    return df.select(*[(F.round(F.col(f"`{n}`") * unit) / unit + F.lit(0.0)).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as long, in the given column order."""
    cols = []
    for n, kind in df.dtypes:
        c = F.col(f"`{n}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("long")
        cols.append(c.alias(n))
    return df.select(*cols)


def events_wide(spark: SparkSession, folder: str, one: bool = False, block: int = BLOCK_ROWS) -> Series:
    """One recording per user (or one for the whole table); a reading marked 'error' is not valid."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, folder, "events")
    return recordings(
        e, F.lit("all") if one else F.col("user_id"), ["event_id"], F.col("event_id"),
        {"value": F.when(F.col("event_type") != "error", F.col("value"))},
        clock=F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6), block=block)


def events(spark: SparkSession, folder: str, one: bool = False, block: int = BLOCK_ROWS) -> Series:
    return as_long(events_wide(spark, folder, one, block), ["value"])


def lines_wide(spark: SparkSession, folder: str, block: int = BLOCK_ROWS) -> Series:
    """One recording per supplier at a declared 50 Hz; two signals have invalid samples."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    li = table(spark, folder, "lineitem")
    flag = lambda r, s: (F.col("l_returnflag") == r) & (F.col("l_linestatus") == s)
    return recordings(
        li, F.col("l_suppkey"),
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
        F.unix_micros(F.col("l_shipdate").cast("timestamp")),
        {"quantity": F.col("l_quantity"), "price": F.when(~flag("R", "O"), F.col("l_extendedprice")),
         "discount": F.when(~flag("A", "F"), F.col("l_discount")), "tax": F.col("l_tax")},
        rate_hz=LINE_RATE, block=block)


def lines(spark: SparkSession, folder: str, block: int = BLOCK_ROWS) -> Series:
    return as_long(lines_wide(spark, folder, block), SIGNALS)


def embeddings(spark: SparkSession, folder: str, rate: float = 64.0) -> Series:
    """One short regular recording per vector."""
    e = table(spark, folder, "embeddings")
    df = e.select(F.col("vec_id").cast("string").alias("recording_id"), F.lit("embedding").alias("signal"),
                  F.posexplode("embedding").alias("idx", "value"))
    df = df.select("recording_id", "signal", F.col("idx").cast("long").alias("idx"),
                   (F.col("idx") / F.lit(rate)).alias("t"), F.col("value").cast("double").alias("value"))
    row = e.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    return Series(df, ("recording_id", "signal"), int(row[0]), int(row[1]))


# --- the same recordings in SQL ----------------------------------------------
EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS recording_id, 'value' AS signal,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx,
    epoch_us(ts)/1e6 - first_value(epoch_us(ts)/1e6) OVER (PARTITION BY user_id ORDER BY event_id) AS t,
    CASE WHEN event_type <> 'error' THEN value END AS value
  FROM events)"""
EV1 = """ev AS (
  SELECT 'all' AS recording_id, 'value' AS signal, row_number() OVER (ORDER BY event_id) - 1 AS idx,
    epoch_us(ts)/1e6 - first_value(epoch_us(ts)/1e6) OVER (ORDER BY event_id) AS t,
    CASE WHEN event_type <> 'error' THEN value END AS value
  FROM events)"""
LIW = """liw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS recording_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
      l_quantity, l_extendedprice) - 1 AS idx,
    l_quantity AS quantity,
    CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'O') THEN l_extendedprice END AS price,
    CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'F') THEN l_discount END AS discount,
    l_tax AS tax
  FROM lineitem)"""
LI = LIW + """, li AS (
  SELECT recording_id, 'quantity' AS signal, idx, idx/5e1 AS t, quantity AS value FROM liw
  UNION ALL SELECT recording_id, 'price', idx, idx/5e1, price FROM liw
  UNION ALL SELECT recording_id, 'discount', idx, idx/5e1, discount FROM liw
  UNION ALL SELECT recording_id, 'tax', idx, idx/5e1, tax FROM liw)"""
EMB = """emb AS (
  SELECT CAST(vec_id AS VARCHAR) AS recording_id, 'embedding' AS signal, i - 1 AS idx, (i - 1)/64e0 AS t,
    CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def filled_sql(src: str, fs: str = "5e1", pre: str = "") -> str:
    """CTEs {pre}f (index interpolation x, gap length and duration) from an obs CTE."""
    return f"""{pre}f0 AS (
  SELECT recording_id, signal, idx, t, value,
    last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER wf AS pi,
    last_value(value IGNORE NULLS) OVER wf AS pv,
    last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER wf AS pt,
    first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER wb AS ni,
    first_value(value IGNORE NULLS) OVER wb AS nv,
    first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER wb AS nt,
    count(*) OVER wa AS n_rows, max(t) OVER wa AS last_t
  FROM {src}
  WINDOW wa AS (PARTITION BY recording_id, signal),
    wf AS (PARTITION BY recording_id, signal ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    wb AS (PARTITION BY recording_id, signal ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{pre}f AS (
  SELECT *, CASE WHEN value IS NOT NULL THEN value
      WHEN pi IS NOT NULL AND ni IS NOT NULL THEN (nv - pv)/(ni - pi)*(idx - pi) + pv
      ELSE coalesce(pv, nv) END AS x,
    CASE WHEN value IS NULL AND idx = coalesce(pi + 1, 0) THEN coalesce(ni, n_rows) - idx END AS gap,
    CASE WHEN value IS NULL AND idx = coalesce(pi + 1, 0) THEN coalesce(nt, last_t + 1e0/({fs})) - t END AS gap_s
  FROM {pre}f0)"""


def profile_sql(src: str, fs: str = "5e1", pre: str = "", timing: str | None = None, corr: str | None = None, spectrum: bool = True) -> str:
    """CTEs up to {pre}prof, the per-signal profile of an obs CTE; without spectra their metrics are NULL."""
    ent, dom = "ent", "dom"
    join = ""
    if timing:
        ent, dom = "CASE WHEN steady THEN ent END", "CASE WHEN steady THEN dom END"
        join = f" LEFT JOIN (SELECT recording_id, steady FROM {timing}) USING (recording_id)"
    cm = "0e0"
    if corr:
        cm, join = "cm", join + f" LEFT JOIN {corr} USING (recording_id, signal)"
    power = f"""{welch_sql(pre + "w", "x", pre)},
{pre}sp AS (
  SELECT recording_id, signal, -sum(p/tot*ln(p/tot + 1e-12))/ln(count(*)) AS ent, max(p)/max(tot) AS dom
  FROM (SELECT *, sum(p) OVER (PARTITION BY recording_id, signal) AS tot FROM {pre}pw) GROUP BY ALL),"""
    if not spectrum:
        power = f"{pre}sp AS (SELECT DISTINCT recording_id, signal, CAST(NULL AS DOUBLE) AS ent, CAST(NULL AS DOUBLE) AS dom FROM {pre}a),"
    return filled_sql(src, fs, pre) + f""", {pre}q AS (
  SELECT recording_id, signal, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
    quantile_cont(value, 0.75) AS q3, avg(value) AS mean_v
  FROM {pre}f GROUP BY ALL),
{pre}q2 AS (
  SELECT recording_id, signal, median(abs(value - med)) AS mad
  FROM {pre}f JOIN {pre}q USING (recording_id, signal) GROUP BY ALL),
{pre}w AS (
  SELECT f.*, q1, med, q3, mad, mean_v, lag(x) OVER w AS px, sum(x - mean_v) OVER w AS run
  FROM {pre}f f JOIN {pre}q USING (recording_id, signal) JOIN {pre}q2 USING (recording_id, signal)
  WINDOW w AS (PARTITION BY recording_id, signal ORDER BY idx)),
{pre}a AS (
  SELECT recording_id, signal, count(*) AS n, count(value) AS v, count(gap) AS runs, max(gap) AS gmax,
    sum(gap) AS gsum, avg(gap) AS gmean, max(gap_s) AS smax, quantile_cont(gap_s, 0.95) AS s95,
    coalesce(avg(CASE WHEN value IS NOT NULL THEN
      CASE WHEN q3 > q1 AND (value < q1 - 1.5e0*(q3 - q1) OR value > q3 + 1.5e0*(q3 - q1)) THEN 1e0 ELSE 0e0 END END), 0e0) AS r_iqr,
    coalesce(avg(CASE WHEN value IS NOT NULL THEN
      CASE WHEN mad > 0 AND abs(0.67448975e0*(value - med)/mad) > 3.5e0 THEN 1e0 ELSE 0e0 END END), 0e0) AS r_mad,
    skewness(value) AS sk, kurtosis(value) AS ku, stddev_pop(value) AS sd, corr(x, px) AS lag1,
    stddev_pop(x - px) AS sdd, stddev_pop(x) AS sdx, stddev_samp(x) AS sdx1
  FROM {pre}w GROUP BY ALL),
{pre}d AS (
  SELECT a.recording_id, a.signal, max(m) - min(m) AS roll FROM (
    SELECT c.recording_id, c.signal,
      CASE WHEN c.idx + 1 >= greatest(5, greatest(10, c.n_rows//10)//3)
        THEN (c.run - coalesce(b.run, 0e0))/least(greatest(10, c.n_rows//10), c.idx + 1) END AS m
    FROM {pre}w c LEFT JOIN {pre}w b ON b.recording_id = c.recording_id AND b.signal = c.signal
      AND b.idx = c.idx - greatest(10, c.n_rows//10)) a GROUP BY ALL),
{power}
{pre}prof AS (
  SELECT recording_id, signal, n, (n - v)/CAST(n AS DOUBLE) AS missing_rate,
    coalesce(smax, 0e0) AS longest_missing_run_seconds, coalesce(s95, 0e0) AS missing_run_p95_seconds,
    CASE WHEN v < 4 OR runs = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, 0.65e0*gmax/gsum + 2.8e0*gmean/n)) END AS missing_burstiness,
    CASE WHEN v < 4 THEN 0e0 ELSE r_iqr END AS outlier_iqr_rate,
    CASE WHEN v < 4 THEN 0e0 ELSE r_mad END AS outlier_mad_rate,
    CASE WHEN v < 4 THEN 0e0 WHEN sd > 0 THEN sk END AS skewness,
    CASE WHEN v < 4 THEN 0e0 WHEN sd > 0 THEN ku END AS kurtosis_excess,
    CASE WHEN v < 4 THEN 0e0 ELSE coalesce(lag1, 0e0) END AS lag1_autocorr,
    CASE WHEN v < 4 OR n < 30 OR sdx1 = 0 THEN 0e0 ELSE coalesce(greatest(0e0, least(1e0, roll/(4*sdx1))), 0e0) END AS drift_score,
    CASE WHEN v < 4 THEN 0e0 ELSE sdd/(sdx + 1e-12) END AS local_volatility,
    CASE WHEN v < 4 OR n < 16 OR sdx = 0 THEN 0e0 ELSE {ent} END AS spectral_entropy,
    CASE WHEN v < 4 OR n < 16 OR sdx = 0 THEN 0e0 ELSE {dom} END AS dominant_frequency_ratio,
    CASE WHEN v < 4 THEN true ELSE sd <= 1e-12 END AS zero_variance, {cm} AS corr_mean_abs
  FROM {pre}a LEFT JOIN {pre}d USING (recording_id, signal) LEFT JOIN {pre}sp USING (recording_id, signal){join})"""


def welch_sql(src: str, col: str, pre: str = "") -> str:
    """CTE {pre}pw(recording_id, signal, bin, p): Welch power as a plain Fourier sum."""
    return f"""{pre}sg AS (
  SELECT recording_id, signal, seg, idx, x, m, row_number() OVER w - 1 AS j, avg(x) OVER g AS mu, count(*) OVER g AS c
  FROM (
    SELECT recording_id, signal, idx, {col} AS x, least(n_rows, 256) AS m,
      unnest(CASE WHEN n_rows < 256 THEN [0] ELSE [idx//128, idx//128 - 1] END) AS seg
    FROM {src}) WHERE seg >= 0
  WINDOW g AS (PARTITION BY recording_id, signal, seg), w AS (PARTITION BY recording_id, signal, seg ORDER BY idx)),
{pre}pw AS (
  SELECT recording_id, signal, bin, avg(p) AS p FROM (
    SELECT recording_id, signal, seg, k AS bin,
      (sum(y*cos(2*pi()*k*j/m))**2 + sum(y*sin(2*pi()*k*j/m))**2)
        * CASE WHEN k = 0 OR (max(m) % 2 = 0 AND k = max(m)//2) THEN 1e0 ELSE 2e0 END AS p
    FROM (SELECT *, (x - mu)*(0.5e0 - 0.5e0*cos(2*pi()*j/m)) AS y, unnest(range(0, m//2 + 1)) AS k
          FROM {pre}sg WHERE c = m)
    GROUP BY recording_id, signal, seg, k) GROUP BY ALL)"""


TIMING = """tm0 AS (
  SELECT recording_id, idx, t, t - lag(t) OVER (PARTITION BY recording_id ORDER BY idx) AS step FROM {src} {where}),
tq AS (
  SELECT recording_id, quantile_cont(step, 0.5) FILTER (step > 0) AS med, quantile_cont(step, 0.05) FILTER (step > 0) AS q05,
    quantile_cont(step, 0.8) FILTER (step > 0) AS q80, quantile_cont(step, 0.99) FILTER (step > 0) AS q99
  FROM tm0 GROUP BY 1),
tm AS (
  SELECT *, CASE WHEN quantised THEN trim ELSE med END AS eff,
    missing = 0 AND dup = 0 AND back = 0 AND n >= 2 AS valid, coalesce(far > 0.05e0*med, false) AS irregular,
    missing = 0 AND dup = 0 AND back = 0 AND n >= 2 AND NOT coalesce(far > 0.05e0*med, false) AS steady
  FROM (
    SELECT recording_id, count(*) AS n, count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (step = 0) AS dup,
      count(*) FILTER (step < 0) AS back, max(med) AS med, avg(step) FILTER (step > 0 AND step <= q99) AS trim,
      max(abs(step - med)) FILTER (step > 0) AS far, arg_min(t, idx) AS t0, arg_max(t, idx) AS t1,
      coalesce(count(*) FILTER (step > 0) > 100 AND max(q05) > 0 AND max(med) <= 2.05e0*max(q05)
        AND max(q80) > 1.35e0*max(q05) AND max(q99) <= 3.2e0*max(q05), false) AS quantised
    FROM tm0 JOIN tq USING (recording_id) GROUP BY 1))"""


def timing_sql(src: str, where: str = "") -> str:
    return TIMING.format(src=src, where=where)


def corr_sql(src: str = "liw") -> str:
    """CTE cm: mean absolute correlation of each of the four signals of a wide CTE."""
    return _CORR.replace("FROM liw", f"FROM {src}")


_CORR = """cor AS (
  SELECT recording_id, unnest([{'a': 'quantity', 'b': 'price', 'r': abs(corr(quantity, price))},
    {'a': 'quantity', 'b': 'discount', 'r': abs(corr(quantity, discount))},
    {'a': 'quantity', 'b': 'tax', 'r': abs(corr(quantity, tax))}, {'a': 'price', 'b': 'discount', 'r': abs(corr(price, discount))},
    {'a': 'price', 'b': 'tax', 'r': abs(corr(price, tax))}, {'a': 'discount', 'b': 'tax', 'r': abs(corr(discount, tax))}]) AS c
  FROM liw GROUP BY recording_id),
cm AS (
  SELECT recording_id, signal, avg(r) AS cm FROM (
    SELECT recording_id, c.a AS signal, c.r AS r FROM cor UNION ALL SELECT recording_id, c.b, c.r FROM cor) GROUP BY ALL)"""

CORR = corr_sql()


def pivot_sql(src: str, dst: str) -> str:
    return f"""{dst} AS (SELECT recording_id, idx, max(value) FILTER (signal = 'quantity') AS quantity,
  max(value) FILTER (signal = 'price') AS price, max(value) FILTER (signal = 'discount') AS discount,
  max(value) FILTER (signal = 'tax') AS tax FROM {src} GROUP BY ALL)"""
