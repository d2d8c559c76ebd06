"""Corruption, reference windows and reconstruction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.base import EMB, EV, LI, LINE_RATE, LIW, SIGNALS, embeddings, events, filled_sql, lines_wide, query, rounded, welch_sql
from tidegauge.catalog.cleaning import impute_sql, outlier_sql
from tidegauge.domains import LOSS_PARTS, LOSS_WEIGHTS, OUTLIER_FIRST
from tidegauge.functions.series import Series
from tidegauge.operators import corrupt as K
from tidegauge.operators import validate as G
from tidegauge.operators import windows as N
from tidegauge.operators.impute import impute
from tidegauge.plans import evaluate as E
from tidegauge.plans.clean import Settings
from tidegauge.sources.tables import as_long, recordings, table

SEED = 42


def clean_events(spark, d):
    """Every reading of every user, taken as a clean reference; purchases are genuine events."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, d, "events")
    s = recordings(e, F.col("user_id"), ["event_id"], F.col("event_id"), {"value": F.col("value")},
                   clock=F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6), keep={"event": F.col("event_type") == "purchase"})
    return as_long(s, ["value"], keep=("idx", "t", "event"))


EVC = EV.replace("CASE WHEN event_type <> 'error' THEN value END AS value", "value, event_type = 'purchase' AS event").replace("ev AS", "evc AS")


def u(*parts: str) -> str:
    return "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13))::BIGINT/pow(2, 52))"


def draw(tag: str, *more: str, per_signal: bool = True) -> str:
    return u(str(SEED), f"'{tag}'", "recording_id", *(["signal"] if per_signal else []), *more)


BASE = """b0 AS (SELECT *, value AS clean, count(*) OVER w AS n, CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1e0 END AS scale
  FROM {src} WINDOW w AS (PARTITION BY recording_id, signal))"""


def inject_sql(src: str, dst: str, kind: str, sev: float) -> str:
    """dst(recording_id, signal, idx, t, clean, value, mask, n)."""
    b = BASE.format(src=src).replace("b0", dst + "_b")
    sgn = lambda x: f"CASE WHEN {x} < 0.5 THEN -1e0 ELSE 1e0 END"
    lim = lambda x, lo, hi: min(hi, max(lo, x))
    frm, more = f"{dst}_b", ""
    if kind in ("mcar_missing", "spikes"):
        rate = lim(sev, 0.0, 0.8) if kind == "mcar_missing" else lim(sev, 0.0005, 0.2)
        more = f", {dst}_r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, signal ORDER BY {draw(kind, 'idx')}, idx) - 1 AS rk FROM {dst}_b)"
        frm = dst + "_r"
        hit = f"rk < greatest(1, round_even(n*{rate!r}e0, 0))"
        val = (f"CASE WHEN NOT ({hit}) THEN clean END" if kind == "mcar_missing" else
               f"CASE WHEN {hit} THEN clean + {sgn(draw('sign', 'idx'))}*(4e0 + 5e0*{draw('size', 'idx')})*scale ELSE clean END")
    elif kind == "drift":
        frac = lim(0.25 + sev, 0.2, 0.9)
        more = f""", {dst}_r AS (SELECT *, floor({draw('start', per_signal=False)}*greatest(1, n - len + 1)) AS st FROM (
          SELECT *, greatest(10, floor(n*{frac!r}e0)) AS len FROM {dst}_b))"""
        frm, hit = dst + "_r", "idx >= st AND idx < st + len"
        val = f"CASE WHEN {hit} THEN clean + scale*{0.8 + 4 * sev!r}e0*{sgn(draw('sign'))}*(idx - st)/(len - 1) ELSE clean END"
    elif kind == "level_shift":
        more = f""", {dst}_r AS (SELECT *, lo + floor({draw('start', per_signal=False)}*(hi - lo)) AS st FROM (
          SELECT *, greatest(5, n//5) AS lo, greatest(6, 4*n//5) AS hi FROM {dst}_b))"""
        frm, hit = dst + "_r", "idx >= st"
        val = f"CASE WHEN {hit} THEN clean + scale*{0.8 + 4.5 * sev!r}e0*{sgn(draw('sign'))} ELSE clean END"
    elif kind == "stuck_at":
        more = f""", {dst}_q AS (SELECT *, floor({draw('start', per_signal=False)}*greatest(1, n - len + 1)) AS st FROM (
          SELECT *, greatest(3, floor(n*{lim(sev, 0.01, 0.35)!r}e0)) AS len FROM {dst}_b)),
          {dst}_r AS (SELECT *, max(CASE WHEN idx = greatest(0, st - 1) THEN clean END) OVER (PARTITION BY recording_id, signal) AS held FROM {dst}_q)"""
        frm, hit = dst + "_r", "idx >= st AND idx < st + len"
        val = f"CASE WHEN {hit} THEN held ELSE clean END"
    elif kind == "high_frequency_noise":
        hit = "true"
        val = (f"clean + sqrt(-2e0*ln(1e0 - {draw('noisea', 'idx')}))*cos(2*pi()*{draw('noiseb', 'idx')})*scale*{0.05 + 1.4 * sev!r}e0"
               f" + CASE WHEN idx % 2 = 0 THEN 1e0 ELSE -1e0 END*scale*{0.25 * sev!r}e0")
    elif kind == "clipping":
        q = lim(0.01 + sev / 3, 0.01, 0.18)
        more = f", {dst}_r AS (SELECT *, quantile_cont(value, {q!r}) OVER w AS lo, quantile_cont(value, {1 - q!r}) OVER w AS up FROM {dst}_b WINDOW w AS (PARTITION BY recording_id, signal))"
        frm, val = dst + "_r", "least(greatest(clean, lo), up)"
        hit = "abs(least(greatest(clean, lo), up) - clean) > 1e-8 + 1e-5*abs(clean)"
    elif kind == "nested":
        more = f""", {dst}_r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, signal ORDER BY {u(str(SEED), "'nested'", 'recording_id', 'signal', 'idx')}, idx) - 1 AS rk,
          CAST(round_even(n*{sev!r}e0, 0) AS BIGINT) AS p FROM {dst}_b)"""
        frm, hit = dst + "_r", "(rk < p//2 OR (rk >= n//2 AND rk < n//2 + p - p//2))"
        val = f"CASE WHEN rk < p//2 THEN NULL WHEN {hit} THEN clean + {sgn(draw('sign', 'idx'))}*(4e0 + 5e0*{draw('size', 'idx')})*scale ELSE clean END"
    else:  # block_missing
        rate = lim(sev, 0.0, 0.7)
        more = f""", {dst}_l AS (SELECT DISTINCT recording_id, signal, n, greatest(3, floor(n*{max(0.005, rate / 8)!r}e0)) AS typ, CAST(greatest(3, n//4) AS BIGINT) AS top,
            CAST(greatest(1, round_even(n*{rate!r}e0, 0)) AS BIGINT) AS want, unnest(range(0, 100)) AS i FROM {dst}_b),
          {dst}_m AS (SELECT *, CAST(greatest(2, least(top, floor(exp(ln(typ) + 0.55e0*(sqrt(-2e0*ln(1e0 - {draw('lena', 'i')}))*cos(2*pi()*{draw('lenb', 'i')})))))) AS BIGINT) AS raw FROM {dst}_l),
          {dst}_k AS (SELECT *, least(raw, want - (sum(raw) OVER (PARTITION BY recording_id, signal ORDER BY i) - raw)) AS len FROM {dst}_m),
          {dst}_q AS (SELECT recording_id, signal, floor({draw('at', 'i')}*greatest(1, n - len + 1)) AS st, len FROM {dst}_k WHERE len > 0),
          {dst}_h AS (SELECT DISTINCT b.recording_id, b.signal, b.idx, true AS hit FROM {dst}_b b JOIN {dst}_q q ON b.recording_id = q.recording_id AND b.signal = q.signal AND b.idx >= st AND b.idx < st + len),
          {dst}_r AS (SELECT {dst}_b.*, coalesce(hit, false) AS hit FROM {dst}_b LEFT JOIN {dst}_h USING (recording_id, signal, idx))"""
        frm, hit, val = dst + "_r", "hit", "CASE WHEN NOT hit THEN clean END"
    return f"{b}{more}, {dst} AS (SELECT recording_id, signal, idx, t, n, clean, {val} AS value, coalesce({hit}, false) AS mask FROM {frm})"


NAMES = {"mcar_missing": "corrupt_mcar", "block_missing": "corrupt_block_missing", "spikes": "corrupt_spikes", "drift": "corrupt_drift",
         "level_shift": "corrupt_level_shift", "stuck_at": "corrupt_stuck_at", "high_frequency_noise": "corrupt_noise", "clipping": "corrupt_clipping"}


def _corrupt(kind, name):
    @query(name, f"WITH {EVC}, {inject_sql('evc', 'o', kind, 0.1)} SELECT recording_id, signal, idx, round(value, 5) AS value, mask FROM o")
    def run(spark, d):
        s = K.inject(clean_events(spark, d), kind, 0.1, SEED)
        return rounded(s.df.select("recording_id", "signal", "idx", "value", "mask"), 5)


for _k, _n in NAMES.items():
    _corrupt(_k, _n)

LEVELS = (0.05, 0.10, 0.15)


def at_levels(s: Series, levels=LEVELS) -> Series:
    """One corrupted copy of every series per severity, keyed by it."""
    s = s.fan_out("severity", {str(x): {"level": F.lit(x)} for x in levels})
    return K.nested(s, F.col("level"), SEED)


@query("corrupt_nested", f"WITH {EVC}, {', '.join(inject_sql('evc', f'o{int(x * 100)}', 'nested', x) for x in LEVELS)} "
       + " UNION ALL ".join(f"SELECT recording_id, signal, idx, '{x}' AS severity, round(value, 5) AS value, mask FROM o{int(x * 100)}" for x in LEVELS))
def corrupt_nested(spark, d):
    s = at_levels(clean_events(spark, d))
    return rounded(s.df.select("recording_id", "signal", "idx", "severity", "value", "mask"), 5)


RUNS = f"""WITH {LIW}, fl AS (SELECT *, quantity IS NOT NULL AND price IS NOT NULL AND discount IS NOT NULL AND tax IS NOT NULL AS good FROM liw),
  rn AS (SELECT *, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM fl WHERE good),
  rl AS (SELECT *, min(idx) OVER (PARTITION BY recording_id, g) AS st, count(*) OVER (PARTITION BY recording_id, g) AS len FROM rn)"""


@query("longest_complete_run", f"{RUNS} SELECT recording_id, max(len) AS longest_run FROM rl GROUP BY 1")
def longest_complete_run(spark, d):
    return rounded(N.longest_run(lines_wide(spark, d), SIGNALS))


@query("complete_window", f"""{RUNS} SELECT recording_id, idx - st AS idx, round(t, 6) AS t, quantity, price, discount, tax FROM (
  SELECT *, idx/5e1 AS t, first_value(st) OVER (PARTITION BY recording_id ORDER BY len DESC, st) AS best FROM rl) WHERE st = best AND idx < st + 400""")
def complete_window(spark, d):
    s = N.complete_window(lines_wide(spark, d), SIGNALS, 400)
    return rounded(s.df.select("recording_id", "idx", "t", *SIGNALS))


@query("fixed_windows", f"""{RUNS}, tt AS (SELECT *, idx/5e1 AS t, st/5e1 AS t0, (st + len - 1)/5e1 AS t1 FROM rl),
  bk AS (SELECT *, floor((t - t0)/0.2e0) AS k FROM tt),
  w AS (SELECT recording_id, st, k, min(idx) AS first_idx, count(*) AS rows, round(min(t), 6) AS from_t, round(max(t), 6) AS to_t FROM bk WHERE t1 - t0 >= (k + 1)*0.2e0 GROUP BY ALL)
  SELECT recording_id, first_idx, rows, from_t, to_t, wn AS window FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY first_idx) AS wn FROM w WHERE rows >= 8) WHERE wn <= 3""")
def fixed_windows(spark, d):
    return rounded(N.fixed_windows(lines_wide(spark, d), SIGNALS, 0.2, 8, 3))


def rmse_sql(src: str, keys: str = "recording_id, signal") -> str:
    return f"""SELECT {keys}, round(sqrt(avg((value - clean)**2)), 5) AS rmse, round(sqrt(avg((value - clean)**2) FILTER (mask)), 5) AS affected_rmse,
  round(sqrt(avg((value - clean)**2) FILTER (NOT mask)), 5) AS intact_rmse, round(count(value)/CAST(count(clean) AS DOUBLE), 6) AS coverage,
  round(count(value) FILTER (mask)/CAST(nullif(count(clean) FILTER (mask), 0) AS DOUBLE), 6) AS affected_coverage,
  count(clean) - count(value) AS remaining_missing, count(clean) AS reference_samples, count(clean) FILTER (mask) AS affected_samples,
  count(clean) FILTER (NOT mask) AS intact_samples, count(value) = count(clean) AS complete FROM {src} GROUP BY ALL"""


@query("reference_rmse", f"""WITH {EVC}, {inject_sql('evc', 'o', 'nested', 0.15)}, {impute_sql('o', 'i', 'linear')},
  j AS (SELECT o.recording_id, o.signal, o.idx, o.clean, o.mask, i.value FROM o JOIN i USING (recording_id, signal, idx)) {rmse_sql('j')}""")
def reference_rmse(spark, d):
    s = K.nested(clean_events(spark, d), 0.15, SEED)
    s = impute(s, ["linear"])
    out = G.reconstruction_rmse(s.df.withColumn("value", F.col("imp_linear")), list(s.keys))
    return rounded(_five(out))


def clean_lines(spark, d):
    """Every line item of every supplier, four signals taken as a clean reference."""
    li = table(spark, d, "lineitem")
    s = recordings(li, F.col("l_suppkey"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
                   F.unix_micros(F.col("l_shipdate").cast("timestamp")),
                   {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax")}, rate_hz=LINE_RATE)
    return as_long(s, SIGNALS)


LIC = (LI.replace("CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'O') THEN l_extendedprice END", "l_extendedprice")
       .replace("CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'F') THEN l_discount END", "l_discount"))


@query("signal_errors", f"""WITH {LIC}, {inject_sql('li', 'o', 'nested', 0.02)}, {impute_sql('o', 'i', 'linear')},
  e AS (SELECT o.recording_id, o.signal, sqrt(avg((i.value - o.clean)**2)) AS rmse, sqrt(avg((i.value - o.clean)**2))/(stddev_pop(o.clean) + 1e-12) AS nrmse, count(*) AS cells, count(*) - count(i.value) AS gone
    FROM o JOIN i USING (recording_id, signal, idx) GROUP BY ALL),
  s AS (SELECT recording_id, sum(gone) = 0 AS ok, avg(nrmse) AS nrmse, avg(rmse) AS mean_rmse, sum(gone)/sum(cells) AS gone,
    {', '.join(f"max(nrmse) FILTER (signal = '{x}') AS nrmse_{x}, max(rmse) FILTER (signal = '{x}') AS rmse_{x}" for x in SIGNALS)} FROM e GROUP BY 1)
  SELECT recording_id, {', '.join(f'CASE WHEN ok THEN round({c}, 6) END AS {n}' for c, n in [('nrmse', 'nrmse'), ('mean_rmse', 'mean_raw_rmse')] + [(f'{e}_{x}',) * 2 for e in ('nrmse', 'rmse') for x in SIGNALS])},
    round(gone, 6) AS remaining_missing_fraction, ok AS valid_rmse FROM s""")
def signal_errors(spark, d):
    """Error of linear imputation per signal and over four signals; unknown where a gap at an end stays open."""
    s = impute(K.nested(clean_lines(spark, d), 0.02, SEED), ["linear"])
    return rounded(G.nrmse(s.df.withColumn("value", F.col("imp_linear")), ["recording_id"], SIGNALS))


def _five(df):
    return df.withColumns({c: F.round(c, 5) for c in ("rmse", "affected_rmse", "intact_rmse")})


CANDIDATES = [{"outlier": o, "imputation": i} for o in ("none", "iqr") for i in ("linear", "locf", "mean")]


def _candidate_sql(kind: str, sev: float) -> str:
    parts = [f"WITH {EVC}", inject_sql("evc", "o", kind, sev)]
    for o in ("none", "iqr"):
        parts.append(outlier_sql("o", "x_" + o, o))
        parts += [impute_sql("x_" + o, f"y_{o}_{i}", i) for i in ("linear", "locf", "mean")]
    union = " UNION ALL ".join(f"""SELECT o.recording_id, o.signal, o.idx, o.t, o.clean, o.mask, y.value, x.flagged AS detected, '{o}' AS outlier, '{i}' AS imputation
      FROM o JOIN y_{o}_{i} y USING (recording_id, signal, idx) JOIN x_{o} x USING (recording_id, signal, idx)""" for o in ("none", "iqr") for i in ("linear", "locf", "mean"))
    return ", ".join(parts) + f", al AS ({union})"


@query("candidate_rank", f"""{_candidate_sql('spikes', 0.1)}, sc AS ({rmse_sql('al', 'recording_id, signal, outlier, imputation')})
  SELECT recording_id, signal, outlier, imputation, rmse, coverage, complete, row_number() OVER (PARTITION BY recording_id, signal ORDER BY rmse ASC NULLS LAST, outlier, imputation) AS rank,
    complete AND rmse IS NOT NULL AND row_number() OVER (PARTITION BY recording_id, signal ORDER BY complete DESC, rmse ASC NULLS LAST, outlier, imputation) = 1 AS winner FROM sc""")
def candidate_rank(spark, d):
    s = clean_events(spark, d)
    runs = E.corrupted_runs(s, CANDIDATES, "spikes", 0.1, OUTLIER_FIRST, Settings(signals=("value",)), SEED)
    scores = _five(G.reconstruction_rmse(runs.df, list(runs.keys)))
    out = G.rank_candidates(scores, ["recording_id", "signal"], ("outlier", "imputation"))
    return rounded(out.select("recording_id", "signal", "outlier", "imputation", "rmse", "coverage", "complete", "rank", "winner"))


@query("paired_reference", f"""WITH {EVC}, {EV}, j AS (SELECT evc.recording_id, evc.signal, evc.idx, evc.value AS clean, ev.value,
    CASE WHEN ev.value IS NULL THEN true ELSE abs(evc.value - ev.value) > 1e-8 + 1e-5*abs(ev.value) END AS mask,
    count(*) OVER (PARTITION BY evc.recording_id, evc.signal) >= 32 AS usable FROM evc JOIN ev USING (recording_id, signal, idx))
  {rmse_sql('j', 'recording_id, signal, usable')}""")
def paired_reference(spark, d):
    rows = G.align(clean_events(spark, d), events(spark, d))
    return rounded(_five(G.reconstruction_rmse(rows, ["recording_id", "signal", "usable"])))


def squash_sql(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0e0, {x}) END/(1 + greatest(0e0, {x})))"


def loss_sql(src: str, pre: str = "") -> str:
    """CTE {pre}lo: the loss parts of each (recording_id, signal) of a CTE with clean, value, mask."""
    return f"""{pre}cl AS (SELECT recording_id, signal, idx, t, clean AS value FROM {src}), {filled_sql(pre + 'cl', '1e0', pre + 'y')},
{pre}pr AS (SELECT recording_id, signal, idx, t, value FROM {src}), {filled_sql(pre + 'pr', '1e0', pre + 'z')},
{pre}yz AS (SELECT s.recording_id, s.signal, s.idx, s.mask, s.event, a.x AS y, b.x AS z, a.n_rows, lag(a.x) OVER w AS py, lag(b.x) OVER w AS pz, lead(a.x) OVER w AS ny, lead(b.x) OVER w AS nz
  FROM {src} s JOIN {pre}yf a USING (recording_id, signal, idx) JOIN {pre}zf b USING (recording_id, signal, idx) WINDOW w AS (PARTITION BY recording_id, signal ORDER BY idx)),
{pre}ag AS (SELECT recording_id, signal, count(*) AS n, stddev_pop(y) AS sd, sqrt(avg((z - y)**2) FILTER (mask)) AS rec, sqrt(avg((z - y)**2) FILTER (NOT mask)) AS harm,
  sqrt(avg(((z - pz) - (y - py))**2)) AS dyn, stddev_pop(y - py) AS sdd, abs(skewness(z) - skewness(y)) AS dsk, abs(kurtosis(z) - kurtosis(y)) AS dku,
  avg(abs(coalesce(y - py, ny - y))) FILTER (event) AS ey, avg(abs(coalesce(z - pz, nz - z))) FILTER (event) AS ez FROM {pre}yz GROUP BY ALL),
{pre}ry AS (SELECT recording_id, signal, y, row_number() OVER (PARTITION BY recording_id, signal ORDER BY y) AS k FROM {pre}yz),
{pre}rz AS (SELECT recording_id, signal, z, row_number() OVER (PARTITION BY recording_id, signal ORDER BY z) AS k FROM {pre}yz),
{pre}ws AS (SELECT recording_id, signal, avg(abs(y - z)) AS w FROM {pre}ry JOIN {pre}rz USING (recording_id, signal, k) GROUP BY ALL),
{welch_sql(pre + 'yz', 'y', pre + 'y')}, {welch_sql(pre + 'yz', 'z', pre + 'z')},
{pre}nj AS (SELECT recording_id, signal, bin, a.p/(sum(a.p) OVER g + 1e-12) + 1e-12 AS p, b.p/(sum(b.p) OVER g + 1e-12) + 1e-12 AS q
  FROM {pre}ypw a JOIN {pre}zpw b USING (recording_id, signal, bin) WINDOW g AS (PARTITION BY recording_id, signal)),
{pre}js AS (SELECT recording_id, signal, greatest(0e0, sum(p*ln(p/((p + q)/2)) + q*ln(q/((p + q)/2))))/(2*ln(2)) AS js
  FROM (SELECT recording_id, signal, p/sum(p) OVER g AS p, q/sum(q) OVER g AS q FROM {pre}nj WINDOW g AS (PARTITION BY recording_id, signal)) GROUP BY ALL),
{pre}lo AS (SELECT recording_id, signal, {squash_sql('coalesce(rec/(sd + 1e-12), 0e0)')} AS reconstruction, {squash_sql('coalesce(harm/(sd + 1e-12), 0e0)')} AS clean_harm,
  {squash_sql('dyn/(sdd + 1e-12)')} AS dynamics, 0.55e0*{squash_sql('w/(sd + 1e-12)')} + 0.2e0*{squash_sql('dsk')} + 0.25e0*{squash_sql('dku/3')} AS distribution,
  CASE WHEN n < 16 THEN 0e0 ELSE least(1e0, js) END AS frequency, CASE WHEN ey IS NOT NULL THEN {squash_sql('abs(ln((ez + 1e-12)/(ey + 1e-12)))')} END AS event, w, js
  FROM {pre}ag JOIN {pre}ws USING (recording_id, signal) JOIN {pre}js USING (recording_id, signal))"""


LOSS_BASE = f"""WITH {EVC}, {inject_sql('evc', 'o', 'spikes', 0.1)}, {outlier_sql('o', 'x', 'iqr')}, {impute_sql('x', 'i', 'linear')},
  j AS (SELECT o.recording_id, o.signal, o.idx, o.t, o.clean, o.mask, i.value, x.flagged AS detected, evc.event FROM o JOIN i USING (recording_id, signal, idx)
    JOIN x USING (recording_id, signal, idx) JOIN evc USING (recording_id, signal, idx))"""


def _loss_rows(spark, d):
    return E.corrupted_runs(clean_events(spark, d), [{"outlier": "iqr", "imputation": "linear"}], "spikes", 0.1, OUTLIER_FIRST, Settings(signals=("value",)), SEED)


@query("reconstruction_loss", f"{LOSS_BASE}, {loss_sql('j')} SELECT recording_id, signal, {', '.join(f'round({p}, 6) AS {p}' for p in LOSS_PARTS[:6])} FROM lo")
def reconstruction_loss(spark, d):
    s = _loss_rows(spark, d)
    out = G.signal_losses(s, "event")
    return rounded(out.select("recording_id", "signal", *LOSS_PARTS[:6]))


@query("wasserstein_distance", f"{LOSS_BASE}, {loss_sql('j')} SELECT recording_id, signal, round(w, 5) AS wasserstein FROM lo")
def wasserstein_distance(spark, d):
    from tidegauge.operators.profile import fill_columns
    s = _loss_rows(spark, d)
    s = fill_columns(s.on(s.df.withColumn("y", F.col("clean")).withColumn("z", F.col("value"))), ["y", "z"])
    out = G.wasserstein(s, "y", "z")
    return rounded(out.select("recording_id", "signal", "wasserstein"), 5)


@query("spectral_divergence", f"""WITH {EMB}, cp AS (SELECT *, value + CASE WHEN idx % 2 = 0 THEN 0.1e0 ELSE -0.1e0 END AS z FROM emb),
  e2 AS (SELECT recording_id, signal, idx, value AS y, z, count(*) OVER (PARTITION BY recording_id, signal) AS n_rows FROM cp),
  {welch_sql('e2', 'y', 'y')}, {welch_sql('e2', 'z', 'z')},
  nj AS (SELECT recording_id, signal, bin, a.p/(sum(a.p) OVER g + 1e-12) + 1e-12 AS p, b.p/(sum(b.p) OVER g + 1e-12) + 1e-12 AS q
    FROM ypw a JOIN zpw b USING (recording_id, signal, bin) WINDOW g AS (PARTITION BY recording_id, signal))
  SELECT recording_id, signal, round(greatest(0e0, sum(p*ln(p/((p + q)/2)) + q*ln(q/((p + q)/2))))/(2*ln(2)), 6) AS spectral_js
  FROM (SELECT recording_id, signal, p/sum(p) OVER g AS p, q/sum(q) OVER g AS q FROM nj WINDOW g AS (PARTITION BY recording_id, signal)) GROUP BY ALL""")
def spectral_divergence(spark, d):
    """Each vector against itself with an alternating disturbance."""
    s = embeddings(spark, d)
    s = s.with_column("z", F.col("value") + F.when(F.col("idx") % 2 == 0, 0.1).otherwise(-0.1))
    return rounded(G.spectral_divergence(s, "value", "z"))


@query("detection_f1", f"""{LOSS_BASE}, c AS (SELECT recording_id, count(*) FILTER (mask AND detected) AS tp, count(*) FILTER (NOT mask AND detected) AS fp, count(*) FILTER (mask AND NOT detected) AS fn FROM j GROUP BY 1),
  pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp/CAST(tp + fp AS DOUBLE) ELSE 1e0 END AS p, CASE WHEN tp + fn > 0 THEN tp/CAST(tp + fn AS DOUBLE) ELSE 1e0 END AS r FROM c)
  SELECT recording_id, round(p, 6) AS det_precision, round(r, 6) AS det_recall, round(CASE WHEN p + r > 0 THEN 2*p*r/(p + r) ELSE 0e0 END, 6) AS det_f1,
  round(1 - CASE WHEN p + r > 0 THEN 2*p*r/(p + r) ELSE 0e0 END, 6) AS detection FROM pr""")
def detection_f1(spark, d):
    s = _loss_rows(spark, d)
    return rounded(G.detection(s.df, ["recording_id"]))


W8 = dict(zip(LOSS_PARTS, LOSS_WEIGHTS["network"]))


def _loss_rank_sql() -> str:
    base = _candidate_sql("spikes", 0.1)
    base += """, ak AS (SELECT al.recording_id || '|' || outlier || '|' || imputation AS recording_id, al.signal, al.idx, al.t, al.clean, al.value, al.mask, al.detected, evc.event
      FROM al JOIN evc ON evc.recording_id = al.recording_id AND evc.idx = al.idx)"""
    base += f", {loss_sql('ak')}, dt AS (SELECT recording_id, count(*) FILTER (mask AND detected) AS tp, count(*) FILTER (NOT mask AND detected) AS fp, count(*) FILTER (mask AND NOT detected) AS fn, avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END) AS retention FROM ak GROUP BY 1)"
    base += ", dd AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp/CAST(tp + fp AS DOUBLE) ELSE 1e0 END AS p, CASE WHEN tp + fn > 0 THEN tp/CAST(tp + fn AS DOUBLE) ELSE 1e0 END AS r FROM dt)"
    base += ", de AS (SELECT *, 1 - CASE WHEN p + r > 0 THEN 2*p*r/(p + r) ELSE 0e0 END AS detection FROM dd)"
    top = " + ".join(f"coalesce({w}e0*{k}, 0e0)" for k, w in W8.items())
    tot = " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w}e0 ELSE 0e0 END" for k, w in W8.items())
    return base + f""" SELECT split_part(recording_id, '|', 1) AS recording_id, split_part(recording_id, '|', 2) AS outlier, split_part(recording_id, '|', 3) AS imputation,
      round(({top})/({tot}), 6) AS loss, round(retention, 6) AS retention, round(detection, 6) AS detection FROM lo JOIN de USING (recording_id)"""


@query("loss_validation", _loss_rank_sql())
def loss_validation(spark, d):
    out = E.loss_validation(clean_events(spark, d), CANDIDATES, "spikes", 0.1, "network", Settings(signals=("value",)), event="event")
    return rounded(out.select("recording_id", "outlier", "imputation", "loss", "retention", "detection"))
