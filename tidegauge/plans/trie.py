"""All candidates of a recording in one pass: a trie of stage prefixes that keeps no candidate's copy.

Spark deals the recordings over tasks; a task takes recordings of equal length (at most a block of rows each, CELLS together)
as a matrix per signal and walks the stages. A stage turns the rows of the matrix, one per prefix, into one row per prefix and
method, so candidates share what they have in common, and a method runs on all its prefixes at once; prefixes that left a
recording the same values go on as one row. At the leaves only sums leave the task: the metrics behind the component
scores, the correlations between signals and the error against the clean signal, over the signals one row per candidate.
Candidates are neither written nor shuffled.

Longer recordings, and on several signals the methods that look across them (isolation forest, nearest neighbours, chained
regressions), are run as copies by `plans.clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.domains import OUTLIER_FIRST
from tidegauge.functions.series import Series
from tidegauge.operators.forest import MIN_ROWS, line_scores
from tidegauge.operators.outliers import MIN_SAMPLES
from tidegauge.operators.profile import MAD_SCALE
from tidegauge.operators.smooth import parts_smoothed
from tidegauge.operators.validate import TINY

# Methods that look across signals, which a recording of one signal runs in the trie too.
ACROSS = {"outlier": ("isolation_forest",), "imputation": ("knn", "mice"), "smoothing": ()}
LIGHT = {"outlier": ("none", "zscore", "iqr", "mad", "winsorize"), "imputation": ("none", "mean", "median", "locf", "linear"),
         "smoothing": ("none", "moving_median", "savgol", "butterworth")}
MEASURES = ("missing_rate", "missing_run_p95_seconds", "missing_burstiness", "outlier_iqr_rate", "outlier_mad_rate", "skewness", "kurtosis_excess",
            "drift_score", "local_volatility", "corr_mean_abs", "rmse", "sd", "cells", "gone")
DIRTY = "dirty"  # the order of the row of the uncleaned copy
CELLS = 4_000_000  # of a matrix that a stage makes at a time
BATCH_CELLS = 400_000  # of the leaves of recordings of one length that are walked together
CLOSE = 1e-6  # share of a sum of squares below which its digits are not enough
FLAT = 1e-18  # the same of the largest value's square
LABELS = ("order", "imputation", "outlier", "smoothing")


# --- rows of a matrix, NaN where missing ------------------------------------------------------------------------------
def quantile(ordered: np.ndarray, valid: np.ndarray, p: float) -> np.ndarray:
    """Linear quantile of every row; ordered: the rows sorted, missing values last."""
    at = p * np.maximum(valid - 1, 0)
    lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
    rows = np.arange(len(ordered))
    a, b = ordered[rows, lo], ordered[rows, hi]
    return np.where(lo == hi, a, (hi - at) * a + (at - lo) * b)


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last observation up to each cell and of the first one from it on; -1 and the length where there is none."""
    n, seen = x.shape[1], ~np.isnan(x)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(seen, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(seen, at, n)[:, ::-1], axis=1)[:, ::-1]
    return before, after


def picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    inside = (at >= 0) & (at < x.shape[1])
    return np.where(inside, np.take_along_axis(x, np.clip(at, 0, x.shape[1] - 1), axis=1), np.nan)


def filled(x: np.ndarray) -> np.ndarray:
    """By row number between observations, the nearest one at the edges."""
    open_rows = np.isnan(x).any(axis=1)
    if not open_rows.all():
        out = x.copy() if open_rows.any() else x
        if open_rows.any():
            out[open_rows] = filled(x[open_rows])
        return out
    p, n = anchors(x)
    a, b = picked(x, p), picked(x, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        inner = (b - a) / (n - p) * (np.arange(x.shape[1]) - p) + a
    return np.where(~np.isnan(x), x, np.where(np.isnan(a), b, np.where(np.isnan(b), a, inner)))


def deviations(x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """From the mean of the row; 0 where missing."""
    gone = np.isnan(x)
    if not gone.any():
        return x - (x.sum(axis=1) / valid)[:, None]
    total = np.where(gone, 0.0, x).sum(axis=1)
    return np.where(gone, 0.0, x - (total / valid)[:, None])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the products of every row."""
    return np.einsum("ij,ij->i", a, b)


def spread(x: np.ndarray, valid: np.ndarray, ddof: int = 0) -> np.ndarray:
    """Standard deviation of every row; exactly 0 where all its values are equal."""
    with np.errstate(invalid="ignore", divide="ignore"):
        d = deviations(x, valid)
        sd = np.sqrt((d * d).sum(axis=1) / (valid - ddof))
    same = np.fmax.reduce(x, axis=1) == np.fmin.reduce(x, axis=1)
    return np.where(same, 0.0, sd)


# --- stages -----------------------------------------------------------------------------------------------------------
def outlier(x: np.ndarray, method: str, bench: bool) -> np.ndarray:
    if method == "none":
        return x
    valid, ordered = (~np.isnan(x)).sum(axis=1), np.sort(x, axis=1)
    q = lambda p: quantile(ordered, valid, p)[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        if method == "winsorize":
            return np.minimum(np.maximum(x, q(0.01)), q(0.99))
        if method == "zscore":
            sd = spread(x, valid)[:, None]
            hit = (sd > 0) & (np.abs(x - (np.nansum(x, axis=1) / valid)[:, None]) / sd > 3)
        elif method == "iqr":
            hit = beyond_fences(x, q(0.25), q(0.75))
        else:
            hit = beyond_mad(x, q(0.5), valid)
    return flagged(x, hit & (valid >= MIN_SAMPLES)[:, None], bench)


def flagged(x: np.ndarray, hit: np.ndarray, bench: bool) -> np.ndarray:
    """Without the flagged cells, which bench fills again."""
    y = np.where(hit, np.nan, x)
    if not bench:
        return y
    left = np.sort(y, axis=1)
    middle = quantile(left, (~np.isnan(y)).sum(axis=1), 0.5)[:, None]
    y = filled(y)
    return np.where(np.isnan(y), middle, y)


def beyond_fences(x, q1, q3):
    return (q3 - q1 > 0) & ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))


def beyond_mad(x, middle, valid):
    mad = quantile(np.sort(np.abs(x - middle), axis=1), valid, 0.5)[:, None]
    return (mad > 0) & (np.abs(MAD_SCALE * (x - middle) / mad) > 3.5)


def imputation(x: np.ndarray, method: str, t: np.ndarray, bench: bool) -> np.ndarray:
    """A single signal has no neighbours and no regressions: knn leaves the mean there, mice the median."""
    gone = np.isnan(x)
    if method == "none" or not gone.any():
        return x
    p, n = anchors(x)
    valid = x.shape[1] - gone.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        if method in ("mean", "knn"):
            guess = np.broadcast_to((np.nansum(x, axis=1) / valid)[:, None], x.shape)
        elif method in ("median", "mice"):
            guess = np.broadcast_to(quantile(np.sort(x, axis=1), valid, 0.5)[:, None], x.shape)
        elif method == "locf":
            guess = picked(x, p)
            guess = np.where(np.isnan(guess), picked(x, n), guess) if bench else guess
        elif bench:
            guess = filled(x)
        else:
            last = t.shape[1] - 1
            before, after = (np.take_along_axis(t, np.clip(at, 0, last), axis=1) for at in (p, n))
            guess = (picked(x, n) - picked(x, p)) / np.where(after == before, np.nan, after - before) * (t - before) + picked(x, p)
    inside = bench | ((p >= 0) & (n <= x.shape[1] - 1))
    return np.where(gone & inside, guess, x)


def smoothing(x: np.ndarray, method: str, bench: bool) -> np.ndarray:
    if method == "none":
        return x
    return parts_smoothed(filled(x) if bench else x, method, bench)


def forest_cleaned(x: np.ndarray, names: list[str], bench: bool) -> np.ndarray:
    """Outlier stage by an isolation forest per row, for recordings of one signal; names: what seeds each row's forest."""
    if x.shape[1] < MIN_ROWS:
        hit = np.zeros(x.shape, bool)
    else:
        y = filled(x)
        hit = line_scores(np.where(np.isnan(y), 0.0, y), names) > 0.5
    return flagged(x, hit, bench)


# --- leaves -----------------------------------------------------------------------------------------------------------
def measures(x: np.ndarray, rec: np.ndarray, t: np.ndarray, rate: float, clean: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of every row that component scores are made of, and its error; as in `operators.profile`.

    rec: the row of t and clean that each row of x belongs to.
    """
    rows, n = x.shape
    gone = np.isnan(x)
    valid = n - gone.sum(axis=1)
    few = valid < 4
    zero = np.zeros(rows)
    p95, burst = zero.copy(), zero.copy()
    same: dict[tuple, int] = {}
    for row in np.flatnonzero(gone.any(axis=1)):
        like = same.setdefault((rec[row], gone[row].tobytes()), row)
        if like != row:
            p95[row], burst[row] = p95[like], burst[like]
            continue
        now = t[rec[row]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[row], [False]])))
        begin, end = edges[::2], edges[1::2]
        stop = np.where(end < n, now[np.minimum(end, n - 1)], now[-1] + 1.0 / rate)
        seconds, runs = np.sort(stop - now[begin])[None, :], end - begin
        p95[row] = quantile(seconds, np.array([len(begin)]), 0.95)[0]
        burst[row] = np.clip(0.65 * runs.max() / runs.sum() + 8 * 0.35 * runs.mean() / n, 0, 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        ordered = np.sort(x, axis=1)
        q1, middle, q3 = (quantile(ordered, valid, p)[:, None] for p in (0.25, 0.5, 0.75))
        some = np.maximum(valid, 1)
        z = deviations(x, valid)
        sd = np.where(ordered[:, 0] == ordered[np.arange(rows), some - 1], 0.0, np.sqrt(squares(z, z) / valid))
        z /= np.where(sd > 0, sd, np.nan)[:, None]
        zz = z * z
        skew, kurt = squares(zz, z) / some, squares(zz, zz) / some - 3
        skew = skew * np.sqrt(valid * (valid - 1.0)) / (valid - 2)
        kurt = (valid - 1) / ((valid - 2.0) * (valid - 3)) * ((valid + 1) * kurt + 6)
        y = filled(x)
        y = np.where(np.isnan(y), 0.0, y)
        every = np.full(rows, n)
        sd_fill, sd_fill1 = spread(y, every), spread(y, every, 1) if n > 1 else zero
        step = spread(np.diff(y, axis=1), every - 1) if n > 1 else np.full(rows, np.nan)
        w = max(10, n // 10)
        run = np.cumsum(y - y.mean(axis=1, keepdims=True), axis=1)
        early = np.concatenate([np.zeros((rows, min(w, n))), run[:, :-w]], axis=1) if n > w else np.zeros((rows, n))
        rolled = ((run - early) / np.minimum(w, np.arange(1, n + 1)))[:, max(5, w // 3) - 1:]
        drift = np.clip((rolled.max(axis=1) - rolled.min(axis=1)) / (4 * sd_fill1), 0, 1) if n >= 30 else zero
        drift = np.where(sd_fill1 == 0, 0.0, drift)
        off = x - clean[rec]
        lost = np.isnan(off)
        off[lost] = 0.0
        rmse = np.sqrt(squares(off, off) / (n - lost.sum(axis=1)))
        share = lambda hit: np.where(valid > 0, (hit & ~gone).sum(axis=1) / some, 0.0)
        out = {
            "missing_burstiness": burst, "outlier_iqr_rate": share(beyond_fences(x, q1, q3)), "outlier_mad_rate": share(beyond_mad(x, middle, valid)),
            "skewness": np.where(sd > 0, skew, np.nan), "kurtosis_excess": np.where(sd > 0, kurt, np.nan), "drift_score": drift,
            "local_volatility": step / (sd_fill + 1e-12)}
    known = (~np.isnan(clean)).sum(axis=1)
    sd_clean = np.where(known > 0, spread(clean, known), np.nan)
    out = {k: np.where(few, 0.0, v) for k, v in out.items()}
    return out | {"missing_rate": (n - valid) / n, "missing_run_p95_seconds": p95, "rmse": rmse, "sd": sd_clean[rec], "cells": np.full(rows, float(n)), "gone": n - valid * 1.0}


def _correlation(x, mx, a, flat_x, y, my, b, flat_y) -> np.ndarray:
    """|correlation| of the rows of x with those of y over their common cells; NaN where a side is constant.

    m: 1 where observed, a and b: deviations from the row's mean, 0 where missing, flat: hardly any spread in the row.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        n, sa, sb = squares(mx, my), squares(a, my), squares(b, mx)
        saa, sbb = np.einsum("ij,ij,ij->i", a, a, my), np.einsum("ij,ij,ij->i", b, b, mx)
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        r = np.abs(squares(a, b) - sa * sb / n) / np.sqrt(va * vb)
        # Where next to nothing is left of a sum of squares, its digits are not enough: the common cells are looked at alone.
        near = flat_x | flat_y | ~((va > CLOSE * saa) & (vb > CLOSE * sbb))
        if near.any():
            both = (mx[near] > 0) & (my[near] > 0)
            p, q, n = np.where(both, x[near], np.nan), np.where(both, y[near], np.nan), n[near]
            wide = spread(p, n) * spread(q, n)
            r[near] = np.abs((deviations(p, n) * deviations(q, n)).sum(axis=1) / n / np.where(wide > 0, wide, np.nan))
    return r


def correlations(now: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per signal, candidate and recording the mean |correlation| with the other signals; pairs without one are left out."""
    shape = now[0][2].shape
    if len(now) == 1:
        return np.zeros((1, *shape))
    found = [[] for _ in now]
    rows = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for x, _, at in now:
            seen = ~np.isnan(x)
            d = deviations(x, seen.sum(axis=1))
            rows.append((x, seen.astype(float), d, squares(d, d) <= FLAT * np.fmax.reduce(np.abs(x), axis=1) ** 2, at))
    for i, (*one, at_i) in enumerate(rows):
        for j, (*other, at_j) in enumerate(rows[:i]):
            size = len(other[0])
            pair, back = np.unique(at_i * size + at_j, return_inverse=True)
            r = _correlation(*[c[pair // size] for c in one], *[c[pair % size] for c in other])[back].reshape(shape)
            found[i].append(r)
            found[j].append(r)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.stack([np.nansum(f, axis=0) / (~np.isnan(f)).sum(axis=0) for f in found])


def merged(x: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of each recording, their recordings, and where each row went."""
    seen: dict[tuple, int] = {}
    back = np.array([seen.setdefault((r, v.tobytes()), len(seen)) for r, v in zip(rec.tolist(), x)], np.int64)
    first = np.unique(back, return_index=True)[1]
    return x[first], rec[first], back


def walk(xs: list[np.ndarray], t: np.ndarray, methods: dict[str, list[str]], order: str, bench: bool, name=None):
    """(labels, state) of the leaves, for some of them at a time; labels: (first stage, second stage, smoothing).

    xs: per signal a row per recording, t likewise. State per signal: different rows, the recording of each, and the place of
    the row of every prefix and recording. name(recording, label): what seeds a forest.
    """
    stages = ("outlier", "imputation") if order == OUTLIER_FIRST else ("imputation", "outlier")
    every = np.arange(len(t))

    def step(stage: str, mine: list[str], labels: list[tuple], x: np.ndarray, rec: np.ndarray, at: np.ndarray):
        rows, recs, places, size = [], [], [], 0
        for m in mine:
            here, of, where = x, rec, at
            if m == "isolation_forest":
                here, of, where = x[at.ravel()], np.tile(every, len(at)), np.arange(at.size).reshape(at.shape)
                here = forest_cleaned(here, [name(r, label) for label in labels for r in every], bench)
            elif stage == "outlier":
                here = outlier(x, m, bench)
            elif stage == "imputation":
                here = imputation(x, m, t[rec], bench)
            else:
                here = smoothing(x, m, bench)
            rows.append(here)
            recs.append(of)
            places.append(where + size)
            size += len(here)
        x, rec, back = merged(np.concatenate(rows), np.concatenate(recs))
        return x, rec, back[np.concatenate(places)]

    at_once = max(1, CELLS // max(1, t.size * len(methods[stages[1]]) * len(methods["smoothing"])))
    for begin in range(0, len(methods[stages[0]]), at_once):
        labels, now = [()], [(x, every, every[None, :]) for x in xs]
        for stage in (*stages, "smoothing"):
            mine = methods[stage][begin:begin + at_once] if stage == stages[0] else methods[stage]
            now = [step(stage, mine, labels, *one) for one in now]
            labels = [(*label, m) for m in mine for label in labels]
        yield labels, now


def _leaves(xs, cs, t, methods, orders, rate: float, bench: bool, name):
    """((order, imputation, outlier, smoothing) per candidate, measures as (signal, candidate, recording)); the uncleaned copies first."""
    def look(now):
        out = {m: np.empty((len(now), *now[0][2].shape)) for m in MEASURES}
        for k, ((x, rec, at), c) in enumerate(zip(now, cs)):
            for m, v in measures(x, rec, t, rate, c).items():
                out[m][k] = v[at]
        return out | {"corr_mean_abs": correlations(now)}

    every = np.arange(len(t))
    yield [(DIRTY, "none", "none", "none")], look([(x, every, every[None, :]) for x in xs])
    for order in orders:
        for labels, now in walk(xs, t, methods, order, bench, name):
            flip = order == OUTLIER_FIRST
            yield [(order, b if flip else a, a if flip else b, c) for a, b, c in labels], look(now)


def _of_whole_recordings(s: Series, methods: dict[str, list[str]], orders, rate: float, semantics: str, seed: int, fields, made) -> DataFrame:
    """keys without signal and `fields`, from made(names of the signals, leaves, number of recordings) for recordings of one length.

    s: value and clean per row; it has to fit into blocks.
    """
    if s.blocked:
        raise ValueError("the trie needs recordings of one block at most")
    keys = [k for k in s.keys if k != "signal"]
    bench, methods = semantics == "bench", {k: list(v) for k, v in methods.items()}
    schema = T.StructType([*(s.df.schema[k] for k in keys), *fields])
    leaves = max(1, np.prod([len(methods[stage]) for stage in LIGHT]))
    several = len(methods["imputation"]) > 1

    def run(batches):
        for batch in batches:
            lists = batch.column("rows")
            flat = lists.flatten()
            size = pc.list_value_length(lists).to_numpy()
            coded = flat.field("signal").dictionary_encode()
            called = sorted(coded.dictionary.to_pylist())
            signal = np.array([called.index(x) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            idx = flat.field("idx").to_numpy()
            rec = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((idx, signal, rec))
            value, clean, t = (flat.field(c).to_numpy(zero_copy_only=False).astype(float)[by] for c in ("value", "clean", "t"))
            signal = signal[by]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(rec) != 0) | (np.diff(signal) != 0), [True]]))
            alike: dict[tuple, list] = {}
            first = np.flatnonzero(np.concatenate([[True], np.diff(rec[new[:-1]]) != 0, [True]]))
            for a, b in zip(first, first[1:]):
                rows = np.diff(new[a:b + 1])
                if (rows != rows[0]).any():
                    raise ValueError("the signals of a recording need the same rows")
                alike.setdefault((int(rows[0]), tuple(signal[new[a:b]].tolist())), []).append((int(rec[new[a]]), int(new[a])))
            for (n, which), found in alike.items():
                many = max(1, BATCH_CELLS // (n * leaves))
                for some in (found[k:k + many] for k in range(0, len(found), many)):
                    mine = pa.array([r for r, _ in some])
                    cells = np.array([at for _, at in some])[:, None] + np.arange(n)
                    own = [batch.column(k).take(mine) for k in keys]
                    texts = list(zip(*(k.cast(pa.string()).to_pylist() for k in own)))

                    def name(r, label):
                        return ":".join([str(seed), *(x for x in texts[r] if x is not None), *(label if several else ())])

                    xs, cs = ([v[cells + k * n] for k in range(len(which))] for v in (value, clean))
                    out = made([called[k] for k in which], _leaves(xs, cs, t[cells], methods, orders, rate, bench, name), len(some))
                    times = len(out[0]) // len(some)
                    if times > 1:
                        own = [k.take(pa.array(np.repeat(np.arange(len(some)), times))) for k in own]
                    yield pa.RecordBatch.from_arrays([*own, *out], names=schema.names)

    row = F.struct("signal", "idx", "t", "value", "clean")
    return s.df.groupBy(*keys).agg(F.collect_list(row).alias("rows")).mapInArrow(run, schema)


def numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)


def by_recording(labels: list[tuple], recordings: int) -> list[pa.Array]:
    """The four parts of the labels, all candidates of one recording after those of another."""
    at = pa.array(np.tile(np.arange(len(labels)), recordings))
    return [pa.array(part, pa.string()).take(at) for part in zip(*labels)]


def leaf_measures(s: Series, methods: dict[str, list[str]], orders, rate: float, semantics: str = "app") -> DataFrame:
    """keys without signal, order, imputation, outlier, smoothing, signal and MEASURES, one row per candidate and signal; and
    the uncleaned copy, with the order `dirty`. s: value and clean per row; it has to fit into blocks."""
    unknown = [m for stage in LIGHT for m in methods[stage] if m not in LIGHT[stage]]
    if unknown:
        raise ValueError(f"methods that look across rows: {unknown}")
    fields = [T.StructField(c, T.StringType()) for c in (*LABELS, "signal")] + [T.StructField(c, T.DoubleType()) for c in MEASURES]

    def made(names, leaves, recordings):
        labels, found = zip(*leaves)
        every = [(*label, x) for label in sum(labels, []) for x in names]
        whole = {m: np.concatenate([f[m] for f in found], axis=1).transpose(2, 1, 0).ravel() for m in MEASURES}
        return [*by_recording(every, recordings), *(numbers(whole[m]) for m in MEASURES)]

    return _of_whole_recordings(s, methods, orders, rate, semantics, 0, fields, made)


def candidate_measures(s: Series, methods: dict[str, list[str]], orders, rate: float, semantics: str, signals, seed: int = 42) -> DataFrame:
    """keys without signal, `dirty` (the medians over the signals of the uncleaned copy) and `leaves`, a list with an entry per
    candidate: its label, the medians, and the errors of `validate.overall_error`. One row per recording copy."""
    errors = [f"{e}_{x}" for e in ("nrmse", "rmse") for x in signals]
    middle = [m for m in MEASURES if m not in ("rmse", "sd", "cells", "gone")]
    values = [*middle, "nrmse", "mean_raw_rmse", *errors, "remaining_missing_fraction"]
    double = lambda names: [T.StructField(c, T.DoubleType()) for c in names]
    leaf = T.StructType([*(T.StructField(c, T.StringType()) for c in LABELS), *double(values), T.StructField("valid_rmse", T.BooleanType())])
    fields = [T.StructField("dirty", T.StructType(double(middle))), T.StructField("leaves", T.ArrayType(leaf))]

    def mid(v):
        rows = np.sort(v.reshape(len(v), -1).T, axis=1)
        return quantile(rows, (~np.isnan(rows)).sum(axis=1), 0.5).reshape(v.shape[1:])

    def mean(v):
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.nansum(v, axis=0) / (~np.isnan(v)).sum(axis=0)

    def made(names, leaves, recordings):
        found = iter(leaves)
        dirty = next(found)[1]
        labels, cols = [], {c: [] for c in (*values, "valid_rmse")}
        for more, f in found:
            labels += more
            gone = f["gone"].sum(axis=0) / f["cells"].sum(axis=0)
            relative, valid = f["rmse"] / (f["sd"] + TINY), gone == 0
            here = {"nrmse": mean(relative), "mean_raw_rmse": mean(f["rmse"])}
            for e, v in (("nrmse", relative), ("rmse", f["rmse"])):
                here |= {f"{e}_{x}": v[names.index(x)] if x in names else np.full(gone.shape, np.nan) for x in signals}
            here = {c: np.where(valid, v, np.nan) for c, v in here.items()}
            here |= {m: mid(f[m]) for m in middle} | {"remaining_missing_fraction": gone, "valid_rmse": valid}
            for c in cols:
                cols[c].append(here[c])
        cols = {c: np.concatenate(v).T.ravel() for c, v in cols.items()}
        entries = pa.StructArray.from_arrays([*by_recording(labels, recordings), *(numbers(cols[c]) for c in values), pa.array(cols["valid_rmse"])],
                                             names=[f.name for f in leaf])
        begin = pa.array(np.arange(recordings + 1, dtype=np.int32) * len(labels))
        return [pa.StructArray.from_arrays([numbers(mid(dirty[m])[0]) for m in middle], names=middle), pa.ListArray.from_arrays(begin, entries)]

    return _of_whole_recordings(s, methods, orders, rate, semantics, seed, fields, made)
