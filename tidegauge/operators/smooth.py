"""Smoothing of finite segments: moving median, Savitzky-Golay, zero-phase Butterworth.

A segment is a run of observed samples without a long interruption. It is cut
into chunks of bounded length; each chunk carries enough rows of its neighbours
that the filter's answer inside the chunk equals that of the whole segment.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.series import Series

MIN_SEGMENT = 9
MEDIAN_WINDOW = 9
SAVGOL_WINDOW, SAVGOL_ORDER = 21, 3
CUTOFF = 0.4  # share of the Nyquist rate, whatever the sampling rate
PAD = 12  # samples of odd extension on each side
FAINT = 1e-20  # what is left of a response that has died out
CHUNK = 4096
HALO = 128
GRID_LIMIT = 1_000_000


def moving_median(x: np.ndarray, zero_pad: bool = False) -> np.ndarray:
    half = MEDIAN_WINDOW // 2
    padded = np.pad(x, half, mode="constant") if zero_pad else np.pad(x, half, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, MEDIAN_WINDOW), axis=1)


@cache
def savgol_hat(w: int) -> np.ndarray:
    """Fitted values of a window of w samples, from its samples."""
    powers = np.arange(-(w // 2), w // 2 + 1)[:, None] ** np.arange(SAVGOL_ORDER + 1)
    return powers @ np.linalg.pinv(powers)


def savgol(x: np.ndarray) -> np.ndarray:
    """Cubic fit in a window of 21, or the largest odd number that fits."""
    n = len(x)
    w = min(SAVGOL_WINDOW, n if n % 2 else n - 1)
    half, hat = w // 2, savgol_hat(w)
    out = np.empty(n)
    out[half:n - half] = np.convolve(x, hat[half][::-1], mode="valid")
    out[:half] = (hat @ x[:w])[:half]
    out[n - half:] = (hat @ x[n - w:])[half + 1:]
    return out


@cache
def butterworth_response(taps: int = 256) -> np.ndarray:
    """Impulse response of the third-order low-pass, from the bilinear transform."""
    c = 1.0 / np.tan(np.pi * CUTOFF / 2)
    a = np.convolve([1 + c, 1 - c], [1 + c + c * c, 2 - 2 * c * c, 1 - c + c * c])
    b = np.array([1.0, 3.0, 3.0, 1.0]) / a[0]
    a = a / a[0]
    h = np.zeros(taps)
    for i in range(taps):
        h[i] = (b[i] if i < 4 else 0.0) - sum(a[k] * h[i - k] for k in range(1, min(i, 3) + 1))
    return h


def butterworth(x: np.ndarray) -> np.ndarray:
    """Forward and backward pass, each started in the steady state of its first sample.

    The response dies out within the taps, so a pass is a plain convolution.
    """
    if len(x) <= PAD:
        return x
    h = butterworth_response()
    ext = np.concatenate([2 * x[0] - x[PAD:0:-1], x, 2 * x[-1] - x[-2:-PAD - 2:-1]])

    def one_way(y):
        return y[0] + np.convolve(y - y[0], h)[:len(y)]

    return one_way(one_way(ext)[::-1])[::-1][PAD:-PAD]


# Exchanges that bring the middle of nine values to place 4.
MIDDLE = ((1, 2), (4, 5), (7, 8), (0, 1), (3, 4), (6, 7), (1, 2), (4, 5), (7, 8), (0, 3), (5, 8), (4, 7), (3, 6), (1, 4), (2, 5), (4, 7), (4, 2), (6, 4), (4, 2))


def rows_smoothed(x: np.ndarray, method: str, zero_pad: bool = False) -> np.ndarray:
    """Every row of a matrix without gaps, as the filters below give it."""
    rows, n = x.shape
    if method == "moving_median":
        half = MEDIAN_WINDOW // 2
        wide = np.pad(x, ((0, 0), (half, half)), mode="constant" if zero_pad else "edge")
        return middle_of([wide[:, k:k + n] for k in range(MEDIAN_WINDOW)])
    if method == "savgol":
        w = min(SAVGOL_WINDOW, n if n % 2 else n - 1)
        half, hat = w // 2, savgol_hat(w)
        out = np.empty(x.shape)
        # Term by term: a row's digits don't depend on the rows beside it.
        out[:, half:n - half] = sum(x[:, k:n - w + 1 + k] * hat[half, k] for k in range(w))
        out[:, :half] = sum(x[:, k, None] * hat[:half, k] for k in range(w))
        out[:, n - half:] = sum(x[:, n - w + k, None] * hat[half + 1:, k] for k in range(w))
        return out
    return np.array([butterworth(v) for v in x])


def middle_of(v: list[np.ndarray]) -> np.ndarray:
    """The middle of nine arrays, cell by cell."""
    v = list(v)
    for i, j in MIDDLE:
        v[i], v[j] = np.minimum(v[i], v[j]), np.maximum(v[i], v[j])
    return v[4]


def parts_smoothed(x: np.ndarray, method: str, zero_pad: bool = False) -> np.ndarray:
    """Every run of observed samples in the rows of a matrix as `rows_smoothed` gives it; NaN where missing.

    Runs of all lengths go together: only the edges of a run and short runs are taken out of the matrix.
    """
    gone = np.isnan(x)
    if not gone.any() and method != "butterworth":
        return rows_smoothed(x, method, zero_pad) if x.shape[1] >= MIN_SEGMENT else x
    out = x.copy()
    edge = np.diff(np.pad(~gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, begin = np.nonzero(edge == 1)
    length = np.nonzero(edge == -1)[1] - begin
    some = length >= MIN_SEGMENT
    rows, begin, length = rows[some], begin[some], length[some]
    if not len(rows):
        return out

    def one_length(rows, begin, length):
        for n in np.unique(length):
            at = rows[length == n, None], begin[length == n, None] + np.arange(n)
            out[at] = rows_smoothed(x[at], method, zero_pad)

    if method == "moving_median" and zero_pad:
        one_length(rows, begin, length)
    elif method == "moving_median":
        # The observed samples of all runs in a line, each run between its own edges.
        half, at = MEDIAN_WINDOW // 2, np.arange(x.shape[1])
        mark = np.zeros(x.shape[0] * x.shape[1] + 1, np.int8)
        first = rows * x.shape[1] + begin
        mark[first] += 1
        mark[first + length] -= 1
        cell = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
        low, high = np.repeat(first, length), np.repeat(first + length - 1, length)
        flat = x.ravel()
        out.ravel()[cell] = middle_of([flat[np.minimum(np.maximum(cell + k, low), high)] for k in range(-half, half + 1)])
    elif method == "savgol":
        w, half = SAVGOL_WINDOW, SAVGOL_WINDOW // 2
        short = length < w
        one_length(rows[short], begin[short], length[short])
        rows, begin, length = rows[~short], begin[~short], length[~short]
        if not len(rows):
            return out
        hat, n = savgol_hat(w), x.shape[1]
        inner = x[:, :n - w + 1] * hat[half, 0]
        for k in range(1, w):
            inner += x[:, k:n - w + 1 + k] * hat[half, k]
        here = out[:, half:n - half]
        np.copyto(here, inner, where=~np.isnan(inner))
        for start, mine, place in ((begin, slice(0, half), 0), (begin + length - w, slice(half + 1, w), half + 1)):
            v = x[rows[:, None], start[:, None] + np.arange(w)]
            out[rows[:, None], start[:, None] + place + np.arange(half)] = sum(v[:, k, None] * hat[mine, k] for k in range(w))
    else:
        many = length > PAD  # the others stay as they are
        _butterworth_parts(x, out, rows[many], begin[many], length[many])
    return out


def _butterworth_parts(x: np.ndarray, out: np.ndarray, rows: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Runs of over PAD samples in one line, so far apart that the response to one has died out before the next."""
    if not len(rows):
        return
    h = butterworth_response()
    h = h[:np.flatnonzero(np.abs(h) > FAINT)[-1] + 1]
    size = length + 2 * PAD
    start = np.cumsum(size + len(h)) - size - len(h)
    run = np.repeat(np.arange(len(size)), size)
    base = np.cumsum(size) - size
    at = np.arange(len(run)) - base[run]
    step, n = at - PAD, length[run]
    flat, first = x.ravel(), rows * x.shape[1] + begin
    v = flat[first[run] + np.where(step < 0, -step, np.where(step >= n, 2 * (n - 1) - step, step))]
    v = np.where(step < 0, 2 * flat[first][run] - v, np.where(step >= n, 2 * flat[first + length - 1][run] - v, v))
    place, back = start[run] + at, base[run] + size[run] - 1 - at
    line = np.zeros(len(h) - 1 + start[-1] + size[-1])

    def one_way(v):
        head = v[base][run]
        line[len(h) - 1 + place] = v - head
        return np.convolve(line, h, "valid")[place] + head  # as many terms each, so a run's digits don't depend on the others

    v = one_way(one_way(v)[back])[back]
    own = (step >= 0) & (step < n)
    out.ravel()[(first[run] + step)[own]] = v[own]


FILTERS = {"moving_median": moving_median, "savgol": savgol, "butterworth": butterworth}


def _chunk_udf(method: str, zero_pad: bool):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(at: pd.Series, values: pd.Series, rows: pd.Series, chunk: pd.Series, resampled: pd.Series) -> pd.Series:
        def apply(x):
            if len(x) < MIN_SEGMENT:
                return x
            return moving_median(x, zero_pad) if method == "moving_median" else FILTERS[method](x)

        out = []
        for g, v, n, c, re in zip(at, values, rows, chunk, resampled):
            v = np.asarray(v, dtype=float)
            if n < MIN_SEGMENT or not len(v):
                out.append(v)
            elif not re:
                out.append(apply(v))
            else:
                g = np.asarray(g, dtype=float)
                lo = max(0, int(np.floor(g[0])), c * CHUNK - HALO)
                hi = max(lo + 1, min(int(np.ceil(g[-1])), (c + 1) * CHUNK + HALO))
                grid = np.arange(lo, hi + 1, dtype=float)
                out.append(np.interp(g, grid, apply(np.interp(grid, g, v))))
        return pd.Series(out)
    return run


def segments(s: Series, max_gap: float | None = None) -> Series:
    """seg (idx and t of the first sample), seg_rows, and the neighbours' times, on observed rows."""
    row = F.struct("value", "t")
    s = s.scan(lag={"_b": row}, lead={"_a": row})
    seen, b, a = F.col("value").isNotNull(), F.col("_b"), F.col("_a")
    opens = seen & (b.isNull() | b["value"].isNull())
    closes = seen & (a.isNull() | a["value"].isNull())
    if max_gap is not None:
        opens = seen & (opens | (F.col("t") - b["t"] > max_gap))
        closes = seen & (closes | (a["t"] - F.col("t") > max_gap))
    s = s.on(s.df.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("_closes", F.coalesce(closes, F.lit(False))))
    s = s.scan(last={"seg": F.when(F.col("_opens"), F.struct("idx", "t"))},
               first={"seg_end": F.when(F.col("_closes"), F.struct("idx", "t"))})
    return s.on(s.df.withColumn("seg_rows", F.when(seen, F.col("seg_end")["idx"] - F.col("seg")["idx"] + 1))
                .withColumn("_bt", F.when(~F.col("_opens"), b["t"])).withColumn("_at", F.when(~F.col("_closes"), a["t"]))
                .drop("_b", "_a"))


def smooth(s: Series, methods, max_gap: float | None = None, irregular: Column | None = None, resample: bool = False,
           fs: Column | None = None, semantics: str = "app", only: str | None = None) -> Series:
    """Column smo_<method> for every method; missing positions stay missing.

    ``only`` names a column that tells the one method of each series; the others' columns may be empty there.

    ``irregular`` marks rows of recordings with irregular timing: these come
    back as they are unless ``resample`` is set, and are then filtered on a
    uniform grid at ``fs`` inside each segment and read back at the observed
    times. Segments whose grid would have over GRID_LIMIT cells come back as
    they are as well; settings_log tells of both.
    """
    keep = list(s.df.columns)
    work = [m for m in methods if m != "none"]
    if not work:
        return s.on(s.df.select("*", F.col("value").alias("smo_none")))
    irregular = F.lit(False) if irregular is None else irregular
    s = segments(s.with_column("_irregular", F.coalesce(irregular, F.lit(False))), max_gap)
    if work == ["moving_median"] and not s.blocked and not resample and semantics != "bench":
        return _medians_by_row(s, methods, keep)
    seg, seen = F.col("seg"), F.col("value").isNotNull()
    rate = F.lit(1.0) if fs is None else fs
    on_grid = lambda t: (t - seg["t"]) * rate
    by_row = (F.col("idx") - seg["idx"]).cast("double")
    fits = F.coalesce(on_grid(F.col("seg_end")["t"]) <= GRID_LIMIT, F.lit(False))
    regrid = F.col("_irregular") & F.lit(resample) & fits
    s = s.on(s.df.withColumn("_re", regrid).withColumn("_as_is", F.col("_irregular") & ~regrid))
    g = F.when(F.col("_re"), on_grid(F.col("t"))).otherwise(by_row)
    before = F.when(F.col("_re"), F.floor(on_grid(F.coalesce("_bt", "t")))).otherwise(F.floor(by_row))
    after = F.when(F.col("_re"), F.ceil(on_grid(F.coalesce("_at", "t")))).otherwise(F.floor(by_row))
    first_chunk = F.greatest(F.lit(0), F.floor((before - HALO) / CHUNK))
    last_chunk = F.least(F.floor((after + HALO) / CHUNK),
                         F.floor(F.when(F.col("_re"), F.ceil(on_grid(F.col("seg_end")["t"])))
                                 .otherwise(F.col("seg_rows") - 1) / CHUNK))
    own = F.floor(g / CHUNK)
    chunks = F.when(seen, F.sequence(first_chunk, last_chunk)).otherwise(F.array(F.floor(F.col("idx") / CHUNK)))
    rest = [c for c in keep if c not in (*s.keys, "idx", "value")]
    rows = s.df.select(
        *s.keys, F.when(seen, seg["idx"]).otherwise(-1).alias("_seg"), F.col("seg_rows").alias("_n"), F.col("_re"),
        F.explode(chunks).alias("_c"), F.when(seen, own).alias("_own"),
        F.struct("idx", g.alias("g"), "value", "_as_is", *rest).alias("_r"))
    rows = rows.withColumn("_mine", ~seen_col() | (F.col("_own") == F.col("_c")))
    groups = rows.groupBy(*s.keys, "_seg", "_c").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_r.idx").alias("i"), F.col("_mine").alias("own"), F.col("_r").alias("r")))).alias("_rows"),
        F.max(F.coalesce("_n", F.lit(0))).alias("_n"), F.max("_re").alias("_re"),
        F.lit(None).cast("string").alias("_only") if only is None else F.max("_r." + only).alias("_only"))
    none = F.array().cast("array<double>")

    def samples(field: str, m: str) -> Column:
        c = F.transform("_rows", lambda r: r["r"][field])
        return c if only is None else F.when(F.col("_only") == m, c).otherwise(none)

    args = lambda m: (samples("g", m), samples("value", m), F.col("_n"), F.col("_c"), F.col("_re"))
    groups = groups.select(*s.keys, "_rows", *[_chunk_udf(m, semantics == "bench")(*args(m)).alias("smo_" + m) for m in work])
    flat = groups.select(*s.keys, F.explode(F.arrays_zip("_rows", *["smo_" + m for m in work])).alias("z")).filter("z._rows.own")
    r = "z._rows.r."
    plain = {c: F.col(r + c) for c in ("idx", "value", *rest)}
    out = [plain[c].alias(c) if c in plain else F.col(c) for c in keep]
    smo = [(F.col(r + "value") if m == "none" else F.when(F.col(r + "_as_is"), F.col(r + "value"))
            .when(F.col(r + "value").isNotNull(), F.col("z.smo_" + m))).alias("smo_" + m)
           for m in methods]
    return s.on(flat.select(*out, *smo))


def _medians_by_row(s: Series, methods, keep: list[str]) -> Series:
    """Moving medians of whole series next to their rows, which stay where they are: no list of rows, no other shuffle.

    A neighbour beyond the segment is replaced by the one before it, which is the segment's edge.
    """
    order, v = W.partitionBy(*s.keys).orderBy(F.desc("idx")), F.col("value")
    here = F.struct(F.col("seg")["idx"].alias("seg"), v.alias("v"))
    half = MEDIAN_WINDOW // 2
    df = s.df.select("*", *[side(here, k).over(order).alias(f"_{side.__name__}{k}") for side in (F.lag, F.lead) for k in range(1, half + 1)])
    window = [v]
    for side in ("lag", "lead"):
        edge = v
        for k in range(1, half + 1):
            near = F.col(f"_{side}{k}")
            edge = F.when((near["seg"] == F.col("seg")["idx"]) & near["v"].isNotNull(), near["v"]).otherwise(edge)
            window.append(edge)
    middle = F.get(F.sort_array(F.array(*window)), half)
    as_is = F.col("_irregular") | (F.col("seg_rows") < MIN_SEGMENT)
    smo = {"none": v, "moving_median": F.when(v.isNotNull(), F.when(as_is, v).otherwise(middle))}
    return s.on(df.select(*keep, *[smo[m].alias("smo_" + m) for m in methods]))


def seen_col() -> Column:
    return F.col("_r.value").isNotNull()


def settings_log(s: Series, method: str, max_gap: float | None = None, irregular: Column | None = None, resample: bool = False,
                 fs: Column | None = None) -> DataFrame:
    """Per series and parameter set: how many segments were filtered, left for irregular times or a huge grid, or skipped."""
    s = segments(s.with_column("_irregular", F.lit(False) if irregular is None else F.coalesce(irregular, F.lit(False))), max_gap)
    cells = (F.col("seg_end")["t"] - F.col("seg")["t"]) * (F.lit(1.0) if fs is None else fs)
    n = F.col("seg_rows")
    odd = F.when(n % 2 == 1, n).otherwise(n - 1)
    window = {"moving_median": F.lit(MEDIAN_WINDOW).cast("long"), "savgol": F.least(F.lit(SAVGOL_WINDOW), odd).cast("long"),
              "butterworth": F.lit(None).cast("long")}[method]
    used = F.when(F.col("_irregular") & F.lit(not resample), "irregular").when(F.col("_irregular") & (cells > GRID_LIMIT), "grid_too_large")
    used = used.when(n < MIN_SEGMENT, "skipped").when((n <= PAD) & F.lit(method == "butterworth"), "too_short").otherwise("applied")
    return (s.df.filter("_opens")
            .groupBy(*s.keys, used.alias("status"), F.when(n >= MIN_SEGMENT, window).alias("window_samples"))
            .agg(F.count(F.lit(1)).alias("segments"), F.sum(n).alias("samples")))
