"""Welch power spectra: half-overlapping Hann segments of at most 256 samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 256
STEP = SEGMENT // 2


def periodogram(x: np.ndarray) -> np.ndarray:
    """One-sided power (up to a constant factor) of detrended, Hann-tapered rows."""
    n = x.shape[-1]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((x - x.mean(axis=-1, keepdims=True)) * taper)) ** 2
    power[..., 1:(-1 if n % 2 == 0 else None)] *= 2
    return power


def segment_mean_power(x: np.ndarray) -> np.ndarray:
    """Power averaged over the half-overlapping full segments of one short series."""
    n = min(SEGMENT, len(x))
    return periodogram(np.lib.stride_tricks.sliding_window_view(x, n)[::max(1, n // 2)]).mean(axis=0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def segment_power(samples: pd.Series) -> pd.Series:
    return pd.Series([periodogram(np.asarray(x, dtype=float)) for x in samples])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("roll_range", "spectral_entropy", "dominant_frequency_ratio")]))
def series_dynamics(samples: pd.Series, spectrum: pd.Series) -> pd.DataFrame:
    """Range of the rolling mean over a tenth of the series, spectral entropy and strongest bin."""
    out = []
    for x, wanted in zip(samples, spectrum):
        x = np.array([np.nan if v is None else v for v in x], dtype=float)
        n = len(x)
        if n == 0 or np.isnan(x).any():
            out.append((None, None, None))
            continue
        w = max(10, n // 10)
        run = np.cumsum(x - x.mean())
        early = np.concatenate([np.zeros(min(w, n)), run[:-w]]) if n > w else np.zeros(n)
        mean = ((run - early) / np.minimum(w, np.arange(1, n + 1)))[max(5, w // 3) - 1:]
        roll = float(mean.max() - mean.min()) if len(mean) else None
        power = segment_mean_power(x) if wanted else np.zeros(1)
        if power.sum() > 0 and len(power) > 1:
            p = power / power.sum()
            out.append((roll, float(-(p * np.log(p + 1e-12)).sum() / np.log(len(p))), float(p.max())))
        else:
            out.append((roll, 0.0, 0.0))
    return pd.DataFrame(out, columns=["roll_range", "spectral_entropy", "dominant_frequency_ratio"], dtype=float)


def welch(df: DataFrame, keys, value: str, length: Column) -> DataFrame:
    """(keys, bin, power): power averaged over the full segments of each series.

    Every sample goes to the at most two segments that contain it, so a group
    never holds more than 256 samples however long the series is.
    """
    at = F.floor(F.col("idx") / STEP)
    segments = F.when(length < SEGMENT, F.array(F.lit(0).cast("long"))).otherwise(F.array(at, at - 1))
    rows = df.select(*keys, F.explode(segments).alias("_seg"), "idx", F.col(value).alias("_v"),
                     F.least(length, F.lit(SEGMENT)).alias("_need"))
    full = (rows.filter(F.col("_seg") >= 0).groupBy(*keys, "_seg")
            .agg(F.sort_array(F.collect_list(F.struct("idx", "_v"))).alias("_s"), F.max("_need").alias("_need"))
            .filter(F.size("_s") == F.col("_need")))
    power = full.select(*keys, F.posexplode(segment_power(F.transform("_s", lambda s: s["_v"]))).alias("bin", "_p"))
    return power.groupBy(*keys, "bin").agg(F.avg("_p").alias("power"))


def spectral_shape(spectrum: DataFrame, keys) -> DataFrame:
    """Normalised entropy and the share of the strongest bin."""
    total = spectrum.groupBy(*keys).agg(
        F.sum("power").alias("_tot"), F.count(F.lit(1)).alias("_bins"),
        F.collect_list("power").alias("_p"))
    share = F.transform("_p", lambda p: p / F.col("_tot"))
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.ln(p + F.lit(1e-12)))
    live = F.col("_tot") > 0
    return total.select(
        *keys,
        F.when(live, F.try_divide(entropy, F.ln(F.col("_bins").cast("double")))).otherwise(0.0).alias("spectral_entropy"),
        F.when(live, F.array_max("_p") / F.col("_tot")).otherwise(0.0).alias("dominant_frequency_ratio"))
