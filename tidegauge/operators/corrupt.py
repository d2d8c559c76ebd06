"""Controlled corruption. Every choice is a hash of seed, recording, signal and row,
so results do not depend on partitioning, retries or row order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.scalar import isclose, uniform
from tidegauge.functions.series import Series, ordered_index

KINDS = ("mcar_missing", "block_missing", "spikes", "drift", "level_shift", "stuck_at", "high_frequency_noise", "clipping")
MAX_BLOCKS = 100


def _limit(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def draw(s: Series, seed: int, tag: str, *more: Column, per_signal: bool = True) -> Column:
    """Uniform number per recording (and signal, and whatever else is given)."""
    keys = [F.col(k) for k in s.keys if per_signal or k != "signal"]
    return uniform(F.lit(seed), F.lit(tag), *keys, *more)


def normal(s: Series, seed: int, tag: str, *more: Column) -> Column:
    """Standard normal number from two uniforms."""
    a, b = draw(s, seed, tag + "a", *more), draw(s, seed, tag + "b", *more)
    return F.sqrt(-2.0 * F.ln(1.0 - a)) * F.cos(F.lit(2 * math.pi) * b)


def ranked(s: Series, by: Column, name: str) -> Series:
    """Rank 0, 1, … of every row of a series by a hash column."""
    df = s.df.withColumn("_h", by)
    return s.on(ordered_index(df, s.keys, ["_h", "idx"], F.col("_h"), s.longest, s.groups, s.block, name).drop("_h"))


def _prepared(s: Series) -> Series:
    """clean, n_rows and scale (population spread, 1 when there is none)."""
    s = s.with_column("clean", F.col("value"))
    s = s.stats({"n_rows": F.count(F.lit(1)), "_sd": F.stddev_pop("value")})
    return s.on(s.df.withColumn("scale", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)).drop("_sd"))


def _finish(s: Series, keep: list[str], value: Column, mask: Column) -> Series:
    return s.on(s.df.select(*keep, "clean", value.alias("value"), F.coalesce(mask, F.lit(False)).alias("mask")))


def _sign(u: Column) -> Column:
    return F.when(u < 0.5, -1.0).otherwise(1.0)


def inject(s: Series, kind: str, severity: float, seed: int = 42) -> Series:
    """Columns clean, value (corrupted) and mask."""
    if kind not in KINDS:
        raise ValueError(f"unknown corruption {kind!r}")
    keep = [c for c in s.df.columns if c not in ("value", "clean", "mask")]
    s = _prepared(s)
    n, idx, v, scale = F.col("n_rows"), F.col("idx"), F.col("clean"), F.col("scale")
    if kind in ("mcar_missing", "spikes"):
        rate = _limit(severity, 0.0, 0.8) if kind == "mcar_missing" else _limit(severity, 0.0005, 0.2)
        s = ranked(s, draw(s, seed, kind, idx), "_rank")
        hit = F.col("_rank") < F.greatest(F.lit(1), F.bround(n * F.lit(rate)))
        if kind == "mcar_missing":
            return _finish(s, keep, F.when(~hit, v), hit)
        size = 4.0 + 5.0 * draw(s, seed, "size", idx)
        jump = v + _sign(draw(s, seed, "sign", idx)) * size * scale
        return _finish(s, keep, F.when(hit, jump).otherwise(v), hit)
    if kind == "block_missing":
        # The block list is made once per series and then laid next to its rows.
        side = s.summary({"n_rows": F.count(F.lit(1)), "_hi": F.max("idx")})
        side = side.select(*s.keys, "_hi", _blocks(s, _limit(severity, 0.0, 0.7), seed).alias("_blocks"))
        s = s.attach(side)
        hit = F.exists("_blocks", lambda b: (idx >= b["start"]) & (idx < b["start"] + b["len"]))
        return _finish(s, keep, F.when(~hit, v), hit)
    if kind == "drift":
        length = F.greatest(F.lit(10), F.floor(n * F.lit(_limit(0.25 + severity, 0.2, 0.9))))
        start = F.floor(draw(s, seed, "start", per_signal=False) * F.greatest(F.lit(1), n - length + 1))
        hit = (idx >= start) & (idx < start + length)
        amount = scale * (0.8 + 4 * severity) * _sign(draw(s, seed, "sign"))
        return _finish(s, keep, F.when(hit, v + amount * (idx - start) / (length - 1)).otherwise(v), hit)
    if kind == "level_shift":
        low, high = F.greatest(F.lit(5), F.floor(n / 5)), F.greatest(F.lit(6), F.floor(4 * n / 5))
        start = low + F.floor(draw(s, seed, "start", per_signal=False) * (high - low))
        amount = scale * (0.8 + 4.5 * severity) * _sign(draw(s, seed, "sign"))
        return _finish(s, keep, F.when(idx >= start, v + amount).otherwise(v), idx >= start)
    if kind == "stuck_at":
        length = F.greatest(F.lit(3), F.floor(n * F.lit(_limit(severity, 0.01, 0.35))))
        s = s.with_column("_start", F.floor(draw(s, seed, "start", per_signal=False) * F.greatest(F.lit(1), n - length + 1)))
        held = F.max(F.when(idx == F.greatest(F.lit(0), F.col("_start") - 1), v))
        s = s.stats({"_held": held})
        hit = (idx >= F.col("_start")) & (idx < F.col("_start") + length)
        return _finish(s, keep, F.when(hit, F.col("_held")).otherwise(v), hit)
    if kind == "high_frequency_noise":
        noise = normal(s, seed, "noise", idx) * scale * (0.05 + 1.4 * severity)
        swing = F.when(idx % 2 == 0, 1.0).otherwise(-1.0) * scale * (0.25 * severity)
        return _finish(s, keep, v + noise + swing, F.lit(True))
    q = _limit(0.01 + severity / 3, 0.01, 0.18)
    s = s.stats(quantiles={"_lo": (F.col("value"), q), "_up": (F.col("value"), 1 - q)})
    clamp = F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_lo")), F.col("_up")))
    return _finish(s, keep, clamp, ~isclose(clamp, v))


def _blocks(s: Series, rate: float, seed: int) -> Column:
    """At most 100 (start, len) blocks per series whose lengths add up to the wanted share."""
    n = F.col("n_rows")
    typical = F.greatest(F.lit(3), F.floor(n * F.lit(max(0.005, rate / 8))))
    top = F.greatest(F.lit(3), F.floor(n / 4))
    wanted = F.greatest(F.lit(1), F.bround(n * F.lit(rate))).cast("long")

    def one(i: Column) -> Column:
        raw = F.floor(F.exp(F.ln(typical) + 0.55 * normal(s, seed, "len", i)))
        return F.greatest(F.lit(2), F.least(top, raw)).cast("long")

    lengths = F.transform(F.sequence(F.lit(0), F.lit(MAX_BLOCKS - 1)), one)
    # Running total, stopped once the wanted number of samples is reached.
    empty = F.array().cast("array<struct<i:int,len:bigint>>")
    start = F.struct(wanted.alias("left"), F.lit(0).alias("i"), empty.alias("out"))

    def step(acc: Column, length: Column) -> Column:
        take = F.least(length, acc["left"])
        more = F.array(F.struct(acc["i"].alias("i"), take.alias("len")))
        return F.struct((acc["left"] - take).alias("left"), (acc["i"] + 1).alias("i"),
                        F.when(take > 0, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    kept = F.aggregate(lengths, start, step)["out"]
    return F.transform(kept, lambda b: F.struct(
        F.floor(draw(s, seed, "at", b["i"]) * F.greatest(F.lit(1), n - b["len"] + 1)).alias("start"), b["len"].alias("len")))


def nested(s: Series, severity: float | Column, seed: int = 42) -> Series:
    """Half missing, half spikes, on fixed ranks: a lower severity is a subset of a higher one."""
    keep = [c for c in s.df.columns if c not in ("value", "clean", "mask")]
    s = _prepared(s)
    severity = F.lit(float(severity)) if isinstance(severity, (int, float)) else severity
    # The hash leaves out keys made by severity copies, so all copies share their ranks.
    base = [F.col(k) for k in ("recording_id", "signal") if k in s.keys]
    s = ranked(s, uniform(F.lit(seed), F.lit("nested"), *base, F.col("idx")), "_rank")
    n, idx, v, rank = F.col("n_rows"), F.col("idx"), F.col("clean"), F.col("_rank")
    hits = F.bround(n * severity).cast("long")
    gone = F.floor(hits / 2)
    half = F.floor(n / 2)
    missing = rank < gone
    spike = (rank >= half) & (rank < half + hits - gone)
    size = 4.0 + 5.0 * uniform(F.lit(seed), F.lit("size"), *base, idx)
    jump = v + _sign(uniform(F.lit(seed), F.lit("sign"), *base, idx)) * size * F.col("scale")
    return _finish(s, keep, F.when(~missing, F.when(spike, jump).otherwise(v)), missing | spike)
