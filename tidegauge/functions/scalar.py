"""Column expressions shared by all operators. Missing is always SQL NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Double with NaN and infinities turned into NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def squash(c: Column) -> Column:
    """max(0, x) / (1 + max(0, x)); NULL stays NULL."""
    pos = F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    return pos / (pos + 1.0)


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal within a tolerance scaled by the second argument; two NULLs are equal."""
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are known; NULL when either is constant."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def uniform(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) that depends only on the given values."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def any_match(name: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [name.rlike(p) for p in patterns])


def long_form(df, signals, keep, value="value", name="signal"):
    """One row per signal. Explode keeps the partitioning of its input, unlike unpivot."""
    pairs = F.array(*[F.struct(F.lit(s).alias("k"), F.col(f"`{s}`").cast("double").alias("v")) for s in signals])
    out = df.select(*keep, F.explode(pairs).alias("_s"))
    return out.select(*keep, F.col("_s.k").alias(name), F.col("_s.v").alias(value))


def wide_form(df, signals, keys, value="value", name="signal"):
    """Inverse of long_form; the signal names are given, so no extra pass looks for them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == s, F.col(value))).alias(s) for s in signals])
