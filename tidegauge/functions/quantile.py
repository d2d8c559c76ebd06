"""Exact linear quantiles per group without holding a long group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000


def _halves(x: Column) -> tuple[Column, Column]:
    """Two numbers of half the digits each that add up to x."""
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    return high, x - high


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share; the first product goes into the sum unrounded, like a fused multiply-add.

    The SQL engine rounds that way, and a value that lies on a quartile fence is flagged or not by the last digit.
    """
    rest = F.lit(1.0) - share
    (ah, al), (bh, bl) = _halves(low), _halves(rest)
    first, second = low * rest, high * share
    lost = ((ah * bh - first) + ah * bl + al * bh) + al * bl
    total = first + second
    part = total - first
    lost_too = (first - (total - part)) + (second - part)
    return F.when(F.abs(low) < 1e290, total + (lost_too + lost)).otherwise(total)


def exact_quantiles(df: DataFrame, keys, column: Column, probs: dict[str, float], block: int,
                    groups: int, broadcast_rows: int) -> DataFrame:
    """One row per group with one column per probability.

    A mergeable sketch brackets each quantile of a long group between two
    values; only the rows in the bracket are sorted, and the rows below it are
    counted. Short groups are bracketed by the whole line.
    """
    names, targets = list(probs), list(probs.values())
    slack = 2.0 / ACCURACY
    grid = [min(1.0, max(0.0, p + d)) for p in targets for d in (-slack, slack)]
    base = df.select(*keys, F.floor(F.col("idx") / block).alias("_blk"), column.cast("double").alias("_x"))
    lens = base.groupBy(*keys).agg(
        F.count("_x").alias("_n"), F.max("_blk").alias("_top"),
        F.percentile_approx("_x", grid, ACCURACY).alias("_q"))
    inf = float("inf")
    # The sketch is off by at most 1 / ACCURACY of the rows; the bracket leaves twice
    # that on each side, which also covers rounding once there are this many rows.
    short = F.col("_n") <= max(block, 2 * ACCURACY)

    def bound(j: int, side: int) -> Column:
        open_end = grid[2 * j + side] in (0.0, 1.0)
        end = F.lit(inf if side else -inf)
        return end if open_end else F.when(short, end).otherwise(F.col("_q")[2 * j + side])

    bounds = lens.select(
        *keys, "_n", "_top",
        *[bound(j, s).alias(f"_{'lh'[s]}{j}") for j in range(len(targets)) for s in (0, 1)])
    if groups <= broadcast_rows:
        rows = base.join(F.broadcast(bounds.drop("_top")), list(keys))
    else:
        spread = bounds.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_top")))).drop("_top")
        rows = base.join(spread, [*keys, "_blk"])
    rows = rows.filter(F.col("_x").isNotNull())
    low = [F.col(f"_l{j}") for j in range(len(targets))]
    high = [F.col(f"_h{j}") for j in range(len(targets))]
    # Only (value, count) pairs inside a bracket leave the map side.
    inside = F.array(*[F.when((F.col("_x") >= lo) & (F.col("_x") <= hi), F.lit(j))
                       for j, (lo, hi) in enumerate(zip(low, high))])
    below = rows.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        F.array(*[F.count_if(F.col("_x") < lo) for lo in low]).alias("_below"))
    pairs = (rows.select(*keys, "_x", F.explode(F.array_compact(inside)).alias("_j"))
             .groupBy(*keys, "_j", "_x").agg(F.count(F.lit(1)).alias("_c")))
    upto = W.partitionBy(*keys, "_j").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    ranked = pairs.withColumn("_cum", F.sum("_c").over(upto)).join(below, list(keys))
    p = F.element_at(F.array(*[F.lit(float(t)) for t in targets]), F.col("_j") + 1)
    end = F.col("_cum") + F.element_at("_below", F.col("_j") + 1)
    pos = (F.col("_n") - 1) * p
    ranked = (ranked.withColumn("_pos", pos).withColumn("_end", end).withColumn("_beg", end - F.col("_c")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_beg") <= rank) & (rank < F.col("_end")), F.col("_x")))

    picked = ranked.groupBy(*keys, "_j").agg(
        at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_b"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("_f"))
    value = interpolated(F.col("_a"), F.col("_b"), F.col("_f"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_j") == j, value)).alias(n) for j, n in enumerate(names)])
