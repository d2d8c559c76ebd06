"""Chained regression estimates across the signals of a recording.

Within a recording every row with the same missing signals is completed by the
same affine map of its observed values. The rounds of regressions therefore need
only the count, sums and cross products of each missing pattern: one aggregate
pass, a small solver on those sums, one pass to find the round in which a
recording settles, and one projection.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.series import Series
from tidegauge.settings import cut

ROUNDS = 8
TOLERANCE = 1e-3


def ridge(gram: np.ndarray, cross: np.ndarray, yy: float, n: float) -> np.ndarray:
    """Evidence-maximising ridge coefficients from centred sums."""
    eig, vec = np.linalg.eigh(gram)
    eig = np.maximum(eig, 0.0)
    prior = 1e-6
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    rotated = vec.T @ cross

    def solve():
        coef = vec @ (rotated / (eig + lam / alpha))
        return coef, max(yy - 2 * coef @ cross + coef @ gram @ coef, 0.0)

    old = None
    for _ in range(300):
        coef, sse = solve()
        gamma = float((alpha * eig / (lam + alpha * eig)).sum())
        lam = (gamma + 2 * prior) / (coef @ coef + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (sse + 2 * prior)
        if old is not None and np.abs(old - coef).sum() < 1e-3:
            break
        old = coef
    return solve()[0]


def chain(patterns: list[str], moments: list[np.ndarray], start: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Affine map of each pattern after each round; row j of a map gives signal j.

    ``moments`` holds the sums of z zᵀ with z = (observed values or 0, 1), and
    ``start`` the initial value of each signal (NaN for one never observed).
    """
    d = len(start)
    live = [j for j in range(d) if not np.isnan(start[j])]
    maps = {}
    for p in patterns:
        m = np.zeros((d, d + 1))
        for j in live:
            if p[j] == "1":
                m[j, j] = 1.0
            else:
                m[j, d] = start[j]
        maps[p] = m
    count = {j: sum(s[d, d] for p, s in zip(patterns, moments) if p[j] == "0") for j in live}
    order = sorted((j for j in live if count[j] > 0), key=lambda j: (count[j], j))
    rounds = [{p: m.copy() for p, m in maps.items()}]
    if len(live) < 2:
        return rounds
    for _ in range(ROUNDS):
        for j in order:
            others = [i for i in live if i != j]
            pick = [*others, j]
            total = np.zeros((len(pick) + 1, len(pick) + 1))
            for p, s in zip(patterns, moments):
                if p[j] == "1":
                    lift = np.vstack([maps[p][pick], np.eye(d + 1)[d]])
                    total += lift @ s @ lift.T
            n = total[-1, -1]
            mean = total[-1, :-1] / n
            centred = total[:-1, :-1] - n * np.outer(mean, mean)
            coef = ridge(centred[:-1, :-1], centred[:-1, -1], max(float(centred[-1, -1]), 0.0), n)
            shift = mean[-1] - coef @ mean[:-1]
            for p in patterns:
                if p[j] == "0":
                    maps[p][j] = coef @ maps[p][others]
                    maps[p][j, d] += shift
        rounds.append({p: m.copy() for p, m in maps.items()})
    return rounds


MAPS = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()),
                                 T.StructField("rounds", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def _solver_udf():
    @F.pandas_udf(MAPS)
    def solve(sums: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for group, begin in zip(sums, start):
            begin = np.array([np.nan if v is None else v for v in begin], dtype=float)
            d = len(begin)
            group = sorted(group, key=lambda g: g["pattern"])
            patterns = [g["pattern"] for g in group]
            moments = [np.array(list(g["m"]), dtype=float).reshape(d + 1, d + 1) for g in group]
            rounds = chain(patterns, moments, begin)
            out.append([{"pattern": p, "rounds": [r[p].ravel().tolist() for r in rounds]} for p in patterns])
        return pd.Series(out)
    return solve


def estimates(s: Series, signals: list[str]) -> DataFrame:
    """(recording_id, signal, idx, estimate) for every missing cell of a wide series."""
    keys, d = list(s.keys), len(signals)
    # Centred on the mean, so that the sums keep their digits.
    s = s.stats({f"_a_{c}": F.avg(c) for c in signals}, {f"_m_{c}": (F.col(c), 0.5) for c in signals})
    rows = s.df.select(
        *keys, "idx",
        F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in signals]).alias("pattern"),
        *[F.coalesce(F.col(c) - F.col(f"_a_{c}"), F.lit(0.0)).alias(f"z{j}") for j, c in enumerate(signals)],
        F.lit(1.0).alias(f"z{d}"),
        F.greatest(*[F.abs(F.col(c)) for c in signals], F.lit(0.0)).alias("_size"),
        F.array(*[F.col(f"_m_{c}") - F.col(f"_a_{c}") for c in signals]).alias("_start"),
        F.array(*[F.col(f"_a_{c}") for c in signals]).alias("_mean"))
    if s.blocked:
        rows = cut(rows)
    pairs = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(d + 1) for j in range(d + 1)]
    sums = rows.groupBy(*keys, "pattern").agg(F.array(*pairs).alias("m"), F.max("_size").alias("_big"), F.max("idx").alias("_hi"),
                                               F.first("_start").alias("_start"))
    per = sums.groupBy(*keys).agg(F.collect_list(F.struct("pattern", "m")).alias("sums"), F.max("_big").alias("_big"),
                                  F.max("_hi").alias("_hi"), F.first("_start").alias("_start"))
    solved = per.select(*keys, "_big", "_hi", F.explode(_solver_udf()("sums", "_start")).alias("_s"))
    maps = solved.select(*keys, F.col("_s.pattern").alias("pattern"), "_big", "_hi", F.col("_s.rounds").alias("rounds"))
    maps = maps.filter(F.col("pattern").contains("0"))
    # Only incomplete rows need a map; a recording has at most 2^signals of them.
    holes = Series(rows.filter(F.col("pattern").contains("0")), (*keys, "pattern"), s.longest, s.groups * 2 ** d, s.block)
    gaps = holes.attach(maps).df
    z = F.array(*[F.col(f"z{j}") for j in range(d + 1)])

    def value(m, j: int):
        part = F.zip_with(F.slice(m, j * (d + 1) + 1, d + 1), z, lambda a, b: a * b)
        return F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v)

    step = lambda a, b: sum((F.when(F.substring("pattern", j + 1, 1) == "0", F.abs(value(a, j) - value(b, j))).otherwise(0.0)
                             for j in range(d)), F.lit(0.0))
    moves = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("rounds") - 1)),
                        lambda r: F.when(F.size("rounds") > 1, step(F.element_at("rounds", r + 1), F.element_at("rounds", r))).otherwise(0.0))
    gaps = gaps.withColumn("_moves", moves)
    settled = gaps.groupBy(*keys).agg(
        F.max("idx").alias("_hi"),
        F.array(*[F.max(F.get("_moves", F.lit(r))) for r in range(ROUNDS)]).alias("_max"), F.max("_big").alias("_big"))
    # Rounds stop when no row moved by more than the tolerance times the largest value.
    stop = F.array_position(F.transform("_max", lambda x: F.coalesce(x < TOLERANCE * F.col("_big"), F.lit(False))), True)
    settled = settled.select(*keys, "_hi", F.when(stop > 0, stop).otherwise(ROUNDS).alias("_stop"))
    done = s.on(gaps.drop("_moves", "_big")).attach(settled).df
    chosen = F.element_at("rounds", F.least(F.col("_stop") + 1, F.size("rounds")).cast("int"))
    done = done.withColumn("_map", chosen)
    cells = F.array(*[F.struct(F.lit(c).alias("signal"), (value(F.col("_map"), j) + F.col("_mean")[j]).alias("estimate"),
                               (F.substring("pattern", j + 1, 1) == "0").alias("gap")) for j, c in enumerate(signals)])
    out = done.select(*keys, "idx", F.explode(cells).alias("c")).filter("c.gap")
    return out.select(*keys, F.col("c.signal").alias("signal"), "idx", F.col("c.estimate").alias("estimate"))
