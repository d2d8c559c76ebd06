"""Nearest-neighbour estimates across the signals of a recording."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.series import Series
from tidegauge.settings import cut

LEAF = 2048
PARTS = 64
TILE = 256
# Leaves with all their donors that a Python worker gets at a time.
LEAVES = 16


def neighbours_for(n):
    """2 to 7 neighbours, a quarter of the root of the number of rows."""
    root = F.floor(F.sqrt(F.greatest(F.lit(4), n)))
    return F.greatest(F.lit(2), F.least(F.lit(7), F.floor(root / 4)))


def distances(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distance over the common coordinates, scaled up to all; NaN without any."""
    total = np.zeros((len(q), len(d)))
    shared = np.zeros((len(q), len(d)))
    for j in range(q.shape[1]):
        diff = q[:, j, None] - d[None, :, j]
        ok = ~np.isnan(diff)
        total += np.where(ok, diff, 0.0) ** 2
        shared += ok
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(shared > 0, total * q.shape[1] / shared, np.nan)


def twelve_digits(x: np.ndarray) -> np.ndarray:
    """Rounded to twelve significant digits, whatever the scale."""
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = 10.0 ** (11 - np.floor(np.log10(x)))
        return np.where(x > 0, np.round(x * unit) / unit, x)


def nearest(q: np.ndarray, d: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest donors of each query row as (rank distance, donor id, donor value, squared distance).

    Twelve significant digits decide between neighbours, so that sums in another order make no difference; what is
    equal then is broken by row.
    """
    out = []
    for a in range(0, len(q), TILE):
        exact = distances(q[a:a + TILE], d)
        dist = np.where(np.isnan(exact), np.inf, twelve_digits(exact))
        take = min(k, dist.shape[1])
        part = np.argpartition(dist, take - 1, axis=1)[:, :take]
        kth = np.take_along_axis(dist, part, 1).max(axis=1)
        for row, limit, full in zip(dist, kth, exact):
            cand = np.flatnonzero(row <= limit)
            cand = cand[np.lexsort((ids[cand], row[cand]))][:take]
            cand = cand[np.isfinite(row[cand])]
            out.append([(float(row[c]), int(ids[c]), float(y[c]), float(full[c])) for c in cand])
    return out


def weighted(found) -> float:
    """Inverse-distance mean; exact matches, if any, are averaged alone."""
    if not found:
        return np.nan
    dist = np.sqrt(np.array([f[3] for f in found]))
    val = np.array([f[2] for f in found])
    if (dist == 0).any():
        return float(val[dist == 0].mean())
    return float((val / dist).sum() / (1 / dist).sum())


def standardise(s: Series, signals: list[str]) -> Series:
    """Columns z_<signal>: standardised on the observed values (spread 0 counts as 1)."""
    s = s.stats({**{f"_a_{c}": F.avg(c) for c in signals}, **{f"_s_{c}": F.stddev_pop(c) for c in signals},
                 "_n": F.count(F.lit(1))})
    for c in signals:
        width = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        s = s.with_column("z_" + c, (F.col(c) - F.col(f"_a_{c}")) / width)
    return s


FOUND = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("i", T.LongType()),
                                  T.StructField("y", T.DoubleType()), T.StructField("e", T.DoubleType())]))
QUERY_FOUND = T.ArrayType(T.StructType([T.StructField("q", T.LongType()), T.StructField("found", FOUND)]))


def _search_udf():
    @F.pandas_udf(QUERY_FOUND)
    def search(queries: pd.Series, donors: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for qs, ds, kk in zip(queries, donors, k):
            if len(qs) == 0 or len(ds) == 0:
                out.append([])
                continue
            q = np.array([[np.nan if v is None else v for v in r["z"]] for r in qs], dtype=float)
            d = np.array([[np.nan if v is None else v for v in r["z"]] for r in ds], dtype=float)
            y = np.array([r["y"] for r in ds], dtype=float)
            ids = np.array([r["idx"] for r in ds], dtype=np.int64)
            res = nearest(q, d, y, ids, int(kk))
            out.append([{"q": int(r["idx"]), "found": [dict(zip("diye", f)) for f in f3]} for r, f3 in zip(qs, res)])
        return pd.Series(out)
    return search


@F.pandas_udf(T.DoubleType())
def _weighted_udf(found: pd.Series) -> pd.Series:
    return pd.Series([weighted([(f["d"], f["i"], f["y"], f["e"]) for f in row]) if row is not None else np.nan for row in found])


def estimates(s: Series, signals: list[str], scaled: bool = True) -> DataFrame:
    """(recording_id, signal, idx, estimate) for every missing cell of a wide series."""
    s = standardise(s, signals)
    z = F.array(*[F.col(("z_" if scaled else "") + c) for c in signals])
    rows = s.df.select(*s.keys, "idx", z.alias("z"), neighbours_for(F.col("_n")).alias("k"),
                       F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("y"), F.col(f"_a_{c}").alias("mean"))
                                           for c in signals])).alias("c"))
    rows = rows.select(*s.keys, F.col("c.signal").alias("signal"), "idx", "z", "k", F.col("c.y").alias("y"), F.col("c.mean").alias("mean"))
    rows = rows.filter(F.col("mean").isNotNull())  # a channel without any observation has no donors
    keys = [*s.keys, "signal"]
    if s.blocked:
        return _long(s, rows, keys, signals)
    entry = F.struct("idx", "z", "y")
    both = rows.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("y").isNull(), entry)).alias("queries"),
        F.collect_list(F.when(F.col("y").isNotNull(), entry)).alias("donors"),
        F.max("k").alias("k"), F.max("mean").alias("mean")).filter(F.size("queries") > 0)
    hit = both.select(*keys, "mean", F.explode(_search_udf()("queries", "donors", "k")).alias("h"))
    return hit.select(*keys, F.col("h.q").alias("idx"), F.coalesce(_nan_null(_weighted_udf("h.found")), "mean").alias("estimate"))


@contextmanager
def _few_at_a_time(spark, rows: int):
    """What is run inside sends so many rows to Python at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _nan_null(c):
    return F.when(~F.isnan(c), c)


def _leaf_of(x):
    """Number of the range that x falls in; grows with x, and the ends are open."""
    edges, fine = F.col("cuts.edges"), F.col("cuts.fine")
    part = F.size(F.filter(F.slice(edges, 2, PARTS - 1), lambda c: c < x))
    low, high = F.get(edges, part), F.get(edges, part + 1)
    inner = F.coalesce(F.try_divide(x - low, high - low) * fine, F.lit(0.0))
    return (part * fine + F.floor(F.greatest(F.lit(0.0), F.least(fine - F.lit(1.0), inner)))).cast("long")


def _long(s: Series, rows: DataFrame, keys, signals: list[str]) -> DataFrame:
    """Exact search when recordings are long.

    Donors with the same observed signals are cut into value ranges of one
    signal, as many as the donors fill with LEAF each. A query looks into the
    range it falls in first; its k-th distance there bounds how far any better
    donor can lie along that signal, so only the ranges within that bound are
    searched afterwards. Each search meets one bounded leaf of donors and returns
    at most k rows per query.
    """
    width = len(signals)
    pattern = F.array_join(F.transform("z", lambda v: F.when(v.isNull(), "0").otherwise("1")), "")
    rows = cut(rows.withColumn("pat", pattern))
    donors = rows.filter(F.col("y").isNotNull()).drop("mean", "k")
    queries = rows.filter(F.col("y").isNull()).select(*keys, F.col("idx").alias("q"), F.col("z").alias("qz"), F.col("pat").alias("qpat"), "k", "mean")
    # Which donor patterns exist, and the first signal a query shares with each.
    pats = donors.groupBy(*keys, F.col("pat").alias("dpat")).agg(F.count(F.lit(1)).alias("m"), F.max("idx").alias("_hi"))
    both = queries.select(*keys, "qpat").distinct().join(pats, keys)
    axis = F.filter(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.substring("qpat", i, 1) == "1") & (F.substring("dpat", i, 1) == "1"))
    both = both.withColumn("axes", axis).filter(F.size("axes") > 0).withColumn("axis", F.col("axes")[0]).withColumn("shared", F.size("axes")).drop("axes")
    # Leaves: equal widths between quantiles of the axis, holding about LEAF donors each.
    need = both.groupBy(*keys, "dpat").agg(F.collect_set("axis").alias("axes"), F.max("m").alias("m"), F.max("_hi").alias("_hi"))  # at most one per signal
    value = F.element_at("z", F.col("axis"))
    grid = [i / PARTS for i in range(1, PARTS)]
    few = s.groups * width * 2 ** width
    spread = lambda df, by: Series(df, (*keys, by), s.longest, few, s.block)
    placed = spread(donors.withColumnRenamed("pat", "dpat"), "dpat").attach(need).df
    placed = placed.withColumn("axis", F.explode("axes")).drop("axes").withColumn("x", value)
    edges = F.concat(F.array(F.min("x")), F.percentile_approx("x", grid, 10_000), F.array(F.max("x")))
    fine = F.ceil(F.max("m") / (PARTS * LEAF)).cast("long")
    cuts = placed.groupBy(*keys, "dpat", "axis").agg(F.struct(edges.alias("edges"), fine.alias("fine")).alias("cuts"), F.max("idx").alias("_hi"))
    placed = Series(placed, (*keys, "dpat", "axis"), s.longest, few, s.block).attach(cuts).df.withColumn("leaf", _leaf_of(F.col("x")))
    # A leaf may still be large where values repeat; it is split into pages by row.
    where = [*keys, "dpat", "axis", "leaf"]
    large = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 4 * LEAF)
    paged = placed.join(large, where, "left")
    paged = paged.withColumn("page", F.pmod(F.xxhash64("idx"), F.ceil(F.coalesce("_rows", F.lit(1)) / (4 * LEAF))))
    entry = F.struct("idx", "z", "y")
    pages = cut(paged.groupBy(*where, "page").agg(F.collect_list(entry).alias("donors")))
    # A query pattern meets each donor pattern once: at most 2^signals rows per query pattern.
    plans = (both.join(cuts.drop("_hi"), [*keys, "dpat", "axis"]).groupBy(*keys, "qpat")
             .agg(F.collect_list(F.struct("dpat", "axis", "shared", "cuts")).alias("plan")))
    ends = queries.groupBy(*keys, "qpat").agg(F.max("q").alias("_hi"))
    ask = spread(queries.withColumn("idx", F.col("q")), "qpat").attach(plans.join(ends, [*keys, "qpat"])).df
    ask = ask.filter(F.col("plan").isNotNull()).select(*[c for c in ask.columns if c not in ("plan", "idx")], F.inline("plan"))
    ask = cut(ask.withColumn("x", F.element_at("qz", F.col("axis"))).withColumn("home", _leaf_of(F.col("x"))))

    def look(a: DataFrame) -> DataFrame:
        """Top k of each query in the leaves it asks for."""
        tile = F.floor(F.col("q") / (32 * LEAF))
        packed = (a.groupBy(*where, tile.alias("tile"), "k").agg(F.collect_list(F.struct(F.col("q").alias("idx"), F.col("qz").alias("z"))).alias("queries")))
        hit = packed.join(pages, where).select(*keys, "k", F.explode(_search_udf()("queries", "donors", "k")).alias("h"))
        with _few_at_a_time(s.df.sparkSession, LEAVES):
            return cut(hit.select(*keys, F.col("h.q").alias("q"), "k", F.explode("h.found").alias("f")))

    def merge(found: DataFrame) -> DataFrame:
        return found.groupBy(*keys, "q", "k").agg(F.sort_array(F.collect_set("f")).alias("found"))

    def within(a: DataFrame, lo, hi) -> DataFrame:
        return a.withColumn("leaf", F.explode(F.filter(F.sequence(lo, hi), lambda j: j != F.col("home"))))

    found = cut(merge(look(ask.withColumn("leaf", F.col("home")))))
    # Queries that met too few donors at home look around in wider and wider rings.
    most, ring = cuts.agg(F.max("cuts.fine")).first()[0] or 0, 4
    while ring < PARTS * most:
        done = found.filter(F.size("found") >= F.col("k")).select(*keys, "q")
        left = ask.join(done, [*keys, "q"], "left_anti")
        if not left.take(1):
            break
        last = F.col("cuts.fine") * PARTS - 1
        more = look(within(left, F.greatest(F.lit(0).cast("long"), F.col("home") - ring), F.least(last, F.col("home") + ring)))
        found, ring = cut(merge(more.unionByName(found.select(*keys, "q", "k", F.explode("found").alias("f"))))), 4 * ring
    bound = found.select(*keys, "q", F.col("found").alias("near"))
    more = ask.join(bound, [*keys, "q"], "left")
    enough = F.size("near") >= F.col("k")
    # d² >= (width / shared) (x - x')², so a better donor lies within this reach on the axis.
    # The room left covers the ranks' twelve digits and the rounding of x, at any scale.
    reach = F.sqrt(F.element_at("near", F.col("k").cast("int"))["d"] * F.col("shared") / width) * (1 + 1e-9) + 1e-12 * F.abs(F.col("x"))
    more = more.withColumn("reach", F.when(enough, reach).otherwise(F.lit(float("inf"))))
    again = look(within(more, _leaf_of(F.col("x") - F.col("reach")), _leaf_of(F.col("x") + F.col("reach"))).drop("near", "reach"))
    # Only the best k per query leave each search, so the lists stay short; what two searches found is one entry.
    every = merge(again.unionByName(found.select(*keys, "q", "k", F.explode("found").alias("f"))))
    out = queries.join(every.drop("k"), [*keys, "q"], "left")
    best = F.slice("found", 1, F.col("k").cast("int"))
    return out.select(*keys, F.col("q").alias("idx"), F.coalesce(_nan_null(_weighted_udf(best)), "mean").alias("estimate"))
