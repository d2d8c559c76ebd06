"""Isolation forest over the rows of each recording."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.series import Series
from tidegauge.operators.profile import fill_columns
from tidegauge.settings import small

TREES = 150
SAMPLE = 256
MIN_ROWS = 16
CHUNK = 4096
CELLS = 1_000_000  # values times trees of the recordings of one signal that are scored together
# Forests are replicated once per this many chunks of a long recording.
SPREAD = 256
BROADCAST_FORESTS = 100


def average_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def _random(seed: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers from 64-bit keys; the same key gives the same number anywhere."""
    with np.errstate(over="ignore"):
        z = seed + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / 2.0 ** 53


def grow(samples: list[np.ndarray], keys: np.ndarray, limit: int) -> np.ndarray:
    """Many trees at once, level by level, as an array (tree, node, 3).

    Nodes are numbered like a heap from 1; the three numbers are the split
    signal (-1 in a leaf), the cut, and the path length of a leaf.
    """
    trees, size = len(samples), 2 ** (limit + 1)
    out = np.full((trees, size, 3), [-1.0, 0.0, 0.0])
    # Samples lie node after node, a row per signal; children take their parent's place.
    x = np.ascontiguousarray(np.concatenate(samples).T)
    count = np.array([len(v) for v in samples], dtype=np.int64)
    t = np.flatnonzero(count)
    n, count = np.ones(len(t), dtype=np.int64), count[t]
    for depth in range(limit + 1):
        start = np.cumsum(count) - count
        low, high = np.minimum.reduceat(x, start, axis=1), np.maximum.reduceat(x, start, axis=1)
        spread = high > low
        splits = spread.any(axis=0) & (count > 1) & (depth < limit)
        out[t, n, 2] = np.where(splits, 0.0, depth + average_path(count))
        if not splits.any():
            break
        if not splits.all():
            x = x.take(np.flatnonzero(np.repeat(splits, count)), axis=1)
            t, n, count, spread, low, high = t[splits], n[splits], count[splits], spread[:, splits], low[:, splits], high[:, splits]
            start = np.cumsum(count) - count
        key = keys[t] + n.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        # A uniform draw among the signals that vary in the node.
        draw = np.floor(_random(key, 1) * spread.sum(axis=0)).astype(int)
        f = np.argmax(np.cumsum(spread, axis=0) > draw, axis=0)
        node, at = np.arange(len(count)), np.arange(x.shape[1])
        lo, hi = low[f, node], high[f, node]
        cut = lo + _random(key, 2) * (hi - lo)
        cut = np.where(cut >= hi, lo, cut)
        out[t, n, 0], out[t, n, 1] = f, cut
        which = np.repeat(node, count)
        right = x.ravel().take((f * x.shape[1]).take(which) + at) > cut.take(which)
        after = np.cumsum(right, dtype=np.int32)
        rights = np.diff(after.take(start + count - 1), prepend=0)
        # In each node what goes left, then what goes right.
        before = after - rights.cumsum().take(which) + rights.take(which)
        place = np.where(right, (start + count - rights - 1).take(which) + before, at - before)
        order = np.empty_like(at)
        order[place] = at
        x = x.take(order, axis=1)
        count = np.stack([count - rights, rights], axis=1).ravel()
        t, n = np.repeat(t, 2), np.stack([2 * n, 2 * n + 1], axis=1).ravel()
        if not count.all():
            t, n, count = t[count > 0], n[count > 0], count[count > 0]
    return out


def tree_keys(name: str) -> np.ndarray:
    """The 64-bit key of every tree of a recording's forest."""
    return np.array([int(hashlib.md5(f"{name}:{tree}".encode()).hexdigest()[:16], 16) for tree in range(TREES)], dtype=np.uint64)


def picked(key: np.uint64 | np.ndarray, n: int) -> np.ndarray:
    """Rows that a tree is grown on: all, or one of each of SAMPLE equal stretches; of several keys, a row per tree."""
    key = np.asarray(key, np.uint64)
    if n <= SAMPLE:
        return np.broadcast_to(np.arange(n), (*key.shape, n))
    j = np.arange(SAMPLE, dtype=np.uint64)
    with np.errstate(over="ignore"):
        move = _random(key[..., None] + j * np.uint64(0x2545F4914F6CDD1D), 3)
    return np.minimum(np.floor((j + move) * (n / SAMPLE)).astype(np.int64), n - 1)


def depth_limit(rows: int) -> int:
    return int(np.ceil(np.log2(max(rows, 2))))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _pick_udf(name: pd.Series, n: pd.Series) -> pd.Series:
    """Per tree, the rows that it is grown on."""
    return pd.Series([[picked(k, int(size)).tolist() for k in tree_keys(x)] for x, size in zip(name, n)])


def _tree_udf(width: int):
    """A tree as one flat list: its number of nodes, then three numbers per node."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def build(rows: pd.Series, name: pd.Series, tree: pd.Series) -> pd.Series:
        samples = [np.asarray(r, dtype=float).reshape(-1, width) for r in rows]
        keys = np.array([tree_keys(x)[t] for x, t in zip(name, tree)], dtype=np.uint64)
        limits = np.array([depth_limit(len(x)) for x in samples])
        out: list = [None] * len(samples)
        for limit in np.unique(limits):
            pick = np.flatnonzero(limits == limit)
            nodes = grow([samples[i] for i in pick], keys[pick], int(limit))
            for i, one in zip(pick, nodes):
                out[i] = np.concatenate([[float(len(one))], one.ravel()])
        return pd.Series(out)
    return build


def path_lengths(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees (tree, node, 3)."""
    size = nodes.shape[1]
    f = np.ascontiguousarray(nodes[:, :, 0]).astype(np.int32).ravel()
    cut, length = np.ascontiguousarray(nodes[:, :, 1]).ravel(), np.ascontiguousarray(nodes[:, :, 2]).ravel()
    # A leaf points to itself, so every row takes the same number of steps.
    here = np.arange(len(f), dtype=np.int32)
    first = (here // size) * size
    left = np.where(f >= 0, first + 2 * (here - first), here).astype(np.int32)
    step = (f >= 0).astype(np.int32)
    f = np.maximum(f, 0)
    flat, offset = np.ascontiguousarray(x).ravel(), (np.arange(len(x), dtype=np.int32) * x.shape[1])[:, None]
    at = np.broadcast_to(np.arange(len(nodes), dtype=np.int32) * size + 1, (len(x), len(nodes)))
    for _ in range(int(np.log2(size)) - 1):
        at = left.take(at) + step.take(at) * (flat.take(offset + f.take(at)) > cut.take(at))
    return length.take(at).mean(axis=1)


def anomaly(x: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
    """Scores of the rows x of a recording of n rows."""
    return 2.0 ** (-path_lengths(x, nodes) / max(float(average_path(min(n, SAMPLE))), 1e-12))


def _score_udf(width: int):
    """Scores of a chunk of rows by a flat forest."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(rows: pd.Series, forest: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for r, flat, size in zip(rows, forest, n):
            flat = np.asarray(flat, dtype=float)
            nodes = flat.reshape(TREES, -1)[:, 1:].reshape(TREES, -1, 3)
            out.append(anomaly(np.asarray(r, dtype=float).reshape(-1, width), nodes, int(size)))
        return pd.Series(out)
    return score


def whole_scores(x: np.ndarray, name: str) -> np.ndarray:
    """Scores of the rows x of a whole recording by a forest that is grown, used and forgotten here."""
    keys = tree_keys(name)
    samples = list(x[picked(keys, len(x))])
    nodes = grow(samples, keys, depth_limit(len(samples[0])))
    return np.concatenate([anomaly(x[at:at + CHUNK], nodes, len(x)) for at in range(0, len(x), CHUNK)])


def line_scores(x: np.ndarray, names: list[str]) -> np.ndarray:
    """Scores of whole recordings of one signal, a row of x each: those of `whole_scores`, forest after forest."""
    rows, n = x.shape
    if n > SAMPLE:
        return np.array([whole_scores(v[:, None], name) for v, name in zip(x, names)]).reshape(x.shape)
    many = max(1, CELLS // (TREES * n))
    return np.concatenate([np.empty((0, n)), *[_line_scores(x[at:at + many], names[at:at + many]) for at in range(0, rows, many)]])


def _line_scores(x: np.ndarray, names: list[str]) -> np.ndarray:
    """All trees are grown on all rows, so a node holds neighbours among the sorted values: its first and last place tell all of it."""
    rows, n = x.shape
    order = np.argsort(x, axis=1)
    v = np.take_along_axis(x, order, axis=1)
    flat, keys = v.ravel(), np.concatenate([tree_keys(name) for name in names])
    limit, t, paths = depth_limit(n), np.arange(rows * TREES), average_path(np.arange(n + 1))
    node, begin = np.ones(len(t), np.uint64), t // TREES * n
    end, leaves = begin + n, []
    for depth in range(limit + 1):
        lo, hi, count = flat[begin], flat[end - 1], end - begin
        splits = (hi > lo) & (depth < limit)
        leaves.append([c[~splits] for c in (t * n + begin % n, count, depth + paths[count])])
        if not splits.any():
            break
        t, node, begin, end, lo, hi = (c[splits] for c in (t, node, begin, end, lo, hi))
        cut = lo + _random(keys[t] + node * np.uint64(0xD1342543DE82EF95), 2) * (hi - lo)
        cut = np.where(cut >= hi, lo, cut)
        part = np.searchsorted(t, np.arange(rows + 1) * TREES)
        middle = np.concatenate([np.searchsorted(v[r], cut[a:b], "right") + r * n for r, (a, b) in enumerate(zip(part, part[1:]))])
        two = lambda a, b: np.stack([a, b], axis=1).ravel()
        t, node, begin, end = np.repeat(t, 2), two(2 * node, 2 * node + np.uint64(1)), two(begin, middle), two(middle, end)
    place, count, length = (np.concatenate(c) for c in zip(*leaves))
    by = np.argsort(place)
    each = np.repeat(length[by], count[by]).reshape(rows, TREES, n)
    mean = np.ascontiguousarray(each.transpose(0, 2, 1)).mean(axis=2)
    out = np.empty(x.shape)
    np.put_along_axis(out, order, 2.0 ** (-mean / max(float(average_path(n)), 1e-12)), axis=1)
    return out


def _completed(column: pa.Array, idx: np.ndarray) -> np.ndarray:
    """As `profile.fill_columns`: by row number, an edge takes the nearest value, a column without any is zero."""
    x = column.fill_null(0.0).to_numpy(zero_copy_only=False)
    seen = column.is_valid().to_numpy(zero_copy_only=False)
    if seen.all() or not seen.any():
        return x
    at, gone = np.flatnonzero(seen), np.flatnonzero(~seen)
    after = np.searchsorted(at, gone)
    p, n = at[np.maximum(after - 1, 0)], at[np.minimum(after, len(at) - 1)]
    with np.errstate(all="ignore"):
        inner = (x[n] - x[p]) / (idx[n] - idx[p]) * (idx[gone] - idx[p]) + x[p]
    out = x.copy()
    out[gone] = np.where(after == 0, x[n], np.where(after == len(at), x[p], inner))
    return out


def _scored(keys: list[str], width: int):
    """(keys, idx, score) of the rows of a whole recording, none of one with too few rows."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if rows.num_rows < MIN_ROWS:
            return rows.slice(0, 0).select([*keys, "idx"]).append_column("score", pa.array([], pa.float64()))
        rows = rows.take(pc.sort_indices(rows, [("idx", "ascending")])).combine_chunks()
        idx = rows.column("idx").to_numpy()
        whole = lambda c: pa.concat_arrays(rows.column(c).chunks)
        x = np.stack([_completed(whole(f"_x{i}"), idx) for i in range(width)], axis=1)
        return rows.select([*keys, "idx"]).append_column("score", pa.array(whole_scores(x, rows.column("_name")[0].as_py())))
    return run


def _listed(rows: DataFrame, keys: list[str], x: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("idx", x.alias("x")))).alias("rows"))


def _values() -> Column:
    return F.flatten(F.transform("rows", lambda r: r["x"]))


def forests(rows: DataFrame, keys: list[str], name: Column, signals: list[str]) -> DataFrame:
    """One row per recording: n and 150 trees, each grown on at most 256 of its rows.

    The sampled positions are computed from the length, so no row is shuffled that no tree uses.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.groupBy(*keys).agg((F.max("idx") + 1).alias("n")).withColumn("_name", name)
    pick = size.select(*keys, "n", "_name", F.posexplode(_pick_udf("_name", "n")).alias("tree", "at"))
    pick = pick.select(*keys, "n", "_name", "tree", F.explode("at").alias("idx"))
    x = F.array(*[F.col(c) for c in signals])
    sample = (pick.join(rows.select(*keys, "idx", x.alias("x")), [*keys, "idx"]).groupBy(*keys, "tree", "n", "_name")
              .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda r: r["x"])).alias("rows")))
    # The samples are few bytes but much work: keep them spread over the tasks.
    sample = sample.repartition(tasks, *keys, "tree")
    trees = sample.select(*keys, "n", "tree", _tree_udf(len(signals))("rows", "_name", "tree").alias("nodes"))
    return trees.groupBy(*keys, "n").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("tree", "nodes"))), lambda r: r["nodes"])).alias("forest"))


def row_scores(s: Series, signals: list[str], seed: int = 42) -> DataFrame:
    """(keys, idx, score): 0.5 and below is ordinary.

    A recording of at most CHUNK rows is completed and scored where its forest is grown, in one shuffle; the forest of a
    longer one is sent to its chunks. Both give the same scores.
    """
    keys = list(s.keys)
    x = F.array(*[F.col(c) for c in signals])
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    mixed = s.longest > CHUNK
    # Recordings that are scored as a whole are completed there, with numpy.
    rows = fill_columns(s, signals).stats({"_n": F.count(F.lit(1))}).cut().df if mixed else s.df
    short = (rows.filter(F.col("_n") <= CHUNK) if mixed else rows).select(
        *keys, "idx", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(signals)], name.alias("_name"))
    made = T.StructType([*[s.df.schema[k] for k in keys], T.StructField("idx", s.df.schema["idx"].dataType), T.StructField("score", T.DoubleType())])
    scored = short.groupBy(*keys).applyInArrow(_scored(keys, len(signals)), made)
    if mixed:
        long = rows.filter(F.col("_n") > CHUNK)
        forest = forests(long, keys, name, signals)
        chunks = _listed(long.withColumn("_c", F.floor(F.col("idx") / CHUNK)), [*keys, "_c"], x).drop("n")
        if s.groups <= BROADCAST_FORESTS:
            both = chunks.join(small(forest, s.groups), keys)
        else:
            parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / (CHUNK * SPREAD)))
            both = (chunks.withColumn("_part", F.floor(F.col("_c") / SPREAD))
                    .join(forest.withColumn("_part", F.explode(parts)), [*keys, "_part"]))
        both = both.select(*keys, "rows", _score_udf(len(signals))(_values(), "forest", "n").alias("s"))
        zipped = both.select(*keys, F.explode(F.arrays_zip("rows", "s")).alias("z"))
        scored = scored.unionByName(zipped.select(*keys, F.col("z.rows.idx").alias("idx"), F.col("z.s").alias("score")))
    return scored


def row_flags(s: Series, signals: list[str], seed: int = 42) -> DataFrame:
    """(keys, idx, row_flag); recordings under 16 rows are left out and so never flagged."""
    return row_scores(s, signals, seed).select(*s.keys, "idx", (F.col("score") > 0.5).alias("row_flag"))
