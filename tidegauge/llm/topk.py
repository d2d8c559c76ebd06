"""Exact top-k search by inner product, with elimination by a pivot table.

Method: a vector x gets the extra coordinate sqrt(M^2 - |x|^2), with M the largest norm; then the Euclidean distance d
to a query q, whose own extra coordinate is 0, satisfies d^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors are those of the highest inner product. The
pivot table holds d(x, p) for every vector and many pivots p; |d(q, p) - d(x, p)| is a lower bound of d(q, x) for each
p, so the largest of them gives an upper bound of the score. Candidates are evaluated in the order of that bound until
the bound falls below the k-th score found, which proves the rest away.

On Spark: vectors belong to the cell of their two nearest pivots; small cells share a group, large ones are split by a
hash. The bounds of all groups are a table of at most PIVOTS^2 rows, the only thing that is broadcast. Round 1 searches
one block per query and gives a k-th score that holds; round 2 sends each query only to blocks whose bound reaches it.
A block meets queries in tiles, so a task holds at most about BLOCK vectors and TILE queries at a time, and a vector
that a third of all rows repeat is dealt over as many blocks as its rows need.

Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part; shorter vectors
count as padded with zeros; repeated rows are candidates each, but never of a query with their own id, and a repeated
query id is one query (its smallest vector); scores beyond the range of a long are cut to it; ties go to the smaller
id; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut

PIVOTS = 24  # rows of the pivot table
PIVOT_SAMPLE = 1024  # rows, chosen by hash, that pivots are picked from
BLOCK, TILE = 4096, 1024  # vectors and queries that a task compares at a time
ASKED = 200_000  # most pairs of a block and a tile that are broadcast


def quantised(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """id long, v array<bigint>: floor(scale * x) of the rows that take part."""
    x = F.col(column)
    good = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width) if width else out
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def lift(v: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, and the extra coordinate."""
    x = v.astype(np.float64)
    return x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))


def pivot_table(v: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of the vectors (rows) to the pivots, all with their extra coordinate."""
    x, e = lift(v, top)
    p, f = lift(pivots, top)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T + (e[:, None] - f[None, :]) ** 2
    return np.sqrt(np.maximum(0.0, square))


def query_table(q: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of queries (rows), whose extra coordinate is 0, to the pivots with theirs."""
    x = q.astype(np.float64)
    p, f = lift(pivots, top)
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + ((p * p).sum(1) + f * f)[None, :] - 2 * x @ p.T))


def score_bound(norm: float, top: float, low: np.ndarray, width: int) -> np.ndarray:
    """No score of a query with this squared norm is higher, for vectors at a distance of `low` at least."""
    # Squares of distances are off by a few roundings of norm + top each; the distances, by the root of that.
    off = 1e-15 * (width + 8) * (norm + top)
    low = np.maximum(0.0, low - 2 * math.sqrt(off))
    return np.maximum((norm + top - low * low) / 2 + 1 + off + 1e-9 * (norm + top), -2.0 ** 63)  # scores are cut there


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of one query with rows, cut to the range of a long."""
    if not len(q) or not len(x):
        return np.zeros(len(x), np.int64)
    a, b = float(np.abs(q.astype(np.float64)).max()), float(np.abs(x.astype(np.float64)).max())
    if a * b * len(q) < 2.0 ** 52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = [sum(int(s) * int(t) for s, t in zip(q, row)) for row in x]
    return np.array([min(max(e, -2 ** 63), 2 ** 63 - 1) for e in exact], np.int64)


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those picked."""
    if not len(sample):
        return sample
    x, picked = sample.astype(np.float64), [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def search_block(ids, v, table, qids, qv, q_table, floor, top, k):
    """The k best of the block for every query as (query, id, score); floor: a score that the k-th reaches at least."""
    out = []
    x_order_table = table.astype(np.float64)
    for j in range(len(qids)):
        norm = float((qv[j].astype(np.float64) ** 2).sum())
        bound = score_bound(norm, top, np.abs(x_order_table - q_table[j]).max(axis=1), qv.shape[1])
        if k < len(bound):  # the best bounds first; the rest is sorted only if they don't prove it away
            order = np.argsort(-bound, kind="stable")
        else:
            order = np.arange(len(bound))
        got_id, got = np.empty(0, np.int64), np.empty(0, np.int64)
        least, at, step = floor[j], 0, max(64, 4 * k)
        while at < len(order) and bound[order[at]] >= least:
            pick = order[at:at + step]
            at, step = at + step, 2 * step
            pick = pick[ids[pick] != qids[j]]
            got_id = np.concatenate([got_id, ids[pick]])
            got = np.concatenate([got, products(qv[j], v[pick])])
            best = np.lexsort((got_id, -got.astype(object) if len(got) and got.min() == -2 ** 63 else -got))[:k]
            got_id, got = got_id[best], got[best]
            if len(got) == k:
                least = max(least, int(got[-1]))
        if len(got):
            out.append((np.full(len(got), qids[j]), got_id, got))
    if not out:
        return [np.empty(0, np.int64)] * 3
    return [np.concatenate(c) for c in zip(*out)]


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", column: str = "embedding", scale: int = 1024,
          pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of every query with all rows but its own.

    is_query: a condition on the column `id` that selects the queries among the rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, key, column, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    facts = rows.agg(F.max(norm).alias("top"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"]:
        return empty
    top, width = float(facts["top"]) * (1 + 1e-12), int(facts["width"])
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    anchors = pick_pivots(np.array([r["v"] + [0] * (width - len(r["v"])) for r in picked], np.int64).reshape(len(picked), width), pivots)
    count = len(anchors)

    def tabled(batches):
        for b in batches:
            table = pivot_table(matrix(b.column("v"), width), anchors, top)
            near = np.argsort(table, axis=1, kind="stable")[:, :2]
            cell = near[:, 0] * count + near[:, -1]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)),
                 pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), count).cast(pa.list_(pa.float64()))], names=["id", "v", "cell", "dist"])

    base = rows.mapInArrow(tabled, "id long, v array<bigint>, cell int, dist array<double>")
    lows = [F.min(F.col("dist")[i]) for i in range(count)]
    highs = [F.max(F.col("dist")[i]) for i in range(count)]
    cells = base.groupBy("cell").agg(F.count("*").alias("n"), F.array(*lows).alias("lo"), F.array(*highs).alias("hi")).collect()  # pivots^2 rows at most
    # Cells in order of their first pivot are packed into groups of about a block; larger ones are split by a hash.
    group_of, lo, hi, sizes = {}, [], [], []
    for c in sorted(cells, key=lambda c: c["cell"]):
        if not sizes or sizes[-1] + c["n"] > block:
            lo.append(np.array(c["lo"]))
            hi.append(np.array(c["hi"]))
            sizes.append(0)
        lo[-1], hi[-1] = np.minimum(lo[-1], c["lo"]), np.maximum(hi[-1], c["hi"])
        sizes[-1] += c["n"]
        group_of[c["cell"]] = len(sizes) - 1
    lo, hi, splits = np.array(lo), np.array(hi), np.array([math.ceil(n / block) for n in sizes])
    place = np.zeros(count * count, np.int64)
    for c, g in group_of.items():
        place[c] = g

    def placed(batches):
        """grp of every row by its cell."""
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place[b.column("cell").to_numpy()])], names=[*b.schema.names, "grp"])

    split = F.element_at(F.array(*[F.lit(int(s)) for s in splits]), (F.col("grp") + 1).cast("int"))
    base = base.mapInArrow(placed, "id long, v array<bigint>, cell int, dist array<double>, grp long")
    base = base.withColumn("part", F.pmod(F.xxhash64("id", "v"), split)).drop("cell")

    def as_queries(batches):
        """dist of every query, by its extra coordinate of 0 instead of a vector's."""
        for b in batches:
            table = query_table(matrix(b.column("v"), width), anchors, top)
            dist = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), count).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), dist, b.column("grp"), b.column("part")], names=["id", "v", "dist", "grp", "part"])

    queries = base.filter(is_query).groupBy("id").agg(F.min(F.struct("v", "grp", "part")).alias("r")).select("id", "r.*")
    queries = queries.mapInArrow(as_queries, "id long, v array<bigint>, dist array<double>, grp long, part long")
    queries = cut(queries.withColumn("tile_hash", F.xxhash64("id")))
    tiles = max(1, math.ceil(queries.count() / TILE))
    tile = F.pmod("tile_hash", F.lit(tiles)).cast("int").alias("tile")

    def search(sent: DataFrame, many: bool) -> DataFrame:
        """The best of each block for the queries sent to it: id, v, dist, floor, grp, part, tile.

        A block is copied to those tiles only whose queries ask for it.
        """
        blocks = base.select("grp", "part", "id", "v", "dist")
        if many:
            asked = sent.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.col("tile").alias("t")).distinct()
            asked = asked.select(F.col("g").alias("grp"), F.col("p").alias("part"), F.col("t").alias("tile"))
            blocks = blocks.join(F.broadcast(asked) if int(splits.sum()) * tiles <= ASKED else asked, ["grp", "part"])
        else:
            blocks = blocks.withColumn("tile", F.lit(0))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            cols = [np.empty(0, np.int64)] * 3
            if left.num_rows and right.num_rows:
                arrays = [(t.column("id").to_numpy(), matrix(t.column("v").combine_chunks(), width),
                           t.column("dist").combine_chunks().flatten().to_numpy().reshape(-1, count)) for t in (left, right)]
                cols = search_block(*arrays[0], *arrays[1], right.column("floor").to_numpy(), top, k)
            return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

        on = ["grp", "part", "tile"]
        return blocks.groupBy(*on).cogroup(sent.select(*on, "id", "v", "dist", "floor").groupBy(*on)).applyInArrow(
            run, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        from pyspark.sql import Window
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    nothing = -2 ** 63
    # First each query's own block, which needs no tiles: it holds no more queries than rows.
    first = best(search(queries.withColumn("floor", F.lit(nothing).cast("long")).withColumn("tile", F.lit(0)), False))
    kth = first.groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("score"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.col("have") >= k, F.col("score")).otherwise(nothing).cast("long").alias("floor"))

    def routed(batches):
        """One row per query and block that can hold a score of at least floor."""
        for b in batches:
            qv, dist, floor = matrix(b.column("v"), width), b.column("dist").flatten().to_numpy().reshape(-1, count), b.column("floor").to_numpy()
            row, grp, part = [], [], []
            for j in range(len(qv)):
                norm = float((qv[j].astype(np.float64) ** 2).sum())
                low = np.maximum(0.0, np.maximum(lo - dist[j], dist[j] - hi).max(axis=1))
                for g in np.flatnonzero(score_bound(norm, top, low, width) >= floor[j]):
                    row.extend([j] * splits[g])
                    grp.extend([g] * splits[g])
                    part.extend(range(splits[g]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(at) for c in ("id", "v", "dist", "floor", "tile")], pa.array(grp, pa.int64()), pa.array(part, pa.int64())],
                names=["id", "v", "dist", "floor", "tile", "grp", "part"])

    bounded = queries.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(nothing))).withColumn("tile", tile)
    sent = bounded.select("id", "v", "dist", "floor", "tile").mapInArrow(
        routed, "id long, v array<bigint>, dist array<double>, floor long, tile int, grp long, part long")
    return best(search(sent, tiles > 1)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
