"""Mixing sources to target weights, with DataFrame and SQL functions only.

Method: multivariate-hypergeometric splitting tree. Each source's documents are permuted by a hash and laid end to end,
up to three times; the first words of that row, as many as the source's target, are cut into blocks. The block quotas of
all sources are split from the root of a tree down to its leaves, the output shards: a node with k shards gives the left
child a share of its blocks, drawn without replacement, so the quotas of a source over the children are multivariate
hypergeometric and add up exactly. Shards then draw disjoint ranges of each source's permuted blocks and order what they
got by a hash. All draws are functions of hashes: reruns agree, whatever the partitions.

Running sums over a source go in two steps, over hash ranges of about RANGE documents and then over the ranges, so a
source with a third of all rows is spread like any other. Only ids, sizes and hashes are shuffled; texts are joined
to their pieces at the end, on the document.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source, last in order;
repeated rows count each and are taken each; null ids are kept; a table without any word has targets of 0; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, cut

BLOCK_WORDS, SHARD_BLOCKS = 4096, 256  # words of a block, blocks of a shard
RANGE = 512  # documents in a hash range of the running sums
MOST = 3  # times that a document, and so a source, may be taken


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, skey (the source, never null), size, h (the document's place in its source's permutation)."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))


def targets(base: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """skey, sid (1.. in order of the source), source_size, target, quota (words), one row per source.

    Weights repeat over the sources in order. A source gets its weight's share of all words, up to `most` times its size;
    the excess goes to the others by weight until none is above. That is min(cap, level * weight) with one level for all,
    found by going through the sources in order of cap / weight.
    """
    src = base.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    src = src.withColumn("sid", F.row_number().over(order))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    src = src.withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = (src.withColumn("words", F.sum("source_size").over(whole) - F.sum("cap").over(whole) + F.sum("cap").over(rest))
           .withColumn("weights", F.sum("weight").over(rest))
           .withColumn("fits", F.col("words") * F.col("weight") <= F.col("cap") * F.col("weights")))
    src = src.withColumn("level", F.first(F.when(F.col("fits"), F.struct("words", "weights")), ignorenulls=True).over(whole))
    target = F.least(F.col("cap").cast("double"), F.col("level.words") * F.col("weight") / F.col("level.weights"))
    return src.select("skey", "sid", "source_size", target.alias("target"), F.least(F.round(target).cast("long"), F.col("cap")).alias("quota"))


def ln_factorial(x: str) -> str:
    """SQL for ln(x!), by Stirling's series at x + 9."""
    y = f"({x} + 9D)"
    steps = " * ".join(f"({x} + {i}D)" for i in range(1, 9))
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) - ln({steps}))"


def hypergeometric(good: str, bad: str, draws: str, u: str) -> str:
    """SQL for the number of good ones among `draws` of good + bad, as the quantile of u in [0, 1).

    The distribution is summed upwards from 12 standard deviations below the mean, which leaves out less than 1e-30.
    """
    f = ln_factorial
    mean = "(c.n * c.g / greatest(c.g + c.b, 1D))"
    spread = f"(12D * sqrt({mean} * c.b / greatest(c.g + c.b, 1D) * (c.g + c.b - c.n) / greatest(c.g + c.b - 1D, 1D)) + 16D)"
    lo, hi = f"greatest(0D, c.n - c.b, floor({mean} - {spread}))", f"least(c.n, c.g, ceil({mean} + {spread}))"
    first = (f"exp({f('c.g')} - {f('d.a')} - {f('(c.g - d.a)')} + {f('c.b')} - {f('(c.n - d.a)')} - {f('(c.b - c.n + d.a)')}"
             f" - {f('(c.g + c.b)')} + {f('c.n')} + {f('(c.g + c.b - c.n)')})")
    step = ("named_struct('p', s.p * (c.g - j) * (c.n - j) / ((j + 1D) * (c.b - c.n + j + 1D)), 'sum', s.sum + s.p, "
            "'x', if(s.x < 0D AND s.sum + s.p > c.u, CAST(j AS DOUBLE), s.x))")
    walk = (f"aggregate(sequence(CAST(d.a AS BIGINT), CAST(d.z AS BIGINT)), named_struct('p', {first}, 'sum', 0D, 'x', -1D), "
            f"(s, j) -> {step}, s -> CAST(if(s.x < 0D, d.z, s.x) AS BIGINT))")
    ends = f"transform(array(named_struct('a', {lo}, 'z', {hi})), d -> {walk})[0]"
    case = f"named_struct('g', CAST({good} AS DOUBLE), 'b', CAST({bad} AS DOUBLE), 'n', CAST({draws} AS DOUBLE), 'u', {u})"
    return f"transform(array({case}), c -> {ends})[0]"


def draw(quotas: str, draws: str, seed: str) -> str:
    """SQL for multivariate-hypergeometric counts of `draws` from an array of quotas, source after source."""
    u = f"(shiftrightunsigned(xxhash64({seed}, size(t.out)), 11) / 9007199254740992D)"
    one = hypergeometric("q", "(t.rest - q)", "t.left", u)
    step = (f"transform(array({one}), x -> named_struct('rest', t.rest - q, 'left', t.left - x, 'out', array_append(t.out, x)))[0]")
    start = f"named_struct('rest', aggregate({quotas}, 0L, (s, q) -> s + q), 'left', {draws}, 'out', CAST(array() AS ARRAY<BIGINT>))"
    return f"aggregate({quotas}, {start}, (t, q) -> {step}, t -> t.out)"


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, quotas of every leaf. quotas: one row with the array of all sources' blocks."""
    nodes = quotas.selectExpr("0 AS shard", f"{shards} AS k", "quotas")
    total = "aggregate(quotas, 0L, (s, q) -> s + q)"
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        half, left = "(k div 2)", draw("quotas", f"({total} * (k div 2) div k)", f"{seed}, shard, k")
        children = (f"transform(array({left}), l -> array(named_struct('shard', shard, 'k', CAST({half} AS INT), 'quotas', l), "
                    f"named_struct('shard', CAST(shard + {half} AS INT), 'k', CAST(k - {half} AS INT), 'quotas', zip_with(quotas, l, (a, b) -> a - b))))[0]")
        nodes = nodes.selectExpr(f"explode(if(k = 1, array(named_struct('shard', shard, 'k', k, 'quotas', quotas)), {children})) AS node").select("node.*")
    return nodes.select("shard", "quotas")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 42, block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The pieces of the mix: doc_id, h, nr (together one row of docs), source, size, source_size, target, and
    epoch, block, shard, place (order in the shard), from_word, words; the last six null where nothing is taken.
    """
    base = cut(sizes(docs, seed))
    src = cut(targets(base, weights, most))
    facts = src.agg(F.sum(F.ceil(F.col("quota") / block_words)).alias("blocks")).first()
    shards = max(1, math.ceil((facts["blocks"] or 0) / shard_blocks))
    bits = max(1, math.ceil(math.log2(max(1, base.count() / RANGE))) if base.count() > RANGE else 1)
    placed = base.withColumn("g", F.shiftrightunsigned("h", 64 - bits))
    inside = Window.partitionBy("skey", "g").orderBy("h", "doc_id", "size")
    placed = placed.withColumn("nr", F.row_number().over(inside)).withColumn(
        "end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranges = base.groupBy("skey", F.shiftrightunsigned("h", 64 - bits).alias("g")).agg(F.sum("size").alias("size"))
    ranges = ranges.withColumn("before", F.sum("size").over(Window.partitionBy("skey").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    ranges = ranges.drop("size").join(src, "skey")
    rows = placed.join(ranges, ["skey", "g"]).withColumn("start", F.col("before") + F.col("end") - F.col("size"))
    # The epochs in which the document lies among the first `quota` words of its source's row, and the blocks it touches.
    epochs = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.struct(
        e.alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at"),
        F.least(F.col("quota"), F.col("start") + e * F.col("source_size") + F.col("size")).alias("to")))
    taken = F.filter(epochs, lambda x: x["at"] < x["to"])
    cuts = F.flatten(F.transform(taken, lambda x: F.transform(
        F.sequence(F.floor(x["at"] / block_words), F.floor((x["to"] - 1) / block_words)), lambda b: F.struct(
            x["epoch"].alias("epoch"), b.alias("block"),
            (F.greatest(x["at"], b * block_words) - x["at"]).alias("from_word"),
            (F.least(x["to"], (b + 1) * block_words) - F.greatest(x["at"], b * block_words)).alias("words")))))
    pieces = rows.select("doc_id", "h", "g", "nr", "source", "size", "source_size", "target", "sid", F.explode_outer(cuts).alias("p"))
    pieces = pieces.select("*", "p.*").drop("p")
    quotas = src.agg(F.sort_array(F.collect_list(F.struct("sid", F.ceil(F.col("quota") / block_words).cast("long").alias("q")))).alias("a"))
    leaves = split_tree(quotas.select(F.expr("transform(a, x -> x.q)").alias("quotas")), shards, seed)
    leaves = leaves.select("shard", F.posexplode("quotas").alias("sid", "q"))
    upto = F.sum("q").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = leaves.withColumn("upto", upto).filter("q > 0").select(
        (F.col("sid") + 1).alias("sid"), "shard", F.explode(F.sequence(F.col("upto") - F.col("q"), F.col("upto") - 1)).alias("block"))
    out = pieces.join(blocks, ["sid", "block"], "left")
    place = F.row_number().over(Window.partitionBy("shard", F.when(F.col("shard").isNull(), F.col("h"))).orderBy(
        F.xxhash64(F.lit(seed), "shard", "h", "nr", "epoch", "block"), "h", "nr", "epoch", "block"))
    out = out.withColumn("place", F.when(F.col("shard").isNotNull(), place))
    return out.select("doc_id", "h", "nr", "source", "size", "source_size", "target", "epoch", "block", "shard", "place", "from_word", "words")


def taken(pieces: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of the mixed table."""
    return pieces.groupBy("doc_id", "h", "nr", "source", "size", "source_size", "target").agg(
        F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken")).drop("h", "nr")


def piece_texts(pieces: DataFrame, docs: DataFrame, seed: int = 42) -> DataFrame:
    """The taken pieces with their text: the whole text, or the words of a part joined by one space."""
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    whole = docs.select(F.col("doc_id").alias("_id"), "text", h.alias("_h")).dropDuplicates(["_id", "_h"])
    some = pieces.filter("shard is not null").join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("from_word") + 1).cast("int"), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part)
    return some.withColumn("piece", text).drop("text", "_id", "_h").withColumnRenamed("piece", "text")
