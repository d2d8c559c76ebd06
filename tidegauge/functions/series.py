"""Windows over many series at once, also when one series holds most of the rows.

A ``Series`` is a long table with one row per (keys, idx). When the longest
series fits in one block every primitive is an ordinary window over the keys, so
a chain of them shares one shuffle. When it does not, the same primitives run on
(keys, block): rows are scanned inside their block, one edge row per block is
scanned over the blocks, and the two are joined on (keys, block).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions.quantile import exact_quantiles, interpolated
from tidegauge.settings import BLOCK_ROWS, BROADCAST_ROWS, cut, small

UNB = W.unboundedPreceding
# Quantiles between which a long group is cut when it is numbered.
CUTS = [i / 128 for i in range(1, 128)]
# Copies of each row of a small side, and shares of a hot key, when it cannot be broadcast.
SALTS = 64


def measure(df: DataFrame, keys) -> tuple[int, int]:
    """Rows of the longest group and number of groups; reads the key columns only."""
    return sizes(df, keys)[:2]


def sizes(df: DataFrame, keys) -> tuple[int, int, int]:
    """Rows of the longest group, number of groups and rows in all."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.count(F.lit(1)), F.sum("count")).first()
    return int(row[0] or 0), int(row[1]), int(row[2] or 0)


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...] = ("recording_id", "signal")
    longest: int = 0
    groups: int = 0
    block: int = BLOCK_ROWS

    @staticmethod
    def of(df: DataFrame, keys=("recording_id", "signal"), block: int = BLOCK_ROWS,
           longest: int | None = None, groups: int | None = None) -> "Series":
        if longest is None:
            longest, groups = measure(df, keys)
        return Series(df, tuple(keys), longest, groups, block)

    @property
    def blocked(self) -> bool:
        return self.longest > self.block

    def on(self, df: DataFrame) -> "Series":
        return replace(self, df=df)

    def select(self, *cols) -> "Series":
        return self.on(self.df.select(*self.keys, *cols))

    def with_column(self, name: str, c: Column) -> "Series":
        return self.on(self.df.withColumn(name, c))

    def fan_out(self, name: str, variants: dict[str, dict[str, Column]]) -> "Series":
        """One copy of every series per variant, keyed by the variant's name.

        Each variant gives the columns that differ; the rows stay where they are.
        """
        into = list(next(iter(variants.values())))
        copies = F.array(*[F.struct(F.lit(k).alias("k"), *[v[c].alias(c) for c in into]) for k, v in variants.items()])
        rest = [c for c in self.df.columns if c not in (*into, name)]
        out = self.df.select(*rest, F.explode(copies).alias("_f"))
        out = out.select(*rest, F.col("_f.k").alias(name), *[F.col("_f." + c).alias(c) for c in into])
        return replace(self, df=out, keys=(*self.keys, name), groups=self.groups * len(variants))

    def cut(self) -> "Series":
        return self.on(cut(self.df))

    # -- ordered primitives -------------------------------------------------
    def scan(self, last=None, first=None, lag=None, lead=None, total=None) -> "Series":
        """Ordered columns by name.

        last: latest non-null value up to the row; first: next non-null value
        from the row on; lag and lead: value of the neighbouring row; total:
        running sum including the row.
        """
        last, first, lag, lead, total = (x or {} for x in (last, first, lag, lead, total))
        if not self.blocked:
            fwd = W.partitionBy(*self.keys).orderBy("idx")
            bwd = W.partitionBy(*self.keys).orderBy(F.desc("idx"))
            cols = [F.last(c, True).over(fwd.rowsBetween(UNB, 0)).alias(n) for n, c in last.items()]
            cols += [F.lag(c).over(fwd).alias(n) for n, c in lag.items()]
            cols += [F.lead(c).over(fwd).alias(n) for n, c in lead.items()]
            cols += [F.sum(c).over(fwd.rowsBetween(UNB, 0)).alias(n) for n, c in total.items()]
            cols += [F.last(c, True).over(bwd.rowsBetween(UNB, 0)).alias(n) for n, c in first.items()]
            return self.on(self.df.select("*", *cols))
        return self._scan_blocks(last, first, lag, lead, total)

    def _scan_blocks(self, last, first, lag, lead, total) -> "Series":
        df = cut(self.df.withColumn("_blk", F.floor(F.col("idx") / self.block)))
        part = (*self.keys, "_blk")
        fwd, bwd = W.partitionBy(*part).orderBy("idx"), W.partitionBy(*part).orderBy(F.desc("idx"))
        at = lambda c: F.struct(F.col("idx"), c.alias("v"))
        edge = [F.max(F.when(c.isNotNull(), at(c))).alias(n) for n, c in last.items()]
        edge += [F.min(F.when(c.isNotNull(), at(c))).alias(n) for n, c in first.items()]
        edge += [F.max_by(F.struct(c.alias("v")), "idx").alias(n) for n, c in lag.items()]
        edge += [F.min_by(F.struct(c.alias("v")), "idx").alias(n) for n, c in lead.items()]
        edge += [F.sum(c).alias(n) for n, c in total.items()]
        over, back = W.partitionBy(*self.keys).orderBy("_blk"), W.partitionBy(*self.keys).orderBy(F.desc("_blk"))
        before, after = over.rowsBetween(UNB, -1), back.rowsBetween(UNB, -1)
        edges = df.groupBy(*part).agg(*edge).select(
            *part,
            *[F.last(n, True).over(before).alias("_e_" + n) for n in last],
            *[F.last(n, True).over(after).alias("_e_" + n) for n in first],
            *[F.lag(n).over(over).alias("_e_" + n) for n in lag],
            *[F.lead(n).over(over).alias("_e_" + n) for n in lead],
            *[F.sum(n).over(before).alias("_e_" + n) for n in total])
        inner = df.select(
            "*",
            *[F.last(c, True).over(fwd.rowsBetween(UNB, 0)).alias("_i_" + n) for n, c in last.items()],
            *[F.lag(F.struct(c.alias("v"))).over(fwd).alias("_i_" + n) for n, c in lag.items()],
            *[F.lead(F.struct(c.alias("v"))).over(fwd).alias("_i_" + n) for n, c in lead.items()],
            *[F.sum(c).over(fwd.rowsBetween(UNB, 0)).alias("_i_" + n) for n, c in total.items()],
            *[F.last(c, True).over(bwd.rowsBetween(UNB, 0)).alias("_i_" + n) for n, c in first.items()])
        both = inner.join(edges, list(part))
        i, e = (lambda n: F.col("_i_" + n)), (lambda n: F.col("_e_" + n))
        out = [F.coalesce(i(n), e(n)["v"]).alias(n) for n in [*last, *first]]
        out += [F.coalesce(i(n), e(n))["v"].alias(n) for n in [*lag, *lead]]
        out += [F.when(i(n).isNotNull() | e(n).isNotNull(),
                       F.coalesce(i(n), F.lit(0)) + F.coalesce(e(n), F.lit(0))).alias(n) for n in total]
        keep = [c for c in self.df.columns]
        return self.on(both.select(*keep, *out))

    # -- statistics ---------------------------------------------------------
    def summary(self, aggs: dict[str, Column], quantiles: dict[str, tuple[Column, float]] | None = None) -> DataFrame:
        """One row per series."""
        quantiles = quantiles or {}
        if not self.blocked:
            groups = _by_column(quantiles)
            out = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()], *[_together(g).alias(f"_pc{i}") for i, g in enumerate(groups)])
            return out.select(*self.keys, *aggs, *_apart(groups))
        out = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        for group in _by_column(quantiles):
            q = exact_quantiles(self.df, self.keys, group["column"], group["probs"], self.block,
                                self.groups, BROADCAST_ROWS)
            out = out.join(q, list(self.keys), "left")
        return out

    def stats(self, aggs: dict[str, Column] | None = None,
              quantiles: dict[str, tuple[Column, float]] | None = None) -> "Series":
        """Per-series statistics next to every row."""
        aggs, quantiles = aggs or {}, quantiles or {}
        if not self.blocked:
            whole = W.partitionBy(*self.keys)
            groups = _by_column(quantiles)
            out = self.df.select("*", *[a.over(whole).alias(n) for n, a in aggs.items()],
                                 *[_together(g).over(whole).alias(f"_pc{i}") for i, g in enumerate(groups)])
            out = out.select(*self.df.columns, *aggs, *_apart(groups))
            if not quantiles:
                return self.on(out)
            # The two values around each quantile, and its place between them.
            sides = [F.count(g["column"]).over(whole).alias(f"_nq{i}") for i, g in enumerate(groups)]
            sides += [side.over(whole).alias(name) for n, (c, _) in quantiles.items() for side, name in
                      ((F.max(F.when(c <= F.col(n), c)), "_lq_" + n), (F.min(F.when(c >= F.col(n), c)), "_hq_" + n))]
            out = out.select("*", *sides)
            place = {n: (F.col(f"_nq{i}") - 1) * F.lit(float(p)) for i, g in enumerate(groups) for n, p in g["probs"].items()}
            exact = [interpolated(F.col("_lq_" + n), F.col("_hq_" + n), place[n] - F.floor(place[n])).alias(n) for n in quantiles]
            return self.on(out.select(*self.df.columns, *aggs, *exact))
        base = self.cut()
        side = base.summary({**aggs, "_hi": F.max("idx")}, quantiles)
        return base.attach(side)

    def attach(self, side: DataFrame, rows: int | None = None) -> "Series":
        """Join one row per series onto the rows without gathering a long series.

        A small side is broadcast. A larger one is repeated once per block of the
        series (its column ``_hi`` holds the highest idx), so that the join key
        is (keys, block) and a long series stays spread out.
        """
        rows = self.groups if rows is None else rows
        has_hi = "_hi" in side.columns
        if rows <= BROADCAST_ROWS or not self.blocked or not has_hi:
            return self.on(self.df.join(small(side.drop("_hi"), rows), list(self.keys), "left"))
        spread = side.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.floor(F.col("_hi") / self.block)))).drop("_hi")
        df = self.df.withColumn("_blk", F.floor(F.col("idx") / self.block))
        return self.on(df.join(spread, [*self.keys, "_blk"], "left").drop("_blk"))


def _by_column(quantiles):
    """Quantiles of the same column share one pass."""
    groups: list[dict] = []
    for n, (c, p) in quantiles.items():
        for g in groups:
            if g["text"] == str(c):
                g["probs"][n] = p
                break
        else:
            groups.append({"text": str(c), "column": c, "probs": {n: p}})
    return groups


def _together(group) -> Column:
    return F.percentile(group["column"], F.array(*[F.lit(float(p)) for p in group["probs"].values()]))


def _apart(groups) -> list[Column]:
    return [F.get(f"_pc{i}", F.lit(j)).alias(n) for i, g in enumerate(groups) for j, n in enumerate(g["probs"])]


def _split_ties(base: DataFrame, keys, order, block: int) -> DataFrame:
    """Cut ranges of over two blocks by the first order column that varies in them.

    ``_rng`` gets one more number. A value that fills much of a range gets a range of its own, which the next column
    can cut. Columns that are neither numbers nor dates cut nothing.
    """
    kinds, part = dict(base.dtypes), [*keys, "_rng"]

    def number(c: str) -> Column | None:
        if kinds[c] == "date" or kinds[c].startswith("timestamp"):
            return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        return F.col(c).cast("double") if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal") else None

    for _ in range(3 * len(order)):
        if not base.groupBy(*part).count().filter(F.col("count") > 2 * block).take(1):
            break
        n = F.count(F.lit(1))
        varies = [~F.min(c).eqNullSafe(F.max(c)) | ((F.count(c) > 0) & (F.count(c) < n)) for c in order]
        found = [F.lit(None) if number(c) is None else F.percentile_approx(number(c), CUTS, 10_000) for c in order]
        facts = base.groupBy(*part).agg(n.alias("_n"), *[v.alias(f"_v{i}") for i, v in enumerate(varies)], *[f.alias(f"_c{i}") for i, f in enumerate(found)])
        which, cuts, x = F.lit(None).cast("int"), F.lit(None).cast("array<double>"), F.lit(None).cast("double")
        for i, c in reversed(list(enumerate(order))):
            which, cuts = F.when(F.col(f"_v{i}"), i).otherwise(which), F.when(F.col(f"_v{i}"), F.col(f"_c{i}")).otherwise(cuts)
            if number(c) is not None:
                x = F.when(F.col("_which") == i, number(c)).otherwise(x)
        big = cut(facts.filter(F.col("_n") > 2 * block).select(*part, which.alias("_which"), cuts.alias("_cuts")).filter(F.col("_cuts").isNotNull()))
        ranges = big.count()
        if not ranges:
            break
        place = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_y"))) + F.array_contains("_cuts", F.col("_y")).cast("int")
        base = base.join(small(big, ranges), part, "left").withColumn("_y", x)
        deeper = F.concat("_rng", F.array(F.coalesce(place, F.lit(-1)).cast("long")))
        base = cut(base.withColumn("_rng", F.when(F.col("_which").isNotNull(), deeper).otherwise(F.col("_rng"))).drop("_which", "_cuts", "_y"))
    return base


def ordered_index(df: DataFrame, keys, order, lead: Column, longest: int, groups: int,
                  block: int = BLOCK_ROWS, name: str = "idx") -> DataFrame:
    """Add a column (idx) that counts 0, 1, … in the given order.

    ``lead`` is the leading order column as a number. Long groups are cut into
    ranges of it, numbered inside each range, and shifted by the rows before.
    The ranges follow the group's own distribution: sketched quantiles first,
    equal widths between them, so neither clusters nor long tails gather. Values
    that many rows repeat are cut again by the order columns that follow.
    """
    if longest <= block:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    salts = 1 if groups <= BROADCAST_ROWS else SALTS
    base = cut(df.withColumn("_x", lead.cast("double")).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))))
    span = (base.groupBy(*keys).agg(F.percentile_approx("_x", CUTS, 10_000).alias("_cuts"), F.min("_x").alias("_lo"),
                                    F.max("_x").alias("_up"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > block))
    span = (span.withColumn("_edges", F.concat(F.array("_lo"), "_cuts", F.array("_up"))).drop("_lo", "_up")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    base = base.join(small(span, groups), [*keys, "_salt"], "left")
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    low, high = F.get("_edges", part), F.get("_edges", part + 1)
    fine = F.ceil(F.col("_n") / (block * (len(CUTS) + 1)))
    inner = F.least(fine, F.floor(F.try_divide(F.col("_x") - low, high - low) * fine))
    place = part * (fine + 1) + F.coalesce(inner, F.lit(0))
    base = cut(base.withColumn("_rng", F.array(F.coalesce(place, F.lit(-1)).cast("long"))).drop("_x", "_cuts", "_edges", "_n", "_salt"))
    base = _split_ties(base, keys, order, block)
    before = W.partitionBy(*keys).orderBy("_rng").rowsBetween(UNB, -1)
    start = (base.groupBy(*keys, "_rng").count()
             .select(*keys, "_rng", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")))
    row = F.row_number().over(W.partitionBy(*keys, "_rng").orderBy(*order)).cast("long") - 1
    return (base.withColumn("_row", row).join(start, [*keys, "_rng"])
            .withColumn(name, F.col("_row") + F.col("_start")).drop("_row", "_start", "_rng"))
