"""Cross products of many columns: one mergeable aggregate in place of an expression per pair of columns.

A task turns its rows into matrices and keeps, per group, the counts, sums and products of all pairs of columns over the
rows where both are known. They leave it once per group and pair, as count, means and centred moments, and merge by the
usual update of moments, so neither large values nor many tasks cost digits. Plan and code stay as small for 200 columns
as for 2; what a task holds is bounded by MOST_CELLS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CELLS = 4_000_000  # numbers that a task keeps before it sends them
EXPRESSIONS = 8  # up to so many columns an expression per pair is as good


class Moments:
    """Sums of one group over pairs of columns, taken from the column's first known value on."""

    def __init__(self, k: int):
        self.first = np.full(k, np.nan)
        self.n, self.s, self.q, self.p = (np.zeros((k, k)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        known = ~np.isnan(x)
        row = known.argmax(axis=0)
        now = np.where(known.any(axis=0), x[row, np.arange(x.shape[1])], np.nan)
        self.first = np.where(np.isnan(self.first), now, self.first)
        d, w = np.where(known, x - self.first, 0.0), known.astype(float)
        self.n += w.T @ w
        self.s += d.T @ w  # of the row's column, where the other one is known
        self.q += (d * d).T @ w
        self.p += d.T @ d

    def rows(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """n, means, centred squares and centred product of the pairs."""
        n = self.n[a, b]
        some = np.maximum(n, 1)
        sa, sb = self.s[a, b], self.s[b, a]
        return [n, self.first[a] + sa / some, self.first[b] + sb / some, np.maximum(0.0, self.q[a, b] - sa * sa / some),
                np.maximum(0.0, self.q[b, a] - sb * sb / some), self.p[a, b] - sa * sb / some]


FIELDS = ("n", "ma", "mb", "qa", "qb", "c")


def pair_moments(wide: DataFrame, columns: list[str], keys) -> DataFrame:
    """keys, a, b (places of the columns, a <= b), n, ma, mb, qa, qb, c: of every pair with a common row, and every column with itself."""
    k, keys = len(columns), list(keys)
    a, b = np.triu_indices(k)
    kinds = [wide.schema[c] for c in keys]
    schema = T.StructType([*kinds, T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in FIELDS)])

    def run(batches):
        held: dict[tuple, Moments] = {}

        def sent():
            for key, m in held.items():
                cols = m.rows(a, b)
                some = cols[0] > 0
                named = [pa.array([v] * int(some.sum()), f) for v, f in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(a[some].astype(np.int32)), pa.array(b[some].astype(np.int32)), *(pa.array(c[some]) for c in cols)],
                                                 names=[*keys, "a", "b", *FIELDS])
            held.clear()

        types = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in keys]
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
            names = list(zip(*(batch.column(c).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            codes: dict[tuple, int] = {}
            group = np.array([codes.setdefault(n, len(codes)) for n in names])
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(len(codes) + 1))
            for name, g in codes.items():
                held.setdefault(name, Moments(k)).add(x[order[edges[g]:edges[g + 1]]])
                if len(held) * 4 * k * k > MOST_CELLS:
                    yield from sent()
        yield from sent()

    packed = wide.select(*keys, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("_x"))
    parts = packed.mapInArrow(run, schema)
    lists = parts.groupBy(*keys, "a", "b").agg(F.collect_list(F.struct(*FIELDS)).alias("_m"))  # one entry per task that met the group
    start = F.struct(*[F.lit(0.0).alias(c) for c in FIELDS])

    def merge(s: Column, x: Column) -> Column:
        n = s["n"] + x["n"]
        da, db, share = x["ma"] - s["ma"], x["mb"] - s["mb"], s["n"] * x["n"] / n
        # A share of exactly 1 at the first entry keeps the mean of a constant column what it is.
        return F.struct(n.alias("n"), (s["ma"] + da * (x["n"] / n)).alias("ma"), (s["mb"] + db * (x["n"] / n)).alias("mb"),
                        (s["qa"] + x["qa"] + da * da * share).alias("qa"), (s["qb"] + x["qb"] + db * db * share).alias("qb"), (s["c"] + x["c"] + da * db * share).alias("c"))

    return lists.select(*keys, "a", "b", F.aggregate("_m", start, merge).alias("_s")).select(*keys, "a", "b", "_s.*")


def correlation(qa: str = "qa", qb: str = "qb", c: str = "c") -> Column:
    return F.when((F.col(qa) > 0) & (F.col(qb) > 0), F.col(c) / F.sqrt(F.col(qa)) / F.sqrt(F.col(qb)))


def differing_pairs(df: DataFrame, columns: list[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """a, b (places, a < b), differ: of every pair of columns, whether any row isn't close; two missing values are."""
    k = len(columns)
    a, b = np.triu_indices(k, 1)

    def run(batches):
        differ, rows = np.zeros((k, k), bool), 0
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
            gone, rows = np.isnan(x), rows + len(x)
            for i in range(k):
                with np.errstate(invalid="ignore"):
                    near = (np.abs(x[:, i:i + 1] - x) <= atol + rtol * np.abs(x)) | (gone[:, i:i + 1] & gone)
                differ[i] |= ~near.all(axis=0)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(differ[a, b])], names=["a", "b", "differ"])

    packed = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("_x"))
    return packed.mapInArrow(run, "a int, b int, differ boolean").groupBy("a", "b").agg(F.bool_or("differ").alias("differ"))
