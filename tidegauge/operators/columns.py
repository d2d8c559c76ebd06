"""Column roles: time candidates, signals, domain, duplicates, numeric promotion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.domains import DOMAIN_KEYWORDS, ID_PATTERNS, LABEL_COLUMNS, MISSING_TOKENS, SIGNAL_PRIORITY, TIME_PATTERNS
from tidegauge.functions.crossprod import EXPRESSIONS, differing_pairs
from tidegauge.functions.scalar import any_match, isclose

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def column_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(position, name): the columns of a table as rows."""
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


def time_candidates(columns: DataFrame) -> DataFrame:
    """Columns whose name speaks of time."""
    return columns.filter(any_match(F.lower("name"), TIME_PATTERNS))


def likely_time_columns(names: list[str]) -> list[str]:
    return [n for n in names if any(re.search(p, n.lower()) for p in TIME_PATTERNS)]


def missing_to_null(c: Column) -> Column:
    """Trimmed text with the missing tokens turned into NULL."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin(*MISSING_TOKENS), t)


def as_number(c: Column) -> Column:
    """Text to double: blanks dropped, decimal comma, trailing unit letters or % removed."""
    t = F.regexp_replace(missing_to_null(c), "[ \u00a0]", "")
    t = F.regexp_replace(F.translate(t, ",", "."), r"(?<=\d)([a-zA-Z%]+)$", "")
    return t.try_cast("double")


def promotable(df: DataFrame, threshold: float = 0.8) -> dict[str, bool]:
    """Which text columns are numbers: one aggregate over all of them, one small row back."""
    texts = [n for n, k in df.dtypes if k == "string" and re.sub("[^a-z0-9]", "", n.lower()) not in LABEL_COLUMNS]
    if not texts:
        return {}
    row = df.agg(*[F.count(missing_to_null(F.col(f"`{n}`"))).alias(f"n{i}") for i, n in enumerate(texts)],
                 *[F.count(as_number(F.col(f"`{n}`"))).alias(f"c{i}") for i, n in enumerate(texts)]).first()
    return {n: row[f"n{i}"] > 0 and row[f"c{i}"] / row[f"n{i}"] >= threshold for i, n in enumerate(texts)}


def promote(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Numeric text columns as double; identifiers and other text as they are."""
    yes = promotable(df, threshold)
    return df.select(*[as_number(F.col(f"`{n}`")).alias(n) if yes.get(n) else F.col(f"`{n}`") for n in df.columns])


def numeric_signals(df: DataFrame, identifiers_too: bool = False) -> list[str]:
    """Numeric, not named like an identifier or a clock, and not constant."""
    names = [n for n, k in df.dtypes if is_numeric(k)]
    if identifiers_too:
        return names
    names = [n for n in names if not any(re.search(p, n.lower()) for p in (*ID_PATTERNS, *TIME_PATTERNS))]
    if not names:
        return []
    # min < max says the same as two distinct values and needs no distinct.
    row = df.agg(*[(F.min(f"`{n}`") < F.max(f"`{n}`")).alias(f"v{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[f"v{i}"]]


def domain_scores(columns: DataFrame, signals: list[str]) -> DataFrame:
    """Keyword hits per domain; a selected signal counts twice, no hit at all means eye tracking."""
    text = F.lower(F.concat(F.lit(" "), F.col("name")))
    weight = F.when(F.col("name").isin(*signals), 2).otherwise(1) if signals else F.lit(1)
    hits = columns.select(weight.alias("w"), text.alias("x"))
    order = list(DOMAIN_KEYWORDS)
    cols = []
    for d in order:
        per = sum((F.regexp_count("x", F.lit(re.escape(k))) for k in DOMAIN_KEYWORDS[d]), F.lit(0))
        cols.append(F.sum(F.col("w") * per).alias(d))
    row = hits.agg(*cols)
    return row.select(F.posexplode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).cast("long").alias("score")) for d in order])).alias("position", "_s")) \
        .select("position", "_s.domain", "_s.score")


def infer_domain(columns: DataFrame, signals: list[str]) -> DataFrame:
    """One row: the domain with most hits, the first one on ties."""
    s = domain_scores(columns, signals)
    best = s.agg(F.max_by(F.struct("domain", "score"), F.struct("score", -F.col("position"))).alias("b"))
    return best.select(F.when(F.col("b.score") > 0, F.col("b.domain")).otherwise("eye_tracking").alias("domain"), F.col("b.score").alias("score"))


def ranked_signals(columns: DataFrame, domain: str) -> DataFrame:
    """Signals by the first priority word in their name, then by length and name."""
    words = SIGNAL_PRIORITY.get(domain, ())
    low = F.replace(F.lower("name"), F.lit(" "), F.lit("_"))
    place = F.lit(len(words) + 1)
    for i, w in reversed(list(enumerate(words))):
        place = F.when(F.contains(low, F.lit(w)), i).otherwise(place)
    return columns.select("name", place.alias("priority"), F.length("name").alias("length"), low.alias("low")).orderBy("priority", "length", "low")


def duplicate_flags(df: DataFrame, names: list[str]) -> dict[tuple[str, str], bool]:
    """Which signals are equal in every row, for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    if not pairs:
        return {}
    if len(names) > EXPRESSIONS:
        same = dict.fromkeys(pairs, False)
        same.update({(names[r["a"]], names[r["b"]]): not r["differ"] for r in differing_pairs(df, names).collect()})  # a row per pair of columns
        return same
    row = df.agg(*[F.bool_and(isclose(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)]).first()
    return {p: bool(row[f"p{i}"]) for i, p in enumerate(pairs)}


def duplicate_groups(df: DataFrame, names: list[str]) -> list[list[str]]:
    """Groups of equal signals; each signal joins the first it equals."""
    same = duplicate_flags(df, names)
    groups, used = [], set()
    for i, a in enumerate(names):
        if a in used:
            continue
        group = [a] + [b for b in names[i + 1:] if b not in used and same[(a, b)]]
        if len(group) > 1:
            groups.append(group)
            used.update(group)
    return groups


def default_signals(df: DataFrame, names: list[str], most: int = 5) -> list[str]:
    """The first signals that do not repeat an earlier one."""
    same = duplicate_flags(df, names)
    chosen: list[str] = []
    for n in names:
        if len(chosen) < most and not any(same[(c, n)] for c in chosen):
            chosen.append(n)
    return chosen


def duplicate_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, same) as a table."""
    if len(names) > EXPRESSIONS:
        of = F.array(*[F.lit(n) for n in names])
        return differing_pairs(df, names).select(F.element_at(of, F.col("a") + 1).alias("a"), F.element_at(of, F.col("b") + 1).alias("b"), (~F.col("differ")).alias("same"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    agg = df.agg(*[F.bool_and(isclose(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("same")) for i, (a, b) in enumerate(pairs)])))


def signal_table(df: DataFrame) -> DataFrame:
    """(name, varies, signal) of every numeric column, from one aggregate pass."""
    names = [n for n, k in df.dtypes if is_numeric(k)]
    agg = df.agg(*[F.coalesce(F.min(f"`{n}`") < F.max(f"`{n}`"), F.lit(False)).alias(f"v{i}") for i, n in enumerate(names)])
    rows = agg.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"v{i}").alias("varies")) for i, n in enumerate(names)])))
    role = any_match(F.lower("name"), (*ID_PATTERNS, *TIME_PATTERNS))
    return rows.withColumn("signal", F.col("varies") & ~role)
