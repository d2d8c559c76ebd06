"""Bounded, deterministic selections of rows for display and inspection, and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import isclose
from tidegauge.functions.series import Series
from tidegauge.operators.profile import evenly, outside_iqr, outside_mad

MAX_POINTS = 5000


def representative_rows(s: Series, signals: list[str], limit: int | None = None) -> Series:
    """At most 2000 rows of each wide recording, or all of them if they fit.

    Five short windows over the whole length, both ends of the longest gap, the
    most extreme row's surroundings, and evenly spaced others up to the limit.
    """
    limit = limit or min(2000, max(1, 12000 // (len(signals) + 1)))
    width = max(1, min(48, limit // 12))
    keep = list(s.df.columns)
    gap = F.lit(False)
    for c in signals:
        gap = gap | F.col(c).isNull()
    s = s.with_column("_gap", gap)
    s = s.stats({"_n": F.count(F.lit(1)), **{f"_s_{c}": F.stddev_pop(c) for c in signals}}, {f"_m_{c}": (F.col(c), 0.5) for c in signals})
    s = s.stats(quantiles={f"_d_{c}": (F.abs(F.col(c) - F.col(f"_m_{c}")), 0.5) for c in signals})
    far = [F.abs(F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(F.greatest(F.col(f"_s_{c}"), F.lit(1e-12)))
           for c in signals]
    extreme = F.greatest(*far, F.lit(0.0))
    here = F.when(~F.col("_gap"), F.col("idx"))
    s = s.scan(last={"_b": here}, first={"_a": here})
    start = F.coalesce(F.col("_b") + 1, F.lit(0).cast("long"))
    stop = F.coalesce(F.col("_a"), F.col("_n"))
    opens = F.col("_gap") & (F.col("idx") == start)
    s = s.stats({"_long": F.max(F.when(opens, F.struct((stop - start).alias("r"), (-start).alias("s")))),
                 "_far": F.max(F.struct(extreme.alias("e"), (-F.col("idx")).alias("s")))})
    n = F.col("_n")
    centers = [F.floor(i * (n - 1) / 4) for i in range(5)]
    centers += [-F.col("_long")["s"], -F.col("_long")["s"] + F.col("_long")["r"] - 1, -F.col("_far")["s"]]
    picked = F.lit(False)
    for c in centers:
        first = F.greatest(F.lit(0), F.least(n - width, c - width // 2))
        picked = picked | F.coalesce((F.col("idx") >= first) & (F.col("idx") < first + width), F.lit(False))
    s = s.with_column("_in", picked).stats({"_taken": F.sum(F.col("_in").cast("int"))})
    s = s.scan(total={"_free": (~F.col("_in")).cast("int")})
    rest, room = n - F.col("_taken"), F.lit(limit) - F.col("_taken")
    even = ~F.col("_in") & evenly(F.col("_free") - 1, rest, room)
    chosen = (n <= limit) | F.col("_in") | ((room > 0) & F.coalesce(even, F.lit(False)))
    return s.on(s.df.filter(chosen).select(*keep))


def decimate(s: Series, points: int = MAX_POINTS, flagged: bool = False) -> Series:
    """Evenly spaced rows plus both sides of every gap edge, so that no gap disappears.

    With ``flagged`` also every outlier by the quartile or deviation rule and its neighbours.
    """
    keep = list(s.df.columns)
    v = F.col("value")
    s = s.stats({"_n": F.count(F.lit(1)), "_nv": F.count("value")}, {"_q1": (v, 0.25), "_q3": (v, 0.75), "_md": (v, 0.5)} if flagged else {})
    gone = v.isNull()
    hit = F.lit(False)
    if flagged:
        s = s.stats(quantiles={"_mad": (F.abs(v - F.col("_md")), 0.5)})
        hit = F.coalesce((F.col("_nv") >= 4) & (outside_iqr(v, F.col("_q1"), F.col("_q3")) | outside_mad(v, F.col("_md"), F.col("_mad"))), F.lit(False))
    s = s.with_column("_h", hit).with_column("_g", gone)
    pair = F.struct("_g", "_h")
    s = s.scan(lag={"_b": pair}, lead={"_a": pair})
    near = lambda x: (F.col(x)["_g"] != F.col("_g")) | F.col(x)["_h"]
    chosen = (evenly(F.col("idx"), F.col("_n"), points) | F.col("_h") | F.coalesce(near("_b"), F.lit(False)) | F.coalesce(near("_a"), F.lit(False)))
    return s.on(s.df.filter(chosen).select(*keep))


def difference_window(s: Series, columns: list[str], pad: int = 60, width: int = 320) -> DataFrame:
    """(keys, start, stop): where the columns first disagree; no row where they never do."""
    ref = F.col(columns[0])
    differs = F.lit(False)
    for c in columns[1:]:
        differs = differs | ~isclose(ref, F.col(c), 1e-7, 1e-9)
    d = s.summary({"first": F.min(F.when(differs, F.col("idx"))), "n": F.max("idx") + 1}).filter(F.col("first").isNotNull())
    start = F.greatest(F.lit(0), F.col("first") - pad)
    return d.select(*s.keys, start.alias("start"), F.least(F.col("n"), F.greatest(start + width, F.col("first") + pad)).alias("stop"))


def filled_segments(s: Series, before: str, after: str, points: int = MAX_POINTS) -> DataFrame:
    """Imputed stretches: their ends, evenly spaced inner rows and the observed neighbours.

    (keys, segment, idx, t, value): the value before the stage at anchors, after it inside.
    """
    b, a = F.col(before), F.col(after)
    s = s.stats({"_n": F.count(F.lit(1))})
    s = s.with_column("_f", F.coalesce(b.isNull() & a.isNotNull(), F.lit(False)))
    row = F.struct("_f", F.col(before).isNotNull().alias("_o"))
    s = s.scan(lag={"_p": row}, lead={"_q": row})
    s = s.scan(last={"_start": F.when(F.col("_f") & ~F.coalesce(F.col("_p")["_f"], F.lit(False)), F.col("idx"))})
    p, q, f = F.col("_p"), F.col("_q"), F.col("_f")
    opens, closes = f & ~F.coalesce(p["_f"], F.lit(False)), f & ~F.coalesce(q["_f"], F.lit(False))
    even = evenly(F.col("idx"), F.col("_n"), points)
    inside = F.when(f & (opens | closes | even), F.struct(F.col("_start").alias("segment"), a.alias("value")))
    # An observed row right before a stretch belongs to the next segment, right after one to the last.
    left = F.when(b.isNotNull() & F.coalesce(q["_f"], F.lit(False)), F.struct((F.col("idx") + 1).alias("segment"), b.alias("value")))
    right = F.when(b.isNotNull() & F.coalesce(p["_f"], F.lit(False)), F.struct(F.col("_start").alias("segment"), b.alias("value")))
    return s.df.select(*s.keys, "idx", "t", F.inline(F.array_compact(F.array(inside, left, right))))


def fingerprint(s: Series, columns: list[str]) -> DataFrame:
    """Order-free digest of every recording: changes with any value or its position."""
    h = F.xxhash64("idx", *columns)
    return s.summary({"rows": F.count(F.lit(1)), "digest_xor": F.bit_xor(h), "digest_sum": F.sum(h.cast("decimal(38,0)")).cast("string")})


def context_key(digest: DataFrame, settings: dict, keys=("recording_id",)) -> DataFrame:
    """Digest and settings as one key; a stored result with another key is stale."""
    import json
    text = json.dumps(settings, sort_keys=True, allow_nan=False)
    parts = F.to_json(F.struct("rows", "digest_xor", "digest_sum"))
    return digest.select(*keys, F.sha2(F.concat_ws("|", parts, F.lit(text)), 256).alias("context_key"))


