"""Line dedup: long lines that many documents hold stay only in the document with the largest id.

Method: explode the normalised lines, hash them, count distinct documents per hash, drop the lines over the
threshold, reassemble by position. Only 128-bit hashes, ids and positions are shuffled for the counts; counting
is a partial aggregate, so a line that a third of all documents hold costs one row per task. The text is moved
once, to meet the positions to drop.

Defined cases: a null or empty text is one empty line; lines split at \\n alone; a doc_id counts once however many
rows or lines it has, and each of its rows keeps or loses lines alike; rows with a null doc_id count for nothing and
keep all lines; other columns are only passed through if asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import slices

SALT = 16
BLANKS = b" \t\n\x0b\x0c\r"


def _points(key: bytes, least: int) -> bool:
    """Whether the UTF-8 bytes hold at least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of every line whose key is long enough."""
    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                row, pos, keys = [], [], []
                for i, t in enumerate(parts):
                    for p, line in enumerate(t.split(b"\n")):
                        if len(line) >= min_chars and _points(key := line.strip(BLANKS).lower(), min_chars):
                            row.append(i)
                            pos.append(p)
                            keys.append(digest(key))
                if row:
                    at, h = pa.array(row), np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").take(at), rows.column("text_hash").take(at), pa.array(pos, pa.int32()),
                         pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "text_hash", "pos", "h1", "h2"])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    return docs.mapInArrow(run, schema)


def drop_repeated(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, text (what is left), n_lines (before), n_dropped of every row."""
    base = docs.select("doc_id", *[c for c in keep if c not in ("doc_id", "text")], F.coalesce("text", F.lit("")).alias("text"))
    hashed = base.withColumn("text_hash", F.xxhash64("text"))
    lines = keyed_lines(hashed.filter("doc_id is not null").select("doc_id", "text", "text_hash"), min_chars)
    often = (lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last_id"))
             .filter(F.col("n") >= min_docs).drop("n"))
    # A line that very many documents hold meets its count in SALT places.
    salted = often.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    drops = (lines.join(salted, ["h1", "h2", "salt"]).filter("doc_id < last_id")
             .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops")))
    names = [*base.columns, "n_lines", "n_dropped"]

    def run(batches):
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                left, n_lines, n_dropped = [], [], []
                for t, drop in zip(parts, rows.column("drops").to_pylist()):
                    ls, gone = t.split(b"\n"), set(drop or ())
                    n_lines.append(len(ls))
                    n_dropped.append(len(gone))
                    left.append(b"\n".join([x for p, x in enumerate(ls) if p not in gone]) if gone else t)
                new = {"text": pa.array(left, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(c) for c in names], names=names)

    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    schema["text"].nullable = True
    return hashed.join(drops, ["doc_id", "text_hash"], "left").select(*base.columns, "drops").mapInArrow(run, schema)
