"""Helpers shared by the operators: column choice, Arrow batches, words and the shared folder.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r; `bytes.split` splits exactly
there, and `bytes.lower` lowers exactly A-Z, so that both work on the UTF-8 form of a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.settings import checkpoint_dir, cut, release  # noqa: F401

TEXT_BYTES = 4 << 20  # text that a task turns into words at a time
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 texts; null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = TEXT_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of at most `limit` bytes of text, or of one row."""
    all_texts, start, size = texts(batch.column(column)), 0, 0
    for i, t in enumerate(all_texts):
        if i > start and size + len(t) > limit:
            yield batch.slice(start, i - start), all_texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < batch.num_rows:
        yield batch.slice(start), all_texts[start:]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def crc_of(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1 of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def small_ints(v: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as the largest one needs."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(v) or int(v.max()) <= np.iinfo(kind).max:
            return v.astype(kind)
    return v.astype(np.uint64)


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers from 0 on, compressed."""
    arrays = [small_ints(a) for a in arrays]
    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), a.itemsize)], np.int64)
    raw = head.tobytes() + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for size, width in head.tolist():
        out.append(np.frombuffer(raw, f"u{width}", size, at))
        at += size * width
    return out
