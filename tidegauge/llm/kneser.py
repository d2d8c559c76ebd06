"""Interpolated modified Kneser-Ney model, counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting. Each task counts the n-grams of its documents and sends them, packed and sorted, to shards of their hash; a
shard's task adds the counts up, writes a sorted array of hashes with counts to the shared folder, and sends on what
the next lower order needs: how many different words stand before each shorter n-gram (its continuation count), and for
each context its total and how many words follow it once, twice and more often. All of these add up over shards, so
nothing is keyed by a context or word alone: a word or pair that makes up a third of all text is one entry per task.
The number of shards follows the amount of text, so a shard stays at about SHARD_CHARS characters' worth of n-grams.

Scoring. Workers map the files (read in place when the shared folder is a file system path, else copied to a nameless
temporary file), sort each batch's n-grams and look them up shard by shard.

The model: order n, words as in `common`, A-Z lowered, one end token per text, n - 1 start marks before it. With counts
c at the highest order and continuation counts below, D(c) one of three discounts Y = n1 / (n1 + 2 n2),
D1 = 1 - 2 Y n2 / n1, D2 = 2 - 3 Y n3 / n2, D3+ = 3 - 4 Y n4 / n3 of that order (each held between 0 and the count),
P(w | context) = (c - D(c)) / total + (D1 N1 + D2 N2 + D3+ N3+) / total * P(w | shorter context), and below the
unigrams 1 / (V + 1) for each of the V known tokens and the unknown one. An unseen context leaves it to the shorter one.

Defined cases: a null text is empty: its only token is the end; with no training text every token has probability 1 / (V + 1) = 1; repeated rows count and are scored each;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import mix, shared_folder, slices

SHARD_CHARS = 8_000_000
FLUSH_TOKENS = 1_000_000  # tokens that a task counts before it sends them
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # codes of the marks, which no word's hash is expected to meet
MOST_ARRAYS = 8
CODE_BYTES = 7  # of a word's hash: among a billion different words fewer than ten pairs share one
CODE_MASK = (1 << 8 * CODE_BYTES) - 1
FILES = 512  # mapped files that a worker keeps open
ROW = "kind string, level int, shard long, n long, data binary"


def location(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays of unsigned integers behind a header of lengths and item sizes; the file appears whole, so that a
    repeated task does no harm."""
    fs, path = location(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
    header = np.zeros((2, MOST_ARRAYS), np.int64)
    header[0, :len(arrays)], header[1, :len(arrays)] = [len(a) for a in arrays], [a.itemsize for a in arrays]
    with fs.open_output_stream(part) as out:
        out.write(header.tobytes())
        for a in arrays:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    fs.move(part, path)


def map_arrays(uri: str) -> list[np.ndarray]:
    fs, path = location(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    at, out = 16 * MOST_ARRAYS, []
    for n, size in raw[:at].view(np.int64).reshape(2, -1).T.tolist():
        if size:
            out.append(raw[at:at + n * size].view(f"u{size}"))
            at += n * size + -(n * size) % 8
    return out


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hash, so keys in order are also in order of their shard."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def gram_key(codes: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as columns of codes, first word first."""
    h = mix(codes[0])
    for c in codes[1:]:
        h = mix(h * np.uint64(31) + c)
    return h


def summed(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the row each was first met in, and the sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[new], order[new], [np.add.reduceat(v[order], new) if len(new) else v[:0] for v in values]


def in_order(key: np.ndarray, codes: list[np.ndarray], values: list[np.ndarray]):
    at = np.argsort(key, kind="stable")
    return key[at], [c[at] for c in codes], [v[at] for v in values]


def small_ints(v: np.ndarray) -> np.ndarray:
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(v) or int(v.max()) <= np.iinfo(kind).max:
            return v.astype(kind)
    return v.astype(np.uint64)


def packed(kind: str, level: int, key: np.ndarray, codes: list[np.ndarray], values: list[np.ndarray], shards: int):
    """One row per shard with the columns of its keys. Keys come in order; within a row the first code is sorted."""
    edges = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        at = np.arange(edges[s], edges[s + 1])
        at = at[np.argsort(codes[0][at], kind="stable")]
        first = codes[0][at]
        new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        data = [np.int64(len(new)).tobytes(), _short(first[new])]
        for v in (np.diff(np.concatenate([new, [len(first)]])), *(v[at] for v in values)):
            v = small_ints(v)
            data += [bytes([v.itemsize]), v.tobytes()]
        yield kind, level, int(s), len(at), b"".join(data + [_short(c[at]) for c in codes[1:]])


def unpacked(n: int, data: bytes, codes: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    heads = int.from_bytes(data[:8], "little")
    first, at, vs = _long(data, 8, heads), 8 + CODE_BYTES * heads, []
    for size in (heads, *[n] * values):
        width = data[at]
        vs.append(np.frombuffer(data, f"u{width}", size, at + 1).astype(np.int64))
        at += 1 + size * width
    rest = [_long(data, at + CODE_BYTES * n * i, n) for i in range(codes - 1)]
    return [np.repeat(first, vs[0]), *rest], vs[1:]


def _short(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def _long(data: bytes, at: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :CODE_BYTES] = np.frombuffer(data, np.uint8, CODE_BYTES * n, at).reshape(n, CODE_BYTES)
    return out.view("<u8").ravel()


def rows_table(rows) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("kind", "level", "shard", "n", "data"), cols, kinds)})


def token_codes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens of the texts, ends included, and the number of each text's tokens."""
    words, counts = [], []
    for t in parts:
        ws = t.lower().split()
        words += ws
        words.append(None)
        counts.append(len(ws) + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([int(END) if w is None else digest(w) & CODE_MASK for w in words], np.uint64), np.array(counts)


def context_columns(codes: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For every token the order - 1 tokens before it (start marks at the beginning of a text) and itself."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [codes]
    for back in range(1, order):
        c = np.full(len(codes), START)
        c[back:] = codes[:-back] if back else codes
        c[place < back] = START
        out.insert(0, c)
    return out


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    """folder: of the sorted arrays; discounts: (D1, D2, D3+) per level; tokens: N; words: V, known tokens."""
    folder: str
    order: int
    shards: int
    tokens: int
    words: int
    discounts: dict[int, tuple[float, float, float]]
    unigrams: int  # sum of the continuation counts of level 1
    freed: float  # share of level 1's mass that the discounts leave to all tokens evenly


def discounts(n: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 1.0, 1.5  # too little text to estimate them
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def train(docs: DataFrame, order: int = 2) -> Model:
    """Count all texts of docs."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    folder = shared_folder(spark, "kneser-ney")
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(4, -(-chars * (order - 1) // SHARD_CHARS))

    def count(batches):
        held, size = [], 0

        def flush():
            codes, counts = [np.concatenate(c) for c in zip(*held)]
            columns = context_columns(codes, counts, order)
            ones = np.ones(len(codes), np.int64)
            key, first, (n,) = summed(gram_key(columns), [ones])
            yield from packed("gram", order, key, [c[first] for c in columns], [n], shards)

        for batch in batches:
            for _, parts in slices(batch, "text"):
                held.append(token_codes(parts))
                size += len(held[-1][0])
                if size >= FLUSH_TOKENS:
                    yield from rows_table(flush()).to_batches(64)
                    held, size = [], 0
        if held:
            yield from rows_table(flush()).to_batches(64)

    def reduce_(key, table):
        """Adds up one shard of one kind, writes it, and sends on what lower orders need."""
        kind, level, shard = (k.as_py() for k in key)
        if kind == "stat":
            return table.select(["kind", "level", "shard", "n", "data"])
        # An n-gram has its count and, below the highest order, how often it occurs.
        n_codes, n_values = (1, 4) if kind == "context" else (level, 1 if level == order else 2)
        parts = [unpacked(n, d, n_codes, n_values) for n, d in zip(table.column("n").to_pylist(), table.column("data").to_pylist())]
        codes = [np.concatenate(c) for c in zip(*(p[0] for p in parts))]
        values = [np.concatenate(v) for v in zip(*(p[1] for p in parts))]
        k, first, values = summed(gram_key(codes), values)
        path = f"{folder}/{kind}-{level}-{shard:07d}"
        if kind == "context":
            write_arrays(path, [k, *map(small_ints, values)])
            return rows_table([])
        codes, c = [x[first] for x in codes], values[0]
        write_arrays(path, [k, *map(small_ints, values if level == 1 else values[:1])])
        out = [("stat", level, shard, 0, np.array([len(k), int(c.sum()), *counts_of_counts(c), int(values[-1].sum())], np.int64).tobytes())]
        if level > 1:
            x, first, sums = summed(gram_key(codes[:-1]), [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)])
            context = gram_key(codes[:-1])[first] & np.uint64(CODE_MASK)
            out += packed("context", level, *in_order(gram_key([context]), [context], sums), shards)
            lower = codes[1:]
            k, first, sums = summed(gram_key(lower), [np.ones(len(c), np.int64), values[-1]])
            out += packed("gram", level - 1, k, [q[first] for q in lower], sums, shards)
        return rows_table(out)

    rows = docs.select("text").mapInArrow(count, ROW)
    for _ in range(order):
        rows = rows.groupBy("kind", "level", "shard").applyInArrow(reduce_, ROW)

    def stats(batches):
        for b in batches:
            s = [np.frombuffer(d, np.int64) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("level"), *(pa.array([int(x[i]) for x in s], pa.int64()) for i in range(7))], names=["level", *"abcdefg"])

    facts = rows.filter("kind = 'stat'").mapInArrow(stats, "level int, a long, b long, c long, d long, e long, f long, g long")
    facts = {r["level"]: r for r in facts.groupBy("level").agg(*[F.sum(x).alias(x) for x in "abcdefg"]).collect()}
    none = dict.fromkeys("abcdefg", 0)
    by = {level: discounts([facts.get(level, none)[x] for x in "cdef"]) for level in range(1, order + 1)}
    ones = facts.get(1, none)
    followed = (ones["c"], ones["d"], ones["a"] - ones["c"] - ones["d"])
    freed = sum(d * n for d, n in zip(by[1], followed)) / max(1, ones["b"])
    return Model(folder, order, int(shards), ones["g"], ones["a"], by, ones["b"], freed)


class Mapped:
    """A worker's view of the model's files."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()

    def arrays(self, kind: str, level: int, shard: int) -> list[np.ndarray] | None:
        name = (kind, level, shard)
        if name not in self.open:
            try:
                self.open[name] = map_arrays(f"{self.model.folder}/{kind}-{level}-{shard:07d}")
            except FileNotFoundError:
                self.open[name] = None  # no n-gram fell into this shard
            if len(self.open) > FILES:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def look_up(self, kind: str, level: int, key: np.ndarray) -> list[np.ndarray]:
        """The values of the keys, 0 where there is none."""
        out = [np.zeros(len(key), np.int64) for _ in range(4 if kind == "context" else 2 if level == 1 else 1)]
        order = np.argsort(key)
        key = key[order]
        shards = shard_of(key, self.model.shards)
        edges = np.searchsorted(shards, np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            arrays = self.arrays(kind, level, int(s))
            if arrays is None or not len(arrays[0]):
                continue
            part = key[edges[s]:edges[s + 1]]
            at = np.minimum(np.searchsorted(arrays[0], part), len(arrays[0]) - 1)
            hit = np.flatnonzero(arrays[0][at] == part)
            for o, v in zip(out, arrays[1:]):
                o[order[edges[s] + hit]] = v[at[hit]]
        return out


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


def token_scores(mapped: Mapped, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token its count in training, and log10 of its probability."""
    m = mapped.model
    number, distinct = pd.factorize(codes)
    c, seen = mapped.look_up("gram", 1, gram_key([distinct]))
    p = np.full(len(distinct), 1.0 / (m.words + 1))
    if m.unigrams:
        p = discounted(c, m.discounts[1]) / m.unigrams + m.freed * p
    p = p[number]
    columns = context_columns(codes, counts, m.order)
    for level in range(2, m.order + 1):
        if not m.unigrams:
            break
        at, contexts = pd.factorize(gram_key(columns[m.order - level:-1]) & np.uint64(CODE_MASK))
        contexts = gram_key([contexts])
        total, n1, n2, n3 = (v[at] for v in mapped.look_up("context", level, contexts))
        c = mapped.look_up("gram", level, gram_key(columns[m.order - level:]))[0]
        d = m.discounts[level]
        some = np.maximum(total, 1)
        p = np.where(total > 0, discounted(c, d) / some + (d[0] * n1 + d[1] * n2 + d[2] * n3) / some * p, p)
    return seen[number], np.log10(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and other columns but text, with n_tokens, n_known, base_score, score of every row."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in others]

    def run(batches):
        mapped = Mapped(model)
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                codes, counts = token_codes(parts)
                seen, logs = token_scores(mapped, codes, counts)
                base = np.log10((seen + 1) / (model.tokens + model.words + 1))
                first = np.cumsum(counts) - counts
                made = [counts, np.add.reduceat((seen > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(logs, first)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *map(pa.array, made)], names=[*names, "n_tokens", "n_known", "base_score", "score"])

    kinds = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    return docs.select(*names, "text").mapInArrow(run, T.StructType([*others, *(T.StructField(*k) for k in kinds)]))
