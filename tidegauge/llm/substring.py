"""Substring dedup: words covered by a long passage that a document with a smaller id holds as well are removed.

Method: super-k-mer partitioning. A window is WINDOW consecutive words; its minimiser is the least hash among its
runs of MINIMISER words. Equal windows have equal minimisers. Consecutive windows with one minimiser travel as one
packed string of words to the bucket of that minimiser, where the windows are sorted (by two independent 64-bit
polynomials of their word hashes) and counted; the documents' ids decide which are repeats.

Before that, one pass finds the minimisers that documents of two ids have: only their windows can repeat. The shared ones
go into a bit filter of at most FILTER_BITS bits, the only thing broadcast; windows that it rules out stay at home. A
filter lets some others pass, all of them when it is full, which costs shuffle but changes no result.

A passage that a third of all documents hold doesn't gather in one bucket: before the shuffle each task sorts its own
windows, decides those that it also sees under a smaller id, and sends only the others, so a bucket gets at most one
document per distinct window and flush. Buckets are streamed in order of the id and keep only window digests.

Defined cases: a null text has no words; texts shorter than a window keep all words; windows repeated in one document
alone, or under one doc_id, are no repeats; rows with a null doc_id lose nothing and cause no removal; repeated rows
give one row each; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import cut, mix, slices

WINDOW, MINIMISER = 50, 6
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FLUSH = 6 << 20  # bytes of text whose windows a task compares before it sends them
FILTER_BITS = 1 << 30  # of the filter of shared minimisers, at most
PAGE = 1 << 16  # bits of a page of the filter
CHUNK = 4 << 20  # bytes of packed words that a bucket task counts at a time


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def rolling(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial (modulo 2^64) of every run of `width` numbers."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = np.full(n, base), np.full(n, _inverse(base))
    up[0] = down[0] = 1
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(up))])
    return (s[width:] - s[:-width]) * np.multiply.accumulate(down)[:n - width + 1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` numbers."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64) if words else np.empty(0, np.uint64)


def digests(h: np.ndarray, width: int) -> np.ndarray:
    """Two independent digests of every window, as one structured array."""
    out = np.empty(max(0, len(h) - width + 1), [("a", "u8"), ("b", "u8")])
    out["a"], out["b"] = rolling(h, width, BASES[0]), rolling(mix(h), width, BASES[1])
    return out


def runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every maximal run of set flags with one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
    return at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]


def first_of_equal(d: np.ndarray) -> np.ndarray:
    """For every window the first position that has the same digests."""
    order = np.lexsort((np.arange(len(d)), d["b"], d["a"]))
    s = d[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    first = np.empty(len(d), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first


@dataclass
class Windows:
    """The windows of some documents, in order of the documents' ids."""
    words: list[bytes]
    ids: np.ndarray  # of each document
    hashes: np.ndarray  # text_hash of each document
    offset: np.ndarray  # first word of each document
    doc: np.ndarray  # document of each word
    inside: np.ndarray  # whether the window that begins at a word ends in the same document
    least: np.ndarray  # its minimiser
    codes: np.ndarray  # hash of each word


def windows_of(held: list, window: int, minimiser: int) -> Windows | None:
    words, owner, offset = [], [], []
    held.sort(key=lambda r: r[0])
    for i, (_, _, t) in enumerate(held):
        ws = t.split()
        if len(ws) >= window:
            owner.append((i, len(ws)))
            offset.append(len(words))
            words.extend(ws)
    if not words:
        return None
    h = word_hashes(words)
    doc = np.repeat(np.arange(len(owner)), [n for _, n in owner])
    least = sliding_min(mix(rolling(h, minimiser, BASES[0])), window - minimiser + 1)
    return Windows(words, np.array([held[i][0] for i, _ in owner], np.int64), np.array([held[i][1] for i, _ in owner], np.int64),
                   np.array(offset), doc, doc[:len(least)] == doc[window - 1:], least, h)


def flushes(batches, window: int, minimiser: int):
    """Windows of about FLUSH bytes of text at a time."""
    held, size = [], 0
    for batch in batches:
        for rows, parts in slices(batch, "text"):
            held += zip(rows.column("doc_id").to_pylist(), rows.column("text_hash").to_pylist(), parts)
            size += sum(map(len, parts))
            if size >= FLUSH:
                if (made := windows_of(held, window, minimiser)) is not None:
                    yield made
                held, size = [], 0
    if (made := windows_of(held, window, minimiser)) is not None:
        yield made


def minimisers(batches, window: int, minimiser: int):
    """The different minimisers of each flush with the least and largest id that has them."""
    for w in flushes(batches, window, minimiser):
        at = np.flatnonzero(w.inside)
        at = at[np.concatenate([[True], (np.diff(w.least[at]) != 0) | (np.diff(w.doc[at]) != 0)])]
        order = np.argsort(w.least[at], kind="stable")  # documents stay in order of their ids
        m, ids = w.least[at][order], w.ids[w.doc[at]][order]
        new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        last = np.concatenate([new[1:] - 1, [len(m) - 1]])
        yield pa.RecordBatch.from_arrays([pa.array(m[new].view(np.int64)), pa.array(ids[new]), pa.array(ids[last])], names=["m", "lo", "hi"])


def places(m: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a minimiser in the filter."""
    return (m & np.uint64(bits - 1)).astype(np.int64), (mix(m) & np.uint64(bits - 1)).astype(np.int64)


def shared_filter(docs: DataFrame, window: int, minimiser: int) -> np.ndarray:
    """Bytes of a bit filter that holds every minimiser that documents of two ids have."""
    found = docs.mapInArrow(lambda b: minimisers(b, window, minimiser), "m long, lo long, hi long")
    shared = cut(found.groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("m"))
    bits = min(FILTER_BITS, max(PAGE, 1 << (16 * shared.count()).bit_length()))

    def bit_places(batches):
        for b in batches:
            at = np.concatenate(places(b.column("m").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // PAGE), pa.array(at % PAGE)], names=["page", "bit"])

    def page(table):
        out = np.zeros(PAGE, np.uint8)
        out[table.column("bit").to_numpy()] = 1
        return pa.table({"page": table.column("page").slice(0, 1), "data": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    marks = shared.mapInArrow(bit_places, "page long, bit long").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in marks.groupBy("page").applyInArrow(page, "page long, data binary").toLocalIterator():  # FILTER_BITS bits at most
        out[r["page"] * PAGE // 8:(r["page"] + 1) * PAGE // 8] = np.frombuffer(r["data"], np.uint8)
    return out


def packed(batches, shared: np.ndarray, window: int, minimiser: int):
    """Rows to shuffle: bucket, doc_id, text_hash, start, words (a super-k-mer), or stop for a decided range of windows."""
    names = ["bucket", "doc_id", "text_hash", "start", "stop", "words"]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    for w in flushes(batches, window, minimiser):
        at = np.flatnonzero(w.inside)  # windows within one document
        at = at[np.logical_and.reduce([shared[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in places(w.least[at], 8 * len(shared))]).astype(bool)]
        d = digests(w.codes, window)[at]
        first = at[first_of_equal(d)]
        decided, send = np.zeros(len(w.inside), bool), np.zeros(len(w.inside), bool)
        decided[at] = w.ids[w.doc[at]] > w.ids[w.doc[first]]
        send[at] = ~decided[at]
        s, e = runs(decided, w.doc)
        doc = w.doc[s]
        # What is decided already is only passed on; copies of one text are spread by their ids.
        out = [mix((w.ids[doc] ^ w.hashes[doc]).view(np.uint64)).view(np.int64).tolist(), w.ids[doc].tolist(), w.hashes[doc].tolist(), (s - w.offset[doc]).tolist(), (e - w.offset[doc]).tolist(), [None] * len(s)]
        # A super-k-mer ends where the window is not sent, the document ends or the minimiser changes.
        k = np.flatnonzero(send)
        if len(k):
            new = np.flatnonzero((np.diff(k) != 1) | (np.diff(w.doc[k]) != 0) | (w.least[k][1:] != w.least[k][:-1])) + 1
            s, e = k[np.concatenate([[0], new])], k[np.concatenate([new - 1, [len(k) - 1]])]
            doc = w.doc[s]
            packs = [b" ".join(w.words[a:b]) for a, b in zip(s.tolist(), (e + window).tolist())]
            more = [w.least[s].view(np.int64).tolist(), w.ids[doc].tolist(), w.hashes[doc].tolist(), (s - w.offset[doc]).tolist(), [None] * len(s), packs]
            out = [a + b for a, b in zip(out, more)]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=names)


def counted(batches, window: int):
    """Ranges of windows (doc_id, text_hash, start, stop) that a smaller id holds too; rows come sorted by bucket and doc_id."""
    names = ["doc_id", "text_hash", "start", "stop"]
    empty = np.empty(0, [("a", "u8"), ("b", "u8")])
    seen, seen_id, seen_bucket = empty, np.empty(0, np.int64), None  # windows of the bucket that the last chunk ended in

    def count(rows):
        nonlocal seen, seen_id, seen_bucket
        bucket, ids, hashes, start, packs = zip(*rows)
        split = [p.split() for p in packs]
        h = word_hashes([w for ws in split for w in ws])
        sizes = np.array([len(ws) for ws in split])
        row = np.repeat(np.arange(len(rows)), sizes)
        d = digests(h, window)
        at = np.flatnonzero(row[:len(d)] == row[window - 1:])
        owner, d = row[at], d[at]
        ids, bucket = np.array(ids, np.int64), np.array(bucket, np.int64)
        carried = len(seen) if seen_bucket == bucket[0] else 0
        whole = np.concatenate([seen[:carried], d])
        whole_id = np.concatenate([seen_id[:carried], ids[owner]])
        first = first_of_equal(whole)
        # Within a bucket rows come by id, and equal windows share a bucket: the first one has the smallest id.
        repeat = whole_id > whole_id[first]
        last = np.concatenate([np.full(carried, bucket[-1] == bucket[0]), bucket[owner] == bucket[-1]])
        keep = np.flatnonzero(last & (first == np.arange(len(whole))))
        seen, seen_id, seen_bucket = whole[keep], whole_id[keep], bucket[-1]
        s, e = runs(repeat[carried:], owner)
        base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        o = owner[s]
        from_start = np.array(start, np.int64)[o] - base[o]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[o]), pa.array(np.array(hashes, np.int64)[o]), pa.array(at[s] + from_start), pa.array(at[e] + from_start)], names=names)

    held, size = [], 0
    for batch in batches:
        done = batch.filter(pa.compute.is_valid(batch.column("stop")))
        if done.num_rows:
            yield done.select(names)
        todo = batch.filter(pa.compute.is_null(batch.column("stop")))
        for r in zip(*(todo.column(c).to_pylist() for c in ("bucket", "doc_id", "text_hash", "start", "words"))):
            held.append(r)
            size += len(r[4])
            if size >= CHUNK:
                yield count(held)
                held, size = [], 0
    if held:
        yield count(held)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, text_hash, start, stop: first and last window (by their first word) of repeated passages."""
    base = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    shared = shared_filter(base, window, minimiser)
    sent = base.mapInArrow(lambda b: packed(b, shared, window, minimiser), "bucket long, doc_id long, text_hash long, start long, stop long, words binary")
    return (sent.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
            .mapInArrow(lambda b: counted(b, window), "doc_id long, text_hash long, start long, stop long"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), kept_sha256 of every row."""
    ranges = repeated_ranges(docs, window, minimiser)
    ranges = ranges.groupBy(F.col("doc_id").alias("_id"), "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    joined = base.join(ranges.withColumnRenamed("text_hash", "_hash"),
                       (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "text", F.transform("gone", lambda g: g["start"]).alias("starts"), F.transform("gone", lambda g: g["stop"]).alias("stops"))

    def run(batches):
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                n, removed, kept = [], [], []
                for t, starts, stops in zip(parts, rows.column("starts").to_pylist(), rows.column("stops").to_pylist()):
                    words = t.split()
                    n.append(len(words))
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, np.array(stops) + window, -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        removed.append(int(covered.sum()))
                        words = [w for w, c in zip(words, covered.tolist()) if not c]
                    else:
                        removed.append(0)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "text", "kept_sha256"])

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept_sha256", T.StringType())]
    return joined.mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))
