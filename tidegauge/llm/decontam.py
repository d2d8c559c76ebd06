"""Benchmark decontamination: documents that hold an exact, edited or paraphrased copy of a test item.

Method: n-gram seeds, a bound and Smith-Waterman alignment. Items are cut into parts of at most PART words (half
overlapping). The word pairs of a part are its seeds; where a document has one, it tells where the part would lie, and the
words around are aligned with the part (match 2, mismatch -1, gap -1). The similarity is the alignment's score over that of
a perfect copy, from 0 to 1; a document holds the item if a part's similarity is over `least` by half a word or more.

No such pair is lost. An alignment of M matched words with E edits between them has 2 M - E as its score and M - E - 1
common word pairs at least; with a part of m words and `least` at 0.5 or more, a score over 2 m `least` + 1 thus leaves
B > 2 m `least` - M > 0 word pairs, so a seed is hit, and it spans fewer than 2 m words, which the window around a seed
holds whole. The same inequality is the bound: where the hits and the part's words found in the document, and then in the
window, together are no more than 2 m `least`, the alignment isn't computed. This is what frequent pairs such as "of the"
come to: they are rare enough evidence only where nearly all other words are there too.

On Spark: the documents are read in one pass per block of at most SEED_ROWS seeds; a block, a few dozen bytes per seed, is
broadcast, and each task holds one document's candidates at a time. No document is shuffled and nothing is keyed by a seed.

Defined cases: words are runs of letters and digits, in lower case; null texts have none; items of one word are never
found; rows with a null doc_id or item_id give no pairs; a repeated doc_id holds what any of its rows holds; repeated items
and rows count once; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, mix, slices, spans

SEED, PART = 2, 64  # words of a seed, most words of a part of an item
SEED_ROWS = 1_000_000  # about so many seeds are sought in one pass
LEAST = 0.5
TOKEN = re.compile(r"[^\W_]+")
TOGETHER = 256  # alignments that are computed at a time


def hashes(text: bytes, known: dict[str, int]) -> np.ndarray:
    """Word hashes. known: those of words met before, at most about a million."""
    words = TOKEN.findall(text.decode("utf-8", "replace").lower())
    if len(known) > 1_000_000:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, as signed longs."""
    if len(h) < n:
        return np.empty(0, np.int64)
    g = h[:len(h) - n + 1]
    for k in range(1, n):
        g = mix(g * np.uint64(31)) + h[k:len(h) - n + 1 + k]
    return g.view(np.int64)


def item_parts(items: DataFrame, n: int, width: int) -> DataFrame:
    """item_id, part, words (their hashes as longs)."""
    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            ids, parts, words = [], [], []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                h = hashes(t or b"", known).view(np.int64)
                for at in range(0, max(1, len(h) - width // 2), width // 2):
                    if len(h[at:at + width]) >= n:
                        ids.append(i)
                        parts.append(at)
                        words.append(h[at:at + width].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(words, pa.list_(pa.int64()))],
                                             names=["item_id", "part", "words"])
    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null").mapInArrow(
        run, "item_id long, part int, words array<long>")


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman similarity of each (item part, window of a document), from 0 to 1."""
    lengths = np.array([len(a) for a, _ in pairs])
    rows, width = int(lengths.max()), max(len(w) for _, w in pairs)
    a = np.zeros((len(pairs), rows), np.int64)
    w = np.zeros((len(pairs), width), np.int64)
    real = np.zeros((len(pairs), width), bool)
    for i, (p, q) in enumerate(pairs):
        a[i, :len(p)], w[i, :len(q)], real[i, :len(q)] = p, q, True
    step = np.arange(width, dtype=np.int32)
    before, best = np.zeros((len(pairs), width), np.int32), np.zeros(len(pairs), np.int32)
    for r in range(rows):
        same = (w == a[:, r, None]) & real & (r < lengths)[:, None]
        diagonal = np.concatenate([np.zeros((len(pairs), 1), np.int32), before[:, :-1]], axis=1) + np.where(same, 2, -1).astype(np.int32)
        now = np.maximum(np.maximum(diagonal, before - 1), 0)
        # A gap along the window costs 1 a word: the best start to the left, less the way from it.
        now = np.maximum.accumulate(now + step, axis=1) - step
        before = now.astype(np.int32)
        best = np.maximum(best, before.max(axis=1))
    return best / (2.0 * lengths)


@dataclass
class Block:
    """Parts of items (words as places in the vocabulary, padded by a place that no word has; lengths; item ids) and their
    seeds in order."""
    vocabulary: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    gram: np.ndarray
    part: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, list[int]]]) -> Block:
        lengths = np.array([len(w) for _, w in rows])
        vocabulary = np.unique(np.concatenate([w for _, w in rows]))
        words = np.full((len(rows), int(lengths.max())), len(vocabulary), np.int32)
        for i, (_, w) in enumerate(rows):
            words[i, :len(w)] = np.searchsorted(vocabulary, w)
        made = [grams(np.array(w, np.int64).view(np.uint64), SEED) for _, w in rows]
        gram, part = np.concatenate(made), np.repeat(np.arange(len(rows)), [len(m) for m in made])
        at = np.concatenate([np.arange(len(m)) for m in made])
        order = np.argsort(gram, kind="stable")
        return Block(vocabulary, words, lengths, np.array([i for i, _ in rows]), gram[order], part[order], at[order])

    def candidates(self, h: np.ndarray, least: float) -> list[tuple[int, np.ndarray]]:
        """(part, window) of a document's words, as places in the vocabulary, whose alignment may be over `least`."""
        g = grams(h.view(np.uint64), SEED)
        lo = np.searchsorted(self.gram, g, "left")
        hits = np.searchsorted(self.gram, g, "right") - lo
        pos = np.flatnonzero(hits)
        if not len(pos):
            return []
        seed, pos = spans(lo[pos], hits[pos]), np.repeat(pos, hits[pos])
        part = self.part[seed]
        need = 2 * least * self.lengths
        total = np.bincount(part, minlength=len(self.lengths))
        some = np.flatnonzero(total)
        # The document's words as places in the vocabulary; those that no item has get a place of their own.
        v = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        v = np.where(self.vocabulary[v] == h, v, len(self.vocabulary) + 1)
        present = np.zeros(len(self.vocabulary) + 2, bool)
        present[v] = True
        some = some[total[some] + present[self.words[some]].sum(axis=1) > need[some]]
        if not len(some):
            return []
        good = np.zeros(len(self.lengths), bool)
        good[some] = True
        keep = good[part]
        part, size = part[keep], self.lengths[part[keep]]
        if not len(part):
            return []
        # The part would begin at word pos - at, give or take its length.
        place = (pos[keep] - self.at[seed[keep]]) // size
        key, count = np.unique(part << 40 | (place + self.lengths.max()), return_counts=True)
        upto = np.concatenate([[0], np.cumsum(count)])
        near = upto[np.searchsorted(key, key + 2, "right")] - upto[np.searchsorted(key, key - 2, "left")]
        out = []
        for p, at, n in zip((key >> 40).tolist(), ((key & ((1 << 40) - 1)) - self.lengths.max()).tolist(), near.tolist()):
            m = int(self.lengths[p])
            window = v[max(0, (at - 1) * m):max(0, (at + 3) * m)]
            present[:] = False
            present[window] = True
            if n + int(present[self.words[p, :m]].sum()) > need[p]:
                out.append((p, window))
        return out


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST, width: int = PART) -> DataFrame:
    """doc_id, item_id, similarity (of the item's best part) of all pairs over `least` by half a word or more."""
    if least < 0.5:
        raise ValueError("seeds are complete for similarities over a half only")
    spark = docs.sparkSession
    base = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = cut(item_parts(items, SEED, width).distinct())
    seeds = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks, found = -(-seeds // SEED_ROWS), []
    for number in range(blocks):
        mine = parts.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == number)
        rows = [(r["item_id"], list(r["words"])) for r in mine.select("item_id", "words").collect()]  # about SEED_ROWS words
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Block.of(rows))

        def score(batches, sent=sent):
            block, known = sent.value, {}
            for batch in batches:
                for rows, ts in slices(batch, "text"):
                    ids, items_found, scores, held = [], [], [], []

                    def flush():
                        for (d, p, _), s in zip(held, align([(block.words[p, :block.lengths[p]], w) for _, p, w in held]) if held else []):
                            if s > least + 0.5 / block.lengths[p]:
                                ids.append(d)
                                items_found.append(block.items[p])
                                scores.append(float(s))
                        held.clear()

                    for d, t in zip(rows.column("doc_id").to_pylist(), ts):
                        h = hashes(t, known).view(np.int64)
                        for p, window in block.candidates(h, least):
                            held.append((d, p, window))
                            if len(held) >= TOGETHER:
                                flush()
                    flush()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items_found, pa.int64()), pa.array(scores, pa.float64())],
                                                     names=["doc_id", "item_id", "similarity"])

        found.append(base.mapInArrow(score, "doc_id long, item_id long, similarity double"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item."""
    return docs.join(matches(docs, items, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
