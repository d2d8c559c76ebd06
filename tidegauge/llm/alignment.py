"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

Method: interval coalescing. The tokens of both tokenizers are byte intervals of the same text. All of them are sorted
together by start, the running maximum of their ends is taken, and a new group begins where a start reaches it: there both
have ended. Within the groups the overlapping pairs are expanded, token by token. All of this is done on arrays, for some
thousand texts at a time.

The counts of linked id pairs are corpus-wide. Texts are encoded once, into slices of ids that a shuffle keeps; the pairs of
each task are added up there, then by Spark. For each id of B the partners (at most as many as A has ids) are one row, dealt
over shards of the ids. A slice asks each shard for its distinct pairs, once each however often they occur; the shard
streams over the requests and answers them; the answers meet the slice again. So a frequent token costs one entry per slice, and
what a task holds is a slice or a shard of the vocabularies' pairs.

Defined cases: a text that is null or empty, or whose tokens of either tokenizer don't give back its bytes behind one space,
has no tokens; special tokens' strings are plain text; repeated rows count and are returned each; null ids are kept; columns
other than doc_id and text are not read; an empty table gives an empty result. Rows have to come in an order that a repeated
task sees again, as from files or a checkpoint, because slices are told apart by their place.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidegauge.llm.common import pack_arrays, slices, small_ints, spans, unpack_arrays

SHARD_BYTES, SHARDS = 4_000_000, (32, 4096)  # text for which there is one more shard, fewest and most shards
SLICE_BYTES = 1_500_000  # text of a slice, if it isn't one longer text
# How byte-level vocabularies of this kind split texts before merging; fixed by the tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PAIRS = 2_000_000  # different pairs that a task adds up before it sends them on
_LOADED: dict[str, Tokenizers] = {}


@dataclass
class Tokenizers:
    """The two tokenizers, and the bytes of each of their tokens."""
    a: Tokenizer
    fast_a: tiktoken.Encoding | None
    b: sentencepiece.SentencePieceProcessor
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text; both are empty where the tokens don't give the text back."""
        some = [i for i, t in enumerate(texts) if t]
        strings = [texts[i].decode("utf-8", "replace") for i in some]
        if self.fast_a is not None:
            ids_a = [self.fast_a.encode_ordinary(" " + s) for s in strings]
        else:
            ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in strings], add_special_tokens=False)]
        ids_b = self.b.encode(strings, num_threads=1) if strings else []
        none = np.empty(0, np.int64)
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        for i, x, y in zip(some, ids_a, ids_b):
            whole = b" " + texts[i]
            if b"".join(map(self.bytes_a.__getitem__, x)) == whole and b"".join(map(self.bytes_b.__getitem__, y)) == whole:
                out_a[i], out_b[i] = np.array(x, np.int64), np.array(y, np.int64)
        return out_a, out_b


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked(vocabulary: dict, spelled: dict[bytes, int]) -> tiktoken.Encoding | None:
    """A faster encoder of the same vocabulary, if its merges are in the order of their ids and nothing else shapes its tokens."""
    model, split = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain = plain and model.get("type") == "BPE" and not vocabulary.get("normalizer")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    merges = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    if not plain or merges != sorted(merges) or len(merges) + 256 != len(spelled) or merges[:1] < [256]:
        return None
    return tiktoken.Encoding(xxhash.xxh3_64_hexdigest(str(merges)), pat_str=SPLIT, mergeable_ranks=spelled, special_tokens={})


def load(vocabulary_a: bytes, model_b: bytes) -> Tokenizers:
    """From the contents of a byte-level tokenizer's JSON file and of a SentencePiece model."""
    key = xxhash.xxh3_128_hexdigest(vocabulary_a) + xxhash.xxh3_128_hexdigest(model_b)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = Tokenizer.from_str(vocabulary_a.decode()), sentencepiece.SentencePieceProcessor(model_proto=model_b)
        a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = json.loads(vocabulary_a)
        names = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}
        special = {t["content"] for t in vocabulary.get("added_tokens", [])}
        bytes_a = [b"" if (t := names.get(i, "")) in special else bytes(letters[c] for c in t) for i in range(max(names, default=-1) + 1)]
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        fast_a = ranked(vocabulary, {x: i for i, x in enumerate(bytes_a) if x})
        _LOADED[key] = Tokenizers(a, fast_a, b, bytes_a, bytes_b)
    return _LOADED[key]


@dataclass
class Slice:
    """Tokens of some texts: ids of A and B one after the other, and how many of them each text has."""
    counts_a: np.ndarray
    counts_b: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray

    def to_bytes(self) -> bytes:
        return pack_arrays([self.counts_a, self.counts_b, self.ids_a, self.ids_b])

    @staticmethod
    def from_bytes(data: bytes) -> Slice:
        return Slice(*(x.astype(np.int64) for x in unpack_arrays(data)))

    def intervals(self, widths_a: np.ndarray, widths_b: np.ndarray):
        """Starts and ends of A's and B's tokens. Both cover the same bytes of every text, so they run on over all texts."""
        ends_a, ends_b = np.cumsum(widths_a[self.ids_a]), np.cumsum(widths_b[self.ids_b])
        return ends_a - widths_a[self.ids_a], ends_a, ends_b - widths_b[self.ids_b], ends_b

    def links(self, widths_a: np.ndarray, widths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens of every overlapping pair."""
        start_a, end_a, start_b, end_b = self.intervals(widths_a, widths_b)
        first = np.searchsorted(end_b, start_a, "right")
        count = np.searchsorted(start_b, end_a, "left") - first
        return np.repeat(np.arange(len(start_a)), count), spans(first, count)

    def keys(self, widths_a: np.ndarray, widths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every link's id pair as b << 32 | a, and the place of its A token."""
        a, b = self.links(widths_a, widths_b)
        return self.ids_b[b] << 32 | self.ids_a[a], a

    def groups(self, widths_a: np.ndarray, widths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens (A's, then B's places behind them) by group, A before B within one; their groups; each text's number of groups."""
        start_a, end_a, start_b, end_b = self.intervals(widths_a, widths_b)
        start, end, n = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]), len(start_a)
        order = np.lexsort((np.arange(len(start)) >= n, start))
        reached = np.maximum.accumulate(end[order]) if len(order) else end
        new = np.ones(len(order), bool)
        new[1:] = start[order][1:] >= reached[:-1]
        group = np.cumsum(new) - 1
        text = np.concatenate([np.repeat(np.arange(len(c)), c) for c in (self.counts_a, self.counts_b)])
        per_text = np.bincount(text[order[new]], minlength=len(self.counts_a))
        by = np.argsort(group * 2 + (order >= n), kind="stable")
        return order[by], group[by], per_text

    def written(self, widths_a: np.ndarray, widths_b: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`, and their number."""
        tokens, group, per_text = self.groups(widths_a, widths_b)
        n, ids = len(self.ids_a), np.concatenate([self.ids_a, self.ids_b])[tokens]
        text = np.concatenate([np.repeat(np.arange(len(c)), c) for c in (self.counts_a, self.counts_b)])[tokens]
        is_b = tokens >= n
        mark = np.full(len(tokens), ord(","), np.uint8)
        if len(tokens):
            mark[:-1][is_b[:-1] != is_b[1:]] = ord("|")
            mark[:-1][group[:-1] != group[1:]] = ord(";")
            mark[:-1][text[:-1] != text[1:]] = 0
            mark[-1] = 0
        digits = len(str(int(ids.max(initial=0))))
        letters = np.zeros((len(tokens), digits + 1), np.uint8)
        rest = ids.copy()
        for k in range(digits - 1, -1, -1):
            letters[:, k] = np.where((rest > 0) | (k == digits - 1), 48 + rest % 10, 0)
            rest = rest // 10
        letters[:, digits] = mark
        size = (letters > 0).sum(axis=1)
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, size, len(self.counts_a)))]).astype(np.int64)
        data = letters.ravel()
        return pa.Array.from_buffers(pa.large_string(), len(self.counts_a), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[data > 0].tobytes())]), per_text


def widths(t: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in b], np.int64) for b in (t.bytes_a, t.bytes_b))


def _files(spark: SparkSession, vocabulary_a: str, model_b: str):
    """Both files' contents, read on the driver: workers need no copy of their own."""
    with open(vocabulary_a, "rb") as a, open(model_b, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def encoded(docs: DataFrame, files, shards: int = 0) -> DataFrame:
    """slice, ids (of its rows), data (`Slice`): the table's texts in slices of some megabytes."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        t, number = load(*files.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, texts in slices(batch, "text", SLICE_BYTES):
                a, b = t.encode(texts)
                made = Slice(*(np.array([len(x) for x in ids], np.int64) for ids in (a, b)), np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("doc_id")),
                                                  pa.array([made.to_bytes()], pa.binary())], names=["slice", "ids", "data"])
                number += 1

    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(held: DataFrame, files) -> DataFrame:
    """b, a, n: how many links of the whole table hold two ids linked."""
    def run(batches):
        w = widths(load(*files.value))
        keys, counts = [], []

        def added():
            if not keys:
                return []
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            keys.clear()
            counts.clear()
            return [key, n]

        def rows(key, n):
            for at in range(0, len(key), 1 << 16):
                k = key[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(n[at:at + (1 << 16)])], names=["b", "a", "n"])

        for batch in batches:
            for data in batch.column("data").to_pylist():
                key, n = np.unique(Slice.from_bytes(data).keys(*w)[0], return_counts=True)
                if len(key):
                    keys.append(key)
                    counts.append(n)
                if sum(map(len, keys)) > PAIRS:
                    key, n = added()
                    if len(key) > PAIRS // 2:
                        yield from rows(key, n)
                    else:
                        keys.append(key)
                        counts.append(n)
        if keys:
            yield from rows(*added())

    return held.mapInArrow(run, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, vocabulary_a: str, model_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row.

    groups: ids of A and B by group, as `a1,a2|b1;a3|b2,b3`. n_links: overlapping pairs of tokens. count_sum: over them, the
    count of the pair of ids in all links of the table. n_best: links whose count is the highest that their B id has.
    vocabulary_a: path of a byte-level tokenizer's JSON file; model_b: of a SentencePiece model.
    """
    spark = docs.sparkSession
    files = _files(spark, vocabulary_a, model_b)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(max(size // SHARD_BYTES, SHARDS[0]), SHARDS[1]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = encoded(docs, files).repartition(parts, "slice")
    table = pair_counts(held, files).groupBy("b").agg(F.collect_list(F.struct("a", "n")).alias("with"))
    table = table.select(F.pmod("b", F.lit(shards)).cast("int").alias("shard"), F.lit(-1).cast("long").alias("slice"), F.col("b").cast("long").alias("b"),
                         F.col("with.a").alias("a"), F.col("with.n").alias("n"), F.lit(None).cast("binary").alias("data"))

    def ask(batches):
        w = widths(load(*files.value))
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
                key = np.unique(Slice.from_bytes(data).keys(*w)[0])
                shard = (key >> 32) % shards
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                some = np.flatnonzero(np.diff(edges))
                asked = []
                for s in some:
                    k = key[order[edges[s]:edges[s + 1]]]
                    asked.append(pack_arrays([k >> 32, k & 0xFFFFFFFF]))
                none = pa.nulls(len(some), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([number] * len(some), pa.int64()), pa.nulls(len(some), pa.int64()),
                                                  pa.nulls(len(some), pa.list_(pa.int32())), none, pa.array(asked, pa.binary())], names=["shard", "slice", "b", "a", "n", "data"])

    asked = held.mapInArrow(ask, "shard int, slice long, b long, a array<int>, n array<long>, data binary")

    def answer(batches):
        """A shard's rows of the table come first (slice -1), then the requests for it."""
        shard, rows, key, n, best = None, [], None, None, None
        for batch in batches:
            made = []
            for r_shard, number, b, a, c, data in zip(*(batch.column(x) for x in ("shard", "slice", "b", "a", "n", "data"))):
                if r_shard.as_py() != shard:
                    shard, rows, key = r_shard.as_py(), [], None
                if number.as_py() < 0:
                    rows.append((b.as_py(), a.values.to_numpy(), c.values.to_numpy()))
                    continue
                if key is None:
                    key = np.concatenate([b << 32 | a.astype(np.int64) for b, a, _ in rows])
                    n = np.concatenate([c for *_, c in rows])
                    best = np.concatenate([np.full(len(c), c.max()) for *_, c in rows])
                    order = np.argsort(key)
                    key, n, best, rows = key[order], n[order], n[order] == best[order], []
                wanted = unpack_arrays(data.as_py())
                at = np.searchsorted(key, wanted[0].astype(np.int64) << 32 | wanted[1].astype(np.int64))
                made.append((number.as_py(), shard, pack_arrays([n[at], best[at]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made)) or [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], names=["slice", "shard", "counts"])

    both = table.unionByName(asked).repartition(max(parts, shards), "shard").sortWithinPartitions("shard", "slice")
    answered = both.mapInArrow(answer, "slice long, shard int, counts binary")

    def judge(left, right):
        """A slice with the counts of its pairs."""
        w = widths(load(*files.value))
        counts = dict(zip(right.column("shard").to_pylist(), right.column("counts").to_pylist()))
        out = []
        for ids, data in zip(left.column("ids").chunk(0) if left.num_rows else [], left.column("data").to_pylist()):
            t = Slice.from_bytes(data)
            link, a = t.keys(*w)
            key = np.unique(link)
            place = np.searchsorted(key, link)
            shard = (key >> 32) % shards
            order = np.argsort(shard, kind="stable")
            n, best = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            at = 0
            for s in sorted(counts):
                x, y = unpack_arrays(counts[s])
                n[order[at:at + len(x)]], best[order[at:at + len(x)]] = x, y
                at += len(x)
            text, texts = np.repeat(np.arange(len(t.counts_a)), t.counts_a)[a], len(t.counts_a)
            groups, n_groups = t.written(*w)
            # Links lie in order of their A token, so those of a text lie together.
            edges = np.searchsorted(text, np.arange(texts + 1))
            sums = np.concatenate([[0], np.cumsum(n[place])])
            total = sums[edges[1:]] - sums[edges[:-1]]
            out.append(pa.table({"doc_id": ids.values, "n_a": t.counts_a, "n_b": t.counts_b, "n_groups": n_groups.astype(np.int64), "n_links": np.bincount(text, minlength=texts).astype(np.int64),
                                 "n_best": np.bincount(text[best[place] > 0], minlength=texts).astype(np.int64), "count_sum": total, "groups": groups.cast(pa.string())}))
        return pa.concat_tables(out)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups", T.StringType())])
    return held.groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(judge, schema)
