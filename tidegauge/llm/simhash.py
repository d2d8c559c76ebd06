"""SimHash fingerprints, and their classes at a small Hamming distance.

Method: pigeonhole blocks. 64 bits are cut into `distance + 3` blocks; fingerprints that differ in at most
`distance` bits agree on three whole blocks at least, so they meet under one of the keys made of three blocks. Distinct fingerprints are joined on these keys and verified. A key with many fingerprints is cut again by the
bits it leaves open (four parts, of which one must agree), so no group grows without bound and none is
expanded into pairs: a group gives each member one edge, to the smallest member it reaches inside the group.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; repeated rows give one
row each; a null doc_id gives no class id to others, and its own class is null if no member has an id; columns
other than doc_id and text are not read; an empty table gives an empty result.

`one_of_each` keeps one document of each class of near copies, by the Jaccard similarity of the sets of five-word
shingles. Copies of 0.8 or more differ in about a fiftieth of their words, so the fingerprints that find them are made of
a text's different words, twice with other hashes, and may differ in five bits; the pairs that connect each group are then
compared exactly. Of what they leave unconnected, texts that share one of their rare shingles are compared as well: the
rarest fifth of a set and one more, in one order of all shingles, so that no pair of copies is left out. A row's text is known by its MD5, so repeated ids and missing ids are no trouble: of a class the row with
the smallest doc_id stays (a null id comes last, then the smallest MD5); texts without words are copies of each other;
all columns come through, whatever they are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import cut, release, slices, spans

GROUP = 256  # fingerprints of a key that are compared with each other in one go
DEPTH = 4  # times that a larger group is cut again
PATHS = 10_000  # most ways of choosing blocks and parts
NEAR_GROUP = 4096  # fingerprints of a key that near copies are found among in one go
PAIRS = 1_000_000  # pairs of fingerprints that a task compares at a time
SAMPLE = 20_000  # texts whose shingles are counted for the order of all shingles
FREQUENT = 100_000  # shingles of several of these texts that are told to all tasks
SLACK = 1e-6  # against the last bits of products of sizes and similarities


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """A bit is 1 if set in over half of the XXH64 hashes of all shingles."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, 65_536):
        part = words[at:min(n, at + 65_536) + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.array([digest(g, 42) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                fps = np.array([fingerprint(t.lower().split(), width) for t in parts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _star(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each of the fingerprints, the smallest one that it reaches in steps of at most `distance` bits."""
    label = np.arange(len(fps))
    rows = max(1, (1 << 22) // len(fps))
    while True:
        new = label.copy()
        for at in range(0, len(fps), rows):
            near = np.bitwise_count(fps[at:at + rows, None] ^ fps[None, :]) <= distance
            new[at:at + rows] = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return fps[label]
        label = new


def _spanning(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints at most `distance` bits apart that connect all that such pairs connect, the closest first.

    Trees grow by the fingerprint closest to any of theirs, so the time goes with the square of the group and memory with its size.
    """
    best, parent = np.full(len(fps), 255, np.int16), np.zeros(len(fps), np.int64)
    a, b = [], []
    for _ in range(len(fps)):
        i = int(best.argmin())
        if best[i] <= distance:
            a.append(i)
            b.append(parent[i])
        best[i] = 999  # in a tree
        bits = np.bitwise_count(fps[i] ^ fps)
        closer = (bits < best) & (best < 999)
        best[closer], parent[closer] = bits[closer], i
    return fps[a], fps[b]


def links(fps: DataFrame, distance: int = 3, group: int = GROUP) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints of column fp."""
    blocks = _cuts(list(range(64)), distance + 3)
    keys = [sorted(b for i in pick for b in blocks[i]) for pick in combinations(range(len(blocks)), 3)]
    masks = [_signed(sum(1 << b for b in bits)) for bits in keys]
    fp = F.col("fp")
    # path: which choice of blocks was made; key: their bits.
    members = fps.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m)) for m in masks])).alias("path", "key"))
    open_bits = [[b for b in range(64) if b not in bits] for bits in keys]
    found = []
    for depth in range(DEPTH + 1):
        # The last cut: keys of larger distances branch faster, so it comes after fewer cuts there.
        last = depth == DEPTH or len(open_bits) * (distance + 1) > PATHS or not any(open_bits)
        sizes = members.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most"))
        some = sizes.filter("n > 1" if last else f"n between 3 and {group}").select("path", "key")
        pairs = sizes.filter(F.expr(f"n = 2 and bit_count(least ^ most) <= {distance}")).select(F.col("least").alias("a"), F.col("most").alias("b"))
        if not last:
            found.append(pairs)
        lists = members.join(some, ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

        def run(batches):
            for batch in batches:
                a, b = [], []
                for x in batch.column("fps"):
                    v = np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    root = _star(v, distance)
                    a.append(v[v != root])
                    b.append(root[v != root])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], names=["a", "b"])

        found.append(lists.mapInArrow(run, "a long, b long"))
        if last:
            break
        # The rest: one of the parts of the open bits must agree as well.
        big = sizes.filter(f"n > {group}").select("path", "key")
        if not big.take(1):
            break
        parts = [_cuts(bits, distance + 1) for bits in open_bits]
        extra = F.array(*[F.array(*[F.lit(_signed(sum(1 << b for b in p))) for p in ps]) for ps in parts])
        deeper = members.join(big, ["path", "key"]).withColumn("_m", F.element_at(extra, F.col("path") + 1))
        members = cut(deeper.select("fp", "path", "key", F.posexplode("_m").alias("part", "mask"))
                      .select("fp", (F.col("path") * (distance + 1) + F.col("part")).cast("int").alias("path"),
                              F.col("key").bitwiseOR(fp.bitwiseAND(F.col("mask"))).alias("key")))
        open_bits = [[b for b in bits if b not in p] for bits, ps in zip(open_bits, parts) for p in ps]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def near_pairs(path: np.ndarray, key: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at most `distance` bits apart that connect each group of equal (path, key); the groups lie one after the other."""
    new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])])) if len(fps) else np.empty(0, np.int64)
    size = np.diff(np.concatenate([new, [len(fps)]]))
    out, at = [], np.concatenate([[0], np.cumsum(size * (size - 1) // 2)])
    while len(new):
        n = max(1, int(np.searchsorted(at, at[0] + PAIRS, "right")) - 1)  # groups with about so many pairs together
        if size[0] > 2 * GROUP:
            out.append(_spanning(fps[new[0]:new[0] + size[0]], distance))
        else:
            begin, count = new[:n], size[:n]
            row = spans(begin, count)
            after = np.repeat(begin + count, count) - row - 1
            i, j = np.repeat(row, after), spans(row + 1, after)
            near = np.bitwise_count(fps[i] ^ fps[j]) <= distance
            i, j = i[near], j[near]
            group = np.searchsorted(begin, i, "right") - 1
            found = np.bincount(group, minlength=n)
            few = found[group] < count[group]  # no more than a tree has
            out.append((fps[i[few]], fps[j[few]]))
            out += [_spanning(fps[begin[g]:begin[g] + count[g]], distance) for g in np.flatnonzero(found >= np.maximum(count, 1))]
        new, size, at = new[n:], size[n:], at[n:]
    return out


def near_links(fps: DataFrame, distance: int, group: int = NEAR_GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column fp, all at most `distance` bits apart, that connect what such edges connect.

    The blocks of `links`, in one shuffle: rows are sorted by key, and a task reads group after group. The members of a
    larger group come back and are cut again by the bits that their key leaves open.
    """
    blocks = _cuts(list(range(64)), distance + 3)
    masks = [[b for i in pick for b in blocks[i]] for pick in combinations(range(len(blocks)), 3)]
    fp, found = F.col("fp"), []
    number = lambda bits: F.lit(_signed(sum(1 << b for b in bits)))
    rows = fps.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(number(m)) for m in masks])).alias("path", "key"))
    while True:
        last = len(masks) * (distance + 1) > PATHS

        def run(batches):
            held: list[np.ndarray] = []  # the group that goes on in the next batch
            large = None  # (path, key) of a group whose members come back

            def whole(a):
                return [(x, y, np.full(len(x), -1)) for x, y in near_pairs(a[0], a[1], a[2].view(np.uint64), distance)]

            for batch in batches:
                a = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("path", "key", "fp")])
                a = np.concatenate([*held, a], axis=1)
                change = np.flatnonzero((np.diff(a[0]) != 0) | (np.diff(a[1]) != 0)) + 1
                edges = np.concatenate([[0], change, [a.shape[1]]])
                out, begin = [], edges[:-1]
                size = np.diff(edges)
                back = (size > group) & (not last)
                if large is not None and len(begin) and (a[0, 0], a[1, 0]) == large:
                    back[0] = True
                large = (a[0, -1], a[1, -1]) if a.shape[1] and back[-1] else None
                done = np.ones(len(begin), bool)
                done[-1:] = False
                keep = np.repeat(done & ~back & (size > 1), size)
                out += whole(a[:, keep])
                gone = np.repeat(back, size)
                out.append((a[2, gone].view(np.uint64), a[1, gone].view(np.uint64), a[0, gone]))
                held = [a[:, begin[-1]:]] if len(begin) and not back[-1] else []
                yield rows_of(out)
            if held:
                yield rows_of(whole(held[0]))

        def rows_of(out):
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32))], names=["a", "b", "path"])

        made = cut(rows.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, "a long, b long, path int"))
        found.append(made.filter("path < 0").select("a", "b"))
        rest = made.filter("path >= 0")
        if last or not rest.take(1):
            break
        parts = [_cuts([b for b in range(64) if b not in m], distance + 1) for m in masks]
        masks = [m + p for m, ps in zip(masks, parts) for p in ps]
        extra = F.array(*[F.array(*[number(p) for p in ps]) for ps in parts])
        rows = rest.select(F.col("a").alias("fp"), F.col("b").alias("key"), "path", F.posexplode(F.element_at(extra, F.col("path") + 1)).alias("part", "mask"))
        rows = rows.select("fp", (F.col("path") * (distance + 1) + F.col("part")).cast("int").alias("path"), F.col("key").bitwiseOR(fp.bitwiseAND(F.col("mask"))).alias("key"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (its component's smallest node) of edges (a, b), by alternating large-star and small-star."""
    def least(e):
        return e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    def mark(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges, before = cut(edges.filter("a <> b").distinct()), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = low.join(least(low), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct())
        after = mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the class) of every row."""
    prints = cut(fingerprints(docs, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), distance))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = joined.join(least, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_prints(docs: DataFrame) -> DataFrame:
    """text_id and the fingerprints fp0, fp1 of the different words of every row's text."""
    def run(batches):
        known: dict[bytes, bytes] = {}
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                if len(known) > 1_000_000:
                    known.clear()
                out = np.zeros((len(parts), 2), np.uint64)
                for i, t in enumerate(parts):
                    words = set(t.lower().split())
                    if words:
                        for w in words:
                            if w not in known:
                                known[w] = digest(w)
                        bits = np.unpackbits(np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint8).reshape(-1, 16), axis=1, bitorder="little")
                        out[i] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(words), bitorder="little").view(np.uint64)
                fps = out.view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("text_id"), pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy())], names=["text_id", "fp0", "fp1"])
    return docs.select("text_id", "text").mapInArrow(run, "text_id binary, fp0 long, fp1 long")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles of a text."""
    digest, ws = xxhash.xxh3_64_intdigest, text.lower().split()
    grams = map(b" ".join, zip(*(ws[k:] for k in range(width)))) if len(ws) >= width else [b" ".join(ws)] if ws else []
    return np.unique(np.array([digest(g) for g in grams], np.uint64))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """text_id, shingles: the sorted 64-bit hashes of the different shingles, as bytes."""
    def run(batches):
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                made = [shingle_hashes(t, width).tobytes() for t in parts]
                yield pa.RecordBatch.from_arrays([rows.column("text_id"), pa.array(made, pa.binary())], names=["text_id", "shingles"])
    return texts.select("text_id", "text").mapInArrow(run, "text_id binary, shingles binary")


def frequent_shingles(texts: DataFrame, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several of a sample of the texts hold, and their numbers of texts. Only an order is made of them."""
    share = int(min(1.0, SAMPLE / max(1, count)) * 1_000_000)
    some = texts.filter(F.pmod(F.xxhash64("text_id"), F.lit(1_000_000)) < share)

    def run(batches):
        for batch in batches:
            for _, parts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_hashes(t, width) for t in parts]).view(np.int64))], names=["shingle"])
    some = some.groupBy("text_id").agg(F.first("text").alias("text"))
    rows = (some.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
            .orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow())
    h, n = (rows.column(c).to_numpy() for c in ("shingle", "n"))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def rare_shingles(texts: DataFrame, least: float, width: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """shingle, id, label, place of the shingles of which texts (text_id, text, root) that reach `least` share one at least.

    All texts put their shingles into one order, those of few texts first. Sets x and y that reach `least` have
    least * |x| in common, so the first |x| - ceil(least * |x|) + 1 of x hold one of the common ones, and those of y the same
    one. id and label are the first eight bytes of text_id and root, place is the size of the set and the shingle's place.
    """
    known, number = frequent

    def run(batches):
        for batch in batches:
            for rows, parts in slices(batch, "text"):
                out = []
                ids, roots = rows.column("text_id").to_pylist(), rows.column("root").to_pylist()
                for text_id, root, t in zip(ids, roots, parts):
                    h = shingle_hashes(t, width)
                    if not len(h):
                        continue  # all texts without words have fingerprint zero and are linked by it
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.argsort(np.where(known[at] == h, number[at], 0), kind="stable")]
                    n = len(h) - int(np.ceil(least * len(h) - SLACK)) + 1
                    row = np.empty((4, n), np.int64)
                    row[0] = h[:n].view(np.int64)
                    row[1] = int.from_bytes(text_id[:8], "big", signed=True)
                    row[2] = int.from_bytes((root or text_id)[:8], "big", signed=True)
                    row[3] = (len(h) << 32) + np.arange(n)
                    out.append(row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["shingle", "id", "label", "place"])
    return texts.select("text_id", "text", "root").mapInArrow(run, "shingle long, id long, label long, place long")


def shared_pairs(group: np.ndarray, ids: np.ndarray, label: np.ndarray, place: np.ndarray, side: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids of one group whose labels differ and that can still reach `least`.

    Where a pair's first common shingle stands, what follows it in both sets must suffice. Rows with side 0 meet all rows
    of their group, those with 1 and 2 the other side.
    """
    if not len(ids):
        return []
    size, at = place >> 32, place & 0xFFFFFFFF
    _, g = np.unique(group, return_inverse=True)
    order = np.lexsort((size, g))
    g, ids, label, size, at, side = g[order], ids[order], label[order], size[order], at[order], side[order]
    key = (g << 33) + size
    stop = np.searchsorted(key, (g << 33) + np.minimum(np.floor(size / least + SLACK).astype(np.int64), (1 << 33) - 1), "right")
    count = stop - np.arange(len(ids)) - 1
    ends, out, begin = np.cumsum(count), [], 0
    while begin < len(ids):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        i = np.repeat(np.arange(begin, end), count[begin:end])
        j = spans(np.arange(begin, end) + 1, count[begin:end])
        need = np.ceil(least / (1 + least) * (size[i] + size[j]) - SLACK)
        keep = (label[i] != label[j]) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= need) & ((side[i] == 0) | (side[i] != side[j]))
        out.append((np.minimum(ids[i[keep]], ids[j[keep]]), np.maximum(ids[i[keep]], ids[j[keep]])))
        begin = end
    return out


def shared_links(rare: DataFrame, least: float, group: int = NEAR_GROUP) -> DataFrame:
    """Pairs (a, b) of ids that share a row's shingle, whose labels differ and that can reach `least`.

    Rows are sorted by shingle, and a task reads group after group. The members of a larger group come back, are cut
    into pages, and every two pages meet on their own.
    """
    def meet(rows: DataFrame, on: list[str], last: bool) -> DataFrame:
        def run(batches):
            held = np.empty((5 + len(on), 0), np.int64)  # the group that goes on in the next batch
            large = None  # key of a group whose members come back

            def pairs(a):
                number = np.cumsum(np.concatenate([[0], (np.diff(a[5:]) != 0).any(axis=0)])) if a.shape[1] else a[0]
                return [(x, y, np.zeros_like(x), np.zeros_like(x), np.full(len(x), -1)) for x, y in shared_pairs(number, *a[1:5], least)]

            def rows_of(out):
                cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 5
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols[:4]] + [pa.array(cols[4].astype(np.int32))], names=["a", "b", "label", "place", "kind"])

            for batch in batches:
                a = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "id", "label", "place", "side", *on)])
                a = np.concatenate([held, a], axis=1)
                if not a.shape[1]:
                    continue
                begin = np.concatenate([[0], np.flatnonzero((np.diff(a[5:]) != 0).any(axis=0)) + 1])
                size = np.diff(np.concatenate([begin, [a.shape[1]]]))
                back = (size > group) & (not last)
                if large is not None and tuple(a[5:, 0]) == large:
                    back[0] = True
                large = tuple(a[5:, -1]) if back[-1] else None
                keep = ~back & (size > 1)
                keep[-1] = False
                out = pairs(a[:, np.repeat(keep, size)])
                gone = np.repeat(back, size)
                out.append((a[0, gone], a[1, gone], a[2, gone], a[3, gone], np.zeros(int(gone.sum()), np.int64)))
                held = a[:, :0] if back[-1] else a[:, begin[-1]:]
                yield rows_of(out)
            if held.shape[1] > 1:
                yield rows_of(pairs(held))
        return cut(rows.repartition(*on).sortWithinPartitions(*on).mapInArrow(run, "a long, b long, label long, place long, kind int"))

    made = meet(rare.withColumn("side", F.lit(0)).withColumn("key", F.col("shingle")), ["key"], False)
    found, rest = made.filter("kind < 0").select("a", "b"), made.filter("kind >= 0").select(F.col("a").alias("shingle"), F.col("b").alias("id"), "label", "place")
    if rest.take(1):
        pages = rest.groupBy("shingle").agg(F.ceil(F.count("*") / F.lit(max(1, group // 2))).alias("pages"))
        rows = rest.join(pages, "shingle").withColumn("own", F.pmod(F.xxhash64("id"), F.col("pages")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        rows = rows.select("shingle", "id", "label", "place", side.alias("side"), F.col("shingle").alias("key"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        found = found.unionByName(meet(rows, ["key", "low", "high"], True).select("a", "b"))
    return found.distinct()


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, distance: int = 5) -> DataFrame:
    """Pairs (a, b) of text_ids that connect the texts whose sets of shingles have a Jaccard similarity of `least` or more.

    docs: text_id (equal for equal texts), text. Where either fingerprint differs in `distance` bits at most, pairs are
    compared and connected first; then all pairs that are not connected yet and share one of their rare shingles, so none is left out.
    """
    prints = cut(word_prints(docs).groupBy("text_id").agg(F.first("fp0").alias("fp0"), F.first("fp1").alias("fp1")))
    found = []
    for fp in ("fp0", "fp1"):
        own = prints.select("text_id", F.col(fp).alias("fp"))
        nodes = own.groupBy("fp").agg(F.min("text_id").alias("first"))
        edges = near_links(nodes.select("fp"), distance)
        found.append(edges.join(nodes.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
                     .join(nodes.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y"))
        found.append(own.join(nodes, "fp").filter("text_id > first").select(F.col("text_id").alias("x"), F.col("first").alias("y")))
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    edges = cut(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    release(docs)
    roots = cut(components(similar(edges, docs, least, width)))
    release(docs)

    texts = docs.groupBy("text_id").agg(F.first("text").alias("text"))
    frequent = frequent_shingles(docs, width, prints.count())
    release(docs)
    rare = rare_shingles(texts.join(roots.withColumnRenamed("node", "text_id"), "text_id", "left"), least, width, frequent)
    short = shared_links(rare, least)
    release(docs)
    ids = prints.select("text_id", number_of("text_id").alias("id"))
    more = short.join(ids.select(F.col("id").alias("a"), F.col("text_id").alias("x")), "a").join(ids.select(F.col("id").alias("b"), F.col("text_id").alias("y")), "b")
    more = similar(cut(more.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))), docs, least, width)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def number_of(text_id: str):
    """The first eight bytes of a text_id as a signed long."""
    return F.conv(F.hex(F.substring(text_id, 1, 8)), 16, -10).cast("long")


def similar(edges: DataFrame, docs: DataFrame, least: float, width: int) -> DataFrame:
    """Those of the pairs (a, b) of text_ids whose sets of shingles have a Jaccard similarity of `least` or more."""
    named = edges.select(F.explode(F.array("a", "b")).alias("text_id")).distinct()
    sets = cut(shingle_sets(docs.join(named, "text_id").groupBy("text_id").agg(F.first("text").alias("text")), width))
    release(docs)

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = edges.join(sets.select(F.col("text_id").alias("a"), F.col("shingles").alias("sa")), "a")
    pairs = pairs.join(sets.select(F.col("text_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return pairs.select("a", "b", "sa", "sb").mapInArrow(compare, "a binary, b binary")


def one_of_each(docs: DataFrame, least: float = 0.8, width: int = 5, distance: int = 5) -> DataFrame:
    """The documents without copies and near copies: of each class the row with the smallest doc_id stays."""
    fields = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*fields).alias("row"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    roots = cut(components(near_copies(rows.select("text_id", "text"), least, width, distance)))
    release(docs)
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    ids = rows.select("text_id", rank.alias("rank")).groupBy("text_id").agg(F.min("rank").alias("rank"))
    ranked = members.join(ids, members["node"] == ids["text_id"]).select("node", "root", F.struct("rank", "node").alias("rank"))
    stay = ranked.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.node").alias("text_id"))
    gone = members.select(F.col("node").alias("text_id")).join(stay, "text_id", "left_anti")
    # Copies meet in the partial aggregate already; the smallest row of each text goes on.
    order = F.struct(rank, F.xxhash64(*[f"row.c{i}" for i, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind]))
    first = rows.groupBy("text_id").agg(F.min_by("row", order).alias("row"))
    return first.join(gone, "text_id", "left_anti").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
