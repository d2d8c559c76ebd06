"""SimHash, substring and line dedup against direct computation."""

import hashlib
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from near_copies_direct import direct_near_classes, kept_by
from tidegauge.llm import lines, simhash, substring
from tidegauge.settings import release

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct_fingerprint(text):
    ws = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def direct_classes(rows, distance=3):
    fps = [direct_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_simhash_of_sample(spark, sample):
    docs = sample("documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.classes(docs).collect()), key=str) == direct_classes(rows)


def test_simhash_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "one"), (None, "one"), (5, "two words"), (None, "lonely text here ok"), (6, "Ä ä"),
            (7, "a\u00a0b c"), (8, "x " * 70_000)]
    assert sorted(map(tuple, simhash.classes(docs_of(rows)).collect()), key=str) == direct_classes(rows)
    assert simhash.classes(docs_of([])).collect() == []


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('ab c d')").first()[0] == np.uint64(xxhash.xxh64_intdigest("ab c d", 42)).astype(np.int64)


@pytest.mark.parametrize("group, distance", [(4, 3), (256, 3), (2, 1), (64, 4)])
def test_links_equal_all_pairs(spark, group, distance):
    """Random fingerprints around a few centres, some in chains; a small group size forces all deeper cuts."""
    rng = np.random.default_rng(3)
    fps = set()
    for c in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        x = int(c)
        for _ in range(60):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                y ^= 1 << int(b)
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {}
    for r in simhash.components(simhash.links(df, distance, group)).collect():
        got[r.node % (1 << 64)] = r.root % (1 << 64)
    parts = {}
    for f in fps:
        parts.setdefault(got.get(f, f), set()).add(f)
    want, left = [], set(fps)
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x = todo.pop()
            part.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            todo += near
        want.append(part)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert got == {i: 0 for i in range(1, 101)} | {501: 500}


def edited(text, rng, share):
    ws = text.split(" ")
    for _ in range(max(1, int(share * len(ws)))):
        i = rng.integers(len(ws))
        ws[i:i + 1] = [[], [f"new{rng.integers(99)}"], [ws[i], "and"]][rng.integers(3)]
    return " ".join(ws)


def test_one_of_each_finds_jaccard_classes(docs_of):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        text = " ".join(f"w{int(x)}" for x in rng.zipf(1.25, rng.integers(80, 500)) % 3000)
        rows.append((1000 - len(rows), text))
        for _ in range(rng.integers(0, 14)):
            rows.append((1000 - len(rows), edited(text, rng, [0.004, 0.01, 0.02, 0.06][rng.integers(4)])))
    rows += [(3, rows[0][1]), (3, "an own text of the same id that nobody else has at all"), (None, rows[5][1]), (None, "x y z"), (4, "X  y z"), (7, None), (8, ""), (9, " \n")]
    classes = direct_near_classes([t for _, t in rows])
    assert len(rows) - 10 > len(set(classes)) > 15
    got = sorted(((r.doc_id, r.text or "") for r in simhash.one_of_each(docs_of(rows)).collect()), key=str)
    want = kept_by(rows, classes)
    assert set(want) <= set(got) and len(got) - len(want) <= 0.05 * (len(rows) - len(want)), (len(rows), len(want), len(got))


def test_one_of_each_sample(spark):
    """Of the sample's pairs of near copies at most one in twenty is missed, and nothing else goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, got = kept_by(rows, direct_near_classes([t for _, t in rows])), sorted(((r.doc_id, r.text or "") for r in simhash.one_of_each(docs).collect()), key=str)
    assert set(want) <= set(got) and len(rows) - len(got) >= 0.95 * (len(rows) - len(want))


def short_texts(rng):
    """Short texts and copies with a word more: their fingerprints differ in many bits."""
    rows = []
    for c in range(60):
        ws = [f"w{int(x)}" for x in rng.integers(0, 4000, rng.integers(9, 40))]
        rows += [(500 - len(rows), " ".join(ws)), (500 - len(rows) - 1, " ".join(["common", *ws])), (500 - len(rows) - 2, " ".join([*ws, "Last"]))]
    return rows + [(900 + k, "the same words begin this text and all others of its kind " + " ".join(f"t{k}x{i}" for i in range(9))) for k in range(40)]


@pytest.mark.parametrize("group", [4096, 2])
def test_one_of_each_leaves_no_copy(docs_of, monkeypatch, group):
    """All classes of direct comparison, also where the shingles' groups are cut into pages."""
    rng = np.random.default_rng(11)
    rows = short_texts(rng)
    rows += [(5000 + i, edited(rows[9][1] + " " + rows[12][1], rng, 0.03)) for i in range(12)]
    meet = simhash.shared_links
    monkeypatch.setattr(simhash, "shared_links", lambda rare, least: meet(rare, least, group))
    got = sorted(((r.doc_id, r.text or "") for r in simhash.one_of_each(docs_of(rows)).collect()), key=str)
    assert got == kept_by(rows, direct_near_classes([t for _, t in rows]))


def test_shared_links_find_all_pairs(spark):
    """Pairs of rare shingles against all pairs, with groups across batches and in pages."""
    rng = np.random.default_rng(3)
    texts = {}
    for c in range(25):
        ws = [f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 400]
        for _ in range(6):
            texts[" ".join(ws)] = None
            ws[rng.integers(len(ws))] = f"n{rng.integers(50)}"
    sets = [simhash.shingle_hashes(t.encode(), 2) for t in texts]
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                want.add((j, i))
    rows = [(int(i).to_bytes(8, "big") + b"x" * 8, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "text_id binary, text string, root binary").repartition(3)
    rare = simhash.rare_shingles(df, 0.8, 2, simhash.frequent_shingles(df, 2, len(rows)))
    for group, batch in ((4096, "10000"), (3, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {(r.a, r.b) for r in simhash.shared_links(rare, 0.8, group).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(want) > 60 and want <= got and len(got) < len(rows) ** 2 / 4, (len(want), len(want - got), len(got))


def test_one_of_each_odd_rows(spark, docs_of):
    # A repeated id with another text keeps that text; columns of any name come through.
    rows = [(5, "text a is the one"), (5, "text b is another"), (1, "text b is another"), (None, None), (None, "c")]
    odd = docs_of(rows).withColumn("text_id", F.lit(1)).withColumn("row", F.lit("r")).withColumn("fp", F.lit(0)).withColumn("root", F.lit(2))
    got = simhash.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted(((r.doc_id, r.text, r["row"]) for r in got.collect()), key=str) == sorted([(5, rows[0][1], "r"), (1, rows[1][1], "r"), (None, None, "r"), (None, "c", "r")], key=str)
    assert simhash.one_of_each(docs_of([])).collect() == []


def test_spanning_pairs():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    a, b = simhash._spanning(fps, 2)
    assert (np.bitwise_count(a ^ b) <= 2).all()
    root = {int(f): int(f) for f in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    for x, y in zip(a.tolist(), b.tolist()):
        root[find(x)] = find(y)
    star = simhash._star(fps, 2)
    assert len({find(int(f)) for f in fps}) == len(set(star.tolist()))


def direct_repeats(rows, window=50):
    starts = {}
    for d, t in rows:
        ws = WORD.findall(t or "")
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if d is not None:
                starts[key] = min(starts.get(key, d), d)
    out = []
    for d, t in rows:
        ws, gone = WORD.findall(t or ""), set()
        for i in range(len(ws) - window + 1):
            if d is not None and starts[tuple(ws[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeats(docs):
    return sorted((tuple(r) for r in substring.remove_repeats(docs).drop("text").collect()), key=str)


def test_repeats_of_sample(sample):
    docs = sample("documents")
    assert repeats(docs) == direct_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("small", [False, True])
def test_repeats_odd_rows(docs_of, monkeypatch, small):
    if small:  # many flushes and chunks
        monkeypatch.setattr(substring, "FLUSH", 2000)
        monkeypatch.setattr(substring, "CHUNK", 700)
    rng = np.random.default_rng(0)
    ws = [f"w{i}" for i in rng.integers(0, 500, 3000)]
    passage = " ".join(ws[:80])
    rows = [(i, " ".join(ws[100 + 20 * i:100 + 20 * i + i]) + " " + passage + "\n" + " ".join(ws[900 + 13 * i:900 + 13 * i + 60])) for i in range(40)]
    rows += [(100, "the " * 300), (101, "the " * 49), (102, "The " + "the " * 50), (103, None), (104, ""), (None, passage), (5, passage), (5, rows[5][1]),
             (200, passage + "\u00a0" + passage), (201, " ".join(ws)), (202, " ".join(ws))]
    assert repeats(docs_of(rows, 4)) == direct_repeats(rows)


def test_repeats_of_empty_table(docs_of):
    assert repeats(docs_of([])) == []


def direct_lines(rows):
    keyed = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for d, ls in keyed:
        for x in ls:
            if len(key(x)) >= 40 and d is not None:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, ls in keyed:
        kept = [x for x in ls if not (d is not None and len(held.get(key(x), ())) >= 5 and d != max(held[key(x)]))]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_odd_rows(docs_of):
    a, b, e = "A line of text that is long enough " * 2, "x" * 40, "é" * 39
    rows = [(i, f"{a}\nown {i}\n  {a.upper()}\t\n{b}") for i in range(1, 6)] + [(6, b), (6, b), (7, None), (8, ""), (9, "\n\n"), (None, a), (None, a)]
    rows += [(20 + i, e) for i in range(6)] + [(30 + i, e + "É\r") for i in range(6)] + [(40, "\n" + b[:39])]
    got = sorted((tuple(r) for r in lines.drop_repeated(docs_of(rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=str)
    assert got == direct_lines(rows)
    assert lines.drop_repeated(docs_of([])).collect() == []


def test_lines_keep_columns(docs_of):
    docs = docs_of([(1, "t", "s")]).withColumn("h1", F.lit(1)).withColumn("n_lines", F.lit(9)).withColumn("drops", F.lit(2))
    assert lines.drop_repeated(docs, keep=("doc_id", "source", "h1")).first().asDict() == {
        "doc_id": 1, "source": "s", "h1": 1, "text": "t", "n_lines": 1, "n_dropped": 0}


@pytest.mark.parametrize("group, paths", [(3, 10_000), (40, 10_000), (256, 10_000), (3, 100)])
def test_near_links_connect_what_all_pairs_connect(spark, monkeypatch, group, paths):
    """A small group size sends members back to be cut again; with few paths the first cut is the last."""
    monkeypatch.setattr(simhash, "PATHS", paths)
    rng = np.random.default_rng(9)
    fps = set(rng.integers(0, 1 << 63, 200).tolist())
    for c in rng.integers(0, 1 << 63, 5).tolist():
        for _ in range(80):
            y = c
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(df, 5, group).collect()]
    assert all((a ^ b).bit_count() <= 5 for a, b in edges)

    def classes_of(pairs):
        root = {f: f for f in fps}
        find = lambda i: i if root[i] == i else find(root[i])
        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))
    assert classes_of(edges) == classes_of([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 5])


def test_files_of_finished_steps_are_released(spark, docs_of, monkeypatch):
    """Shuffles that nothing can read any more leave the disk before the texts are compared by their rare shingles."""
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    numbers = lambda: {int(x) for x in known.keys().mkString(",").split(",") if x}
    rare, seen = simhash.rare_shingles, []

    def checked(*args):
        end = time.time() + 20
        while len(numbers() - before) > 5 and time.time() < end:
            time.sleep(0.2)
        seen.append(len(numbers() - before))
        return rare(*args)

    release(spark.range(1))
    time.sleep(2)
    before = numbers()
    monkeypatch.setattr(simhash, "rare_shingles", checked)
    words = [f"w{i}" for i in range(60)]
    docs = docs_of([(1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (3, "another text")])
    assert simhash.one_of_each(docs).count() == 2 and seen[0] <= 5
