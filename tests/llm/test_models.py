"""Toxicity, the n-gram model and decontamination against direct computation and held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import decontam, kneser, queries, toxicity


def direct_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition: a function of (context, token) to a probability."""
    tokens = [t.encode().lower().split() + ["end"] for t in texts]
    grams = {order: Counter()}
    for ws in tokens:
        full = ["start"] * (order - 1) + ws
        grams[order].update(tuple(full[i:i + order]) for i in range(len(ws)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    known = {w for ws in tokens for w in ws}
    cuts, follow = {}, {n: defaultdict(list) for n in grams}
    for n, g in grams.items():
        c = [sum(v == k for v in g.values()) for k in (1, 2, 3, 4)]
        cuts[n] = [0, *kneser.discounts(c)]
        for k, v in g.items():
            follow[n][k[:-1]].append(v)

    def p(context, w, n=order):
        if n == 0:
            return 1 / (len(known) + 1)
        context = tuple(context[len(context) - n + 1:]) if n > 1 else ()
        below = p(context[1:], w, n - 1)
        seen = follow[n].get(context)
        if not seen:
            return below
        c, d = grams[n].get((*context, w), 0), cuts[n]
        return (c - d[min(c, 3)]) / sum(seen) + sum(d[min(v, 3)] for v in seen) / sum(seen) * below
    return p, known, Counter(w for ws in tokens for w in ws)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_equals_definition(spark, docs_of, monkeypatch, order):
    monkeypatch.setattr(kneser, "SHARD_CHARS", 3000)
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 200)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "unseen words only\x0bhere"), (None, "w1 w2"), (0, rows[0][1])]
    docs = docs_of(rows).select("doc_id", "text")
    train = [t or "" for d, t in rows if d is None or d % 7]
    model = kneser.train(docs.filter("doc_id is null or doc_id % 7 <> 0"), order)
    p, known, counts = direct_model(train, order)
    n = sum(counts.values())
    assert (model.tokens, model.words) == (n, len(known))
    want = []
    for d, t in rows:
        ws = (t or "").encode().lower().split() + ["end"]
        full = ["start"] * (order - 1) + ws
        s = sum(math.log10(p(full[i:i + order - 1], w)) for i, w in enumerate(ws))
        base = sum(math.log10((counts[w] + 1) / (n + len(known) + 1)) for w in ws)
        want.append((-1 if d is None else d, len(ws), sum(counts[w] > 0 for w in ws), base, s))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser.score(docs, model).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)
    # Over all known tokens and the unknown one a context's probabilities add up to one.
    some = ["start"] * (order - 1)
    assert sum(p(some, w) for w in [*known, "?"]) == pytest.approx(1)


def test_model_without_text(docs_of):
    model = kneser.train(docs_of([]).select("doc_id", "text"))
    assert kneser.score(docs_of([]).select("doc_id", "text"), model).collect() == []
    r = kneser.score(docs_of([(1, "a b")]).select("doc_id", "text"), model).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)


def test_model_beats_base_on_held_out(spark):
    rows = queries.QUERIES["op5_kneser_ney"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows)


def test_toxicity_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op3_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02 and np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_odd_rows(spark, docs_of):
    rows = [(i, f"plain words number {i} and more of them") for i in range(60)] + [(100 + i, f"you stupid idiot, number {i}, what a loser") for i in range(20)]
    rows += [(200, None), (201, ""), (None, "you pathetic moron, you idiot"), (202, "nice " * 50_000), (0, "repeated id"), (203, "the idiotically named place")]
    labels = spark.createDataFrame([(i, None, int(i >= 100)) for i in range(120)] + [(None, 1, 1), (5, 0, None), (7, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows).withColumn("score", F.lit(3)).withColumn("toxic", F.lit(1))
    model = toxicity.train(docs, toxicity.training_labels(labels))
    got = [(r.doc_id, r.score) for r in toxicity.scored(docs, model).collect()]
    assert len(got) == len(rows)
    assert all((s >= 0.7) == (d is None or 100 <= d < 200) for d, s in got)
    alone = toxicity.train(docs, labels.limit(0))
    assert sum(r.score >= 0.7 for r in toxicity.scored(docs, alone).collect()) == 21
    assert toxicity.scored(docs_of([]), model).collect() == []
    toxicity.train(docs_of([]), labels)


def direct_similarity(part, words):
    """Smith-Waterman cell by cell."""
    before, best = [0] * (len(words) + 1), 0
    for a in part:
        now = [0]
        for j, b in enumerate(words, 1):
            now.append(max(0, before[j - 1] + (2 if a == b else -1), before[j] - 1, now[j - 1] - 1))
        before, best = now, max(best, max(now))
    return best / (2 * len(part))


def test_alignment_equals_definition():
    rng = np.random.default_rng(5)
    pairs = [(rng.integers(0, 6, rng.integers(3, 30)), rng.integers(0, 6, rng.integers(1, 60))) for _ in range(80)]
    assert decontam.align(pairs) == pytest.approx([direct_similarity(a.tolist(), b.tolist()) for a, b in pairs])


def parts_of(words, width=decontam.PART):
    return [words[at:at + width] for at in range(0, max(1, len(words) - width // 2), width // 2) if len(words[at:at + width]) >= 2]


def direct_matches(docs, items, least):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    return {(d, i) for d, t in docs for i, q in items if d is not None and i is not None
            and any(direct_similarity(p, words(t)) > least + 0.5 / len(p) for p in parts_of(words(q)))}


def test_matches_of_sample(sample):
    docs, items = sample("documents"), sample("benchmark")
    some = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()}
    assert got == direct_matches(some, [(r.item_id, r.text) for r in items.collect()], decontam.LEAST) and got


def test_groups_of_edited_copies(spark, docs_of):
    """Equal copies of an edited item leave its other seeds in no document, and the rest in many."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 40, 60])]
    rows = []
    for i, t in items:
        edited = " ".join(w if (k + 1) % (4 + i % 2) else word() for k, w in enumerate(t.split()))  # every fourth or fifth word replaced
        rows += [(len(rows) + k, f"{word()} {word()} {edited} {word()}") for k in range(30)]
    rows += [(1000, items[1][1]), (1001, " ".join(items[2][1].split()[:20])), (1002, " ".join(word() for _ in range(90)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs_of(rows), bench).collect()}
    assert got == direct_matches(rows, items, decontam.LEAST) and len(got) == 91


@pytest.mark.parametrize("seed_rows", [1_000_000, 40])
def test_no_edit_is_lost(spark, docs_of, monkeypatch, seed_rows):
    """Every second or third word replaced, left out or followed by another one, in items of words that all texts share:
    the same pairs as by direct alignment, also with the seeds in several blocks."""
    monkeypatch.setattr(decontam, "SEED_ROWS", seed_rows)
    rng = np.random.default_rng(11)
    word = lambda: f"w{min(int(rng.zipf(1.3)), 400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([6, 9, 14, 23, 40, 64, 90])]
    rows = []
    for _, t in items:
        ws = t.split()
        for step in (1, 2, 3, 4):
            for kind in range(4):
                v = [x for k, w in enumerate(ws) for x in ([w] if k % step else [[word()], [], [w, word()], [w, word(), word()]][kind])]
                rows.append((len(rows), " ".join(word() for _ in range(rng.integers(0, 60))) + " " + " ".join(v) + " " + " ".join(word() for _ in range(rng.integers(0, 60)))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    odd = docs_of(rows).withColumn("similarity", F.lit(1)).withColumn("gram", F.lit("g")).withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in decontam.matches(odd, bench).collect()}
    want = direct_matches(rows, items, decontam.LEAST)
    assert got == want and len(want) > 40


def test_a_seed_that_all_items_share(spark, docs_of):
    """A pair of words in 3,000 items and all documents finds nothing by itself."""
    items = [(i, f"which of the following a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(3000)]
    rows = [(i, f"which of the following x{i} y{i} " * 5) for i in range(100)] + [(200, items[77][1]), (201, "so which of the following a5 b5 q c5 d5 e5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs_of(rows), bench).collect()} == {(200, 77), (201, 5)}


def test_edited_copies(spark, docs_of):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 30, 64, 65, 150, 400])]
    rows, want = [], set()
    for i, t in items:
        ws = t.split()
        edited = [w if k % 5 else word() for k, w in enumerate(ws)]  # every fifth word replaced
        less = [w for k, w in enumerate(ws) if k % 6]  # every sixth left out
        more = [x for k, w in enumerate(ws) for x in ([w, word()] if k % 6 == 0 else [w])]
        for k, v in enumerate((ws, edited, less, more)):
            around = [word() for _ in range(300)]
            rows.append((10 * i + k, " ".join(around[:7 * k]) + " " + ", ".join(v).upper() + ". " + " ".join(around[7 * k:])))
            want.add((10 * i + k, i))
    # A passage that very many documents hold is found in each of them.
    rows += [(1000 + k, f"{word()} {word()} {items[1][1]} {word()}") for k in range(200)]
    want |= {(1000 + k, 1) for k in range(200)}
    rows += [(2000 + k, " ".join(word() for _ in range(200))) for k in range(30)] + [(3000, None), (3001, ""), (None, items[0][1]), (3002, "z " * 30_000)]
    bench = spark.createDataFrame([*items, (0, items[0][1]), (90, "two words"), (91, None), (None, "a b c d"), (92, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(docs_of(rows), bench).collect()}
    assert set(got) == want and all(0.5 < s <= 1 for s in got.values())
    left = {r.doc_id for r in decontam.decontaminated(docs_of(rows), bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.matches(docs_of([]), bench).collect() == [] and decontam.matches(docs_of(rows), bench.limit(0)).collect() == []
