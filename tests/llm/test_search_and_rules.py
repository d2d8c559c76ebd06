"""Top-k search and URL rules against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import topk, urls

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, step):
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for q, v in good:
        if q % step == 0:
            best = sorted(((-int((v * w).sum()), i) for i, w in good if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k=10, step=100, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("id") % step == 0, k=k, **options).collect())


@pytest.mark.parametrize("block", [4096, 40])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows is one vector: ties and a hot cell
    rows += [(5000 + i, (30 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(3)]  # long vectors win by their norm
    assert run(spark, rows, step=50, block=block) == brute(rows, 10, 50)


def spread_vectors(seed, n, width=6):
    """Vectors whose norms go the farther from each other, the larger the seed."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)) * np.exp(rng.normal(scale=seed, size=(n, 1)))


def test_norms_far_apart(spark):
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.random.default_rng(4).uniform(-1, 1, (4000, 2)))]
    x = np.array([np.floor(1024 * np.array(v, np.float64)) for _, v in rows])
    want = []
    for q in range(0, 4000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        want += [(q, r, int(i), int(scores[i])) for r, i in enumerate(np.lexsort((np.arange(4000), -scores))[:10], 1)]
    assert run(spark, rows, step=20, block=300) == want


@pytest.mark.parametrize("seed, size", [(0, 1.0), (1, 1e-2), (2, 1.0), (2, 1e6)])
def test_bounds_hold(seed, size):
    x = np.floor(1024 * size * spread_vectors(seed, 2000)).astype(np.int64)
    norms = (x.astype(np.float64) ** 2).sum(axis=1)
    top, anchors = float(norms.max()) * (1 + 1e-12), topk.pick_pivots(x[:500], 24)
    table, q_table = topk.pivot_table(x, anchors, top), topk.query_table(x, anchors, top)
    for q in range(0, 2000, 7):
        bound = topk.score_bound(norms[q], top, np.abs(table - q_table[q]).max(axis=1), x.shape[1])
        assert (bound >= topk.products(x[q], x)).all()


def test_odd_rows(spark):
    rows = [(0, [0.5, 0.25]), (1, None), (2, [0.5, None]), (3, [0.5, float("nan")]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (5, [0.5]), (6, []), (7, [1.0, 1.0, 1.0]), (100, [-0.001, 0.0])]
    assert run(spark, rows) == brute(rows, 10, 100)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e10, 1.0]), (1, [1e5, 3.0]), (2, [1e5, 4.0]), (3, [1e12, 0.0]), (4, [-1e12, 0.0])]
    got = {i: s for _, _, i, s in run(spark, rows)}
    x = [[int(np.floor(1024 * np.float64(np.float32(e)))) for e in v] for _, v in rows]
    exact = {i: sum(a * b for a, b in zip(x[0], x[i])) for i in range(1, 5)}
    assert got == {i: min(max(e, -2 ** 63), 2 ** 63 - 1) for i, e in exact.items()}


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 7, 1), (1, [2.0], 7, 1)], "vec_id long, embedding array<float>, id int, score int")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def verdicts(spark, pages, rules=RULES):
    df = spark.createDataFrame(pages, "page_id long, url string")
    rs = spark.createDataFrame(rules, "host string, path string, action string")
    return sorted((tuple(r) for r in urls.judge(df, rs).collect()), key=str)


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("http://A.Example.NET/en/1?q=/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("https://badexample.com/de/x", "badexample.com", "/de/x", None, "allow"),
    ("https://example.com/DE/x", "example.com", "/DE/x", None, "allow"), ("https://x.org/fr/#top", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://net", "net", "", None, "allow"), ("http://a.net?x://b", "a.net", "", None, "allow"), ("nothing", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("://a.net/", "a.net", "/", "net/", "block"), ("x://y://a.net/", "y:", "//a.net/", None, "allow"),
    ("http://É.NET/\n/x", "É.net", "/\n/x", "net/", "block"), ("http://" + "a." * 3000 + "net/" + "p" * 9000, "a." * 3000 + "net", "/" + "p" * 9000, "net/", "block")])
def test_verdict(spark, url, host, path, rule, verdict):
    assert verdicts(spark, [(1, url)]) == [(1, host, path, rule, verdict)]


def test_rows_and_rules(spark):
    pages = [(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/"), (2, None)]
    assert len(verdicts(spark, pages)) == 4
    assert verdicts(spark, [(1, "http://a.net/")], []) == [(1, "a.net", "/", None, "allow")]
    assert verdicts(spark, [], RULES) == []
    both = [("a.b", "/x", "allow"), ("A.B", "/x", "block"), ("b", "/x/yy", "allow"), (None, "/", "block"), ("b", None, "block")]
    assert verdicts(spark, [(1, "http://a.b/x/yy")], both)[0][3:] == ("b/x/yy", "allow")
    assert verdicts(spark, [(1, "http://a.b/x")], both)[0][3:] == ("a.b/x", "block")


def test_short_prefixes_that_collide(spark):
    """With one digit a prefix stands for several rules; only the full digest decides."""
    rules = [(f"h{i}.net", f"/{j}/", "block" if (i + j) % 2 else "allow") for i in range(12) for j in range(4)]
    pages = [(i * 10 + j, f"http://www.h{i}.net/{j}/x") for i in range(14) for j in range(6)]
    df, rs = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string")
    want = sorted(map(str, urls.judge(df, rs, short=15).collect()))
    assert sorted(map(str, urls.judge(df, rs, short=1).collect())) == want
    by = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rs, short=1).collect()}
    assert by == {i * 10 + j: (f"h{i}.net/{j}/", "block" if (i + j) % 2 else "allow") if i < 12 and j < 4 else (None, "allow") for i in range(14) for j in range(6)}
    plan = urls.judge(df, rs)._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join LeftOuter" in x)
    assert "digest" not in join and "short" in join


@pytest.mark.parametrize("asked", [200_000, 0])
def test_blocks_go_to_the_tiles_that_ask(spark, monkeypatch, asked):
    """Several tiles, with the list of what they ask for broadcast and not."""
    monkeypatch.setattr(topk, "TILE", 2)
    monkeypatch.setattr(topk, "ASKED", asked)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (900, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0, k=10, block=64).collect())
    assert got == brute(rows, 10, 100)
