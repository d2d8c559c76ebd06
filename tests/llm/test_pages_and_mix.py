"""HTML extraction, mixing and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from near_copies_direct import direct_near_classes, kept_by
from tidegauge.llm import decontam, html, mixing, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
P = "This paragraph goes on for quite a number of words, as a paragraph of an article would, and then it ends. " * 2
SITE = "<nav><a href=/>Home</a> <a href=/x>About us</a></nav>"


def text(spark, page):
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    row = html.extract(df).first()
    assert row.n_chars == len(row.text)
    return row.text


@pytest.mark.parametrize("page, want", [
    (f"{SITE}<article><h1>Title</h1><p>{P}</p><p>Ok.</p><p>Tom &amp; J&#233;r&ocirc;me &lt;3 &am</p></article><footer>&copy; us</footer>",
     f"Title\n{P.strip()}\nOk.\nTom & Jérôme <3 &am"),
    (f"<head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><!-- <p>no</p> --><article><p><b>One\n\t two<br>three</b><p>{P}",
     f"One two three\n{P.strip()}"),
    (f"<div class='cookie-notice'>We use cookies {P}</div><main><p>{P}</p><form><p>{P}</p></form></main><aside><p>{P}</p></aside>", P.strip()),
    (f"<article><p>{P}</p></article><section id=comments><h2>Comments</h2><article><p>{P}</p></article></section>", P.strip()),
    (f"<div id=header><a>x</a></div><div><h1>A title of the page</h1><p>{P}</p><p>{P}</p></div><div id=footer>Some words</div>", f"A title of the page\n{P.strip()}\n{P.strip()}"),
    (f"<div class=ad>Buy this<article><p>{P}</p></article>", P.strip()),
    ("", ""), (None, ""), ("<script>never ends <p>x</p>", ""), ("<p class=\"a>b", ""), ("<nav><a>x</a></nav>", "")])
def test_extracted(spark, page, want):
    assert text(spark, page) == want


LONG = "word " * 40


@pytest.mark.parametrize("page, kept", [
    (f"<article class='post type-post category-x tag-y'><p>here {LONG}</article>", ["here"]),
    (f"<main class=has-sidebar><p>here {LONG}</main><div class=sidebar><p>gone {LONG}</div>", ["here"]),
    (f"<article><header class=entry-header><h1>title of it</h1></header><p>here {LONG}</article>", ["title of it", "here"]),
    (f"<article><p>here {LONG}<div class=legal-analysis><p>there {LONG}</div></article>", ["here", "there"]),
    (f"<article><p>here <svg width=1 /> {LONG}<p>there {LONG}<svg><text>gone</text></svg></article>", ["here", "there"]),
    (f"<article><p>here <math><mi>x</mi><mo>=</mo><mn>7</mn></math> {LONG}</article>", ["here", "x=7"]),
    (f"<article><p>here {LONG}<section class=comments><article class=comment><p>gone {LONG}</article></section></article>", ["here"])])
def test_ordinary_markup(page, kept):
    text = html.main_text(f"<body><nav><a>gone</a></nav>{page}<footer>gone</footer></body>", html.fit())
    assert all(k in text for k in kept) and "gone" not in text


@pytest.mark.parametrize("name", ["elementor-widget-container", "article-body ad-free", "post-content social-sharing-on", "layout-sidebar-right", "page-with-comments",
                                  "nav-closed", "modal-open", "content widget", "reply", "comment-free", "menu-item-page"])
@pytest.mark.parametrize("outside", ["{}", "<main>{}</main>", "<div id=page>{}</div><div class=related><p><a>gone</a></div>"])
def test_names_are_no_veto(name, outside):
    inside = f"<div class='{name}'><h1>title of it</h1><p>here {LONG}<p>there {LONG}<p>and a short one</div>"
    text = html.main_text(f"<body><nav><a>gone</a></nav>{outside.format(inside)}<footer>gone</footer></body>", html.fit())
    assert all(k in text for k in ("title of it", "here", "there", "and a short one")) and "gone" not in text


@pytest.mark.parametrize("open_tag", ["<button>Menu", "<svg viewBox=0>", "<select><option>gone", "<noscript>", "<button>Menu<button>More"])
@pytest.mark.parametrize("later", ["", "<button>gone</button>"])
def test_open_raw_elements_do_not_eat_the_page(open_tag, later):
    page = f"<body>{open_tag}<article><p>here {LONG}<p>there {LONG}</article>{later}</body>"
    text = html.main_text(page, html.fit())
    assert "here" in text and "there" in text and "gone" not in text


def test_tree_asks_density_and_neighbours():
    asked = set()

    def walk(node):
        if node.feature >= 0:
            asked.add(html.FEATURES[node.feature])
            walk(node.yes)
            walk(node.no)
    walk(html.fit())
    assert {"link_density", "words", "words_before", "words_after"} <= asked


def test_pages_of_sample(spark, sample):
    """The given pages mark their main text with one article element; its blocks end at block-level tags."""
    import html as entities
    got = {r.page_id: r for r in html.extract(sample("pages")).collect()}
    for r in sample("pages").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].url == r.url


def test_long_page_and_rows(spark):
    body = "".join(f"<p>{P} number {i}</p>" for i in range(5000))
    pages = spark.createDataFrame([(1, "u", f"<article>{body}</article>", 1), (1, "u", None, 2), (None, None, "<b>x", 3)], "page_id long, url string, html string, text long")
    rows = html.extract(pages).collect()
    assert sorted(len(r.text.split("\n")) for r in rows) == [1, 1, 5000]
    assert html.extract(pages.limit(0)).collect() == []


def test_tree_fits_its_table():
    tree = html.fit()
    for page in html.LABELLED:
        found = html.blocks(re.sub(r"([+-])([LS])\b", lambda m: m[1] + html.WORDS[m[2]], page))
        assert html.answer(tree, html.features(found)).tolist() == [b.text[0] == "+" for b in found]


def direct_targets(rows, weights=(1, 2, 3), most=3):
    """The excess over the caps is shared again by weight until no source is above its cap."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORDS.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left = {}, dict(weight)
    total = sum(size.values())
    while True:
        rest = total - sum(fixed.values())
        now = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = {s for s in now if now[s] > most * size[s]}
        if not over:
            return size, fixed | now
        fixed |= {s: most * size[s] for s in over}
        left = {s: w for s, w in left.items() if s not in over}


def mixed_rows():
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.integers(0, 60))), "hot") for i in range(300)]
    rows += [(1000 + i, "a b\x0bc\td" * int(rng.integers(1, 9)), s) for i, s in enumerate(["b", "é", "Z", None, "b", "tiny", "", "n", "snow"] * 12)]
    return rows + [(2000, "word", "one"), (2001, None, "none"), (2002, "x " * 5000, "long"), (2002, "x " * 5000, "long"), (2003, "", None), (None, "p q r", "b"), (5, "other text", "b")]


@pytest.mark.parametrize("block_words, shard_blocks", [(64, 7), (4096, 256), (10, 1)])
def test_mix(docs_of, block_words, shard_blocks):
    rows = mixed_rows()
    size, target = direct_targets(rows)
    pieces = mixing.mix(docs_of(rows), block_words=block_words, shard_blocks=shard_blocks).cache()
    got = mixing.taken(pieces).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(WORDS.findall(t or ""))) for d, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    # Shards: places are 0 gaps, blocks are drawn once, and quotas are spread over the shards as drawn.
    drawn = pieces.filter("shard is not null").collect()
    assert len({(p.source, p.block) for p in drawn}) == len({(p.source, p.block, p.shard) for p in drawn})
    places = {}
    for p in drawn:
        places.setdefault(p.shard, []).append(p.place)
        assert 0 < p.words <= block_words and 0 <= p.from_word and p.from_word + p.words <= p.size
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values())
    blocks = Counter(s for s, _ in {(p.shard, (p.source, p.block)) for p in drawn})
    assert max(blocks.values()) - min(blocks.values()) <= 1
    again = mixing.mix(docs_of(rows, 7), block_words=block_words, shard_blocks=shard_blocks)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(pieces) == key(again)


def test_pieces_have_their_words(docs_of):
    rows = mixed_rows()
    docs = docs_of(rows)
    words = {(d, s): WORDS.findall(t or "") for d, t, s in rows}
    some = 0
    for p in mixing.piece_texts(mixing.mix(docs, block_words=64), docs).collect():
        assert WORDS.findall(p.text) == words[p.doc_id, p.source][p.from_word:p.from_word + p.words]
        some += p.words < p.size
    assert some


def test_mix_without_words(docs_of):
    assert mixing.mix(docs_of([])).collect() == []
    got = mixing.taken(mixing.mix(docs_of([(1, None, "a"), (2, "", None), (2, "", None)]))).collect()
    assert sorted((r.doc_id, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_hypergeometric_draws(spark):
    """Against the distribution's own probabilities, and its ends."""
    from math import comb
    good, bad, draws, n = 7, 9, 6, 20_000
    one = mixing.hypergeometric(str(good), str(bad), str(draws), "(id + 0.5D) / 20000D")
    got = Counter(r[0] for r in spark.range(n).selectExpr(f"{one} AS x").collect())
    for k in range(draws + 1):
        assert got[k] / n == pytest.approx(comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws), abs=1e-3)
    big = spark.range(1000).selectExpr(f"{mixing.hypergeometric('1000000L', '3000000L', '2000000L', '(id + 0.5D) / 1000D')} AS x").agg(F.avg("x"), F.stddev("x")).first()
    assert big[0] == pytest.approx(500_000, abs=5) and big[1] == pytest.approx(433, rel=0.02)
    for case, want in ((("0", "5", "3"), 0), (("5", "0", "3"), 3), (("4", "4", "8"), 4), (("4", "4", "0"), 0), (("0", "0", "0"), 0)):
        assert spark.range(1).selectExpr(f"{mixing.hypergeometric(*case, '0.999D')} AS x").first()[0] == want


def test_tree_adds_up(spark):
    quotas = spark.createDataFrame([([100, 1, 0, 57, 3000],)], "quotas array<bigint>")
    for shards in (1, 2, 7, 64):
        leaves = mixing.split_tree(quotas, shards, 1).collect()
        assert sorted(r.shard for r in leaves) == list(range(shards))
        assert np.sum([r.quotas for r in leaves], axis=0).tolist() == [100, 1, 0, 57, 3000]
        sums = [sum(r.quotas) for r in leaves]
        assert min(min(r.quotas) for r in leaves) >= 0 and max(sums) - min(sums) <= 1


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a direct computation on its own input."""
    folder = "/root/testdata/sf0.001"
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        outs.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = outs[-1][1]
    assert all(o.columns == corpus_pipeline.COLUMNS for _, o in outs[:-1])
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    (raw, kept), (_, lined), (_, single), (_, clean), (_, mixed) = outs
    model = toxicity.train(raw, toxicity.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    assert set(read(kept)) == {r.doc_id for r in toxicity.scored(raw, model).collect() if r.score < 0.7}
    assert set(read(lined)) == set(read(kept)) and all(r.n_chars == len(r.text) for r in lined.collect())
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    want, got = {d for d, _ in kept_by(rows, direct_near_classes([t for _, t in rows]))}, set(read(single))
    assert want <= got and len(rows) - len(got) >= 0.95 * (len(rows) - len(want))
    held = {r.doc_id for r in decontam.matches(single, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert set(read(clean)) == set(read(single)) - held
    size, target = direct_targets([(r.doc_id, r.text, r.source) for r in clean.collect()])
    words = Counter()
    for r in mixed.collect():
        assert len(WORDS.findall(r.text)) == r.words
        words[r.source] += r.words
    assert all(abs(words[s] - t) <= 0.5 for s, t in target.items())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.select(whole.columns).collect()))


def test_stages_on_an_empty_table(spark, docs_of):
    folder = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), folder).collect() == []
