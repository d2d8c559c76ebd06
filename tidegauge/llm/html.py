"""Main text of web pages: flat text blocks, classified by a decision tree.

Method: a page is cut into flat blocks of text at its block-level tags. A block is described by its word count and link
density, those of the blocks before and after it, and by where it stands: in an article or main element or outside of the
page's article; in a container that by its element, role, class or id is called something else (navigation, advert, form,
sidebar ...), or is called comments. What such a name is worth depends on how much the container holds, so a block gets
the share of the page's unlinked words that its smallest container of that kind has, and how many levels up the nearest
one is: a wrapper around most of the text is none, whatever its class says (beside the page's article, a share counts as 0). A decision tree, grown on the small
labelled table below, decides which blocks are main text.

Defined cases: a null html is empty; script, style, textarea and title end at their end tag or, if that is missing, at the
end of the page; other raw text (button, select, svg, noscript ...) is skipped up to its end tag, and where that is missing
or lies behind a paragraph or article, only the tag is; a self-closed svg is empty, math is text but for its annotations;
unclosed and stray tags are tolerated; a line break is white space within its block; repeated rows give one row each; null
ids and urls are kept; columns other than page_id, url and html are not read; an empty table gives an empty result.
Nothing is cut off: a page is as long as it is.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.common import slices

# Comments, empty drawings and raw text whole, then tags, then text.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<(?P<raw>script|style|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.I | re.S)
# Elements whose content is no text of the page, if they end; a paragraph or article inside says that they were left open.
SKIPPED = frozenset("noscript template svg annotation-xml annotation iframe object select button".split())
BEHIND = re.compile(r"<(?:article|main|section|p|h[1-6]|select|button)\b", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
                   "msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
# Elements whose start and end say where a region begins and ends; others only end a block.
REGIONS = frozenset("article main nav header footer aside form div section ul ol dl table figure dialog menu blockquote details fieldset".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|style|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# Parts of a class, id, role or label that tell of something else wherever they stand, and words that do so only as all of it.
HINT = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|footer|masthead|sidebar|widget|social|"
    r"cookies?|consent|popup|modal|newsletter|subscribe|signup|login|copyright|"
    r"pagination|pager|toolbar|complementary|contentinfo|navigation|dialog)(?:[^a-z]|$)", re.I)
COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|comment-?list|disqus|repl(?:y|ies)|respond)(?:[^a-z]|$)", re.I)
WHOLE_HINT = re.compile(
    r"(?:(?:site|page|top|global)[-_]+)?(?:header|banner)|(?:(?:site|page|post|entry|article|top|global)[-_]+)?(?:tags?|side|related|share|search|legal|skip|notice|alert)"
    r"(?:[-_]+(?:bar|box|buttons?|cloud|column|container|content|form|icons?|items|links?|list|articles|pages|posts|stories|to[-_]content|wrapper))?", re.I)
STATE = re.compile(r"(?:has|no|tag|category)[-_]", re.I)  # classes that tell of the page or its subject, not of the element
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAIN_ROLE = re.compile(r"(?:^|[^a-z])(?:main|article)(?:[^a-z]|$)", re.I)
NONE = 99  # levels up to a container called something else, where there is none
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "in_article", "outside_article",
            "levels", "comment_share", "share")


@dataclass
class Region:
    """An open or closed container; words: unlinked words inside; holds: whether part of an article is inside."""
    name: str
    parent: Region | None
    article: bool
    other: bool
    comments: bool
    words: int = 0
    holds: bool = False


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    heading: bool
    region: Region


def kinds(attributes: str) -> tuple[bool, bool, bool]:
    """Whether the attributes tell of the main text, of something else (or hidden), of comments."""
    main = other = comments = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            other = True
        elif name in ("class", "id", "role", "aria-label"):
            tokens = [t for t in (["-".join(value.split())] if name == "aria-label" else value.split()) if not STATE.match(t)]
            other = other or any(HINT.search(t) or WHOLE_HINT.fullmatch(t) for t in tokens)
            comments = comments or any(map(COMMENTS.search, tokens))
            main = main or name == "role" and bool(MAIN_ROLE.search(value))
    return main and not other and not comments, other, comments


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page in order; blocks without text are left out."""
    out: list[Block] = []
    regions = [Region("", None, False, False, False)]
    pieces: list[str] = []
    linked = links = at = 0
    heading = False
    single: tuple[str, Region] | None = None  # a named element that isn't a container, such as <p class="ad">
    open_until: dict[str, int] = {}  # where the last end tag of a skipped element was looked for in vain

    def close():
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            n = len(text.split())
            inside = single[1] if single else regions[-1]
            out.append(Block(text, n, min(1.0, linked / n), heading, inside))
            article = inside.article
            while inside is not None:
                inside.words += max(0, n - linked)
                inside.holds = inside.holds or article
                inside = inside.parent
        linked = 0

    while at < len(page):
        m = PIECE.match(page, at)
        at = m.end()
        if m["text"] is not None:
            pieces.append(m["text"])
            if links:
                linked += len(m["text"].split())
            continue
        if m["name"] is None:
            continue
        name, ends = m["name"].lower(), bool(m["end"])
        if name in SKIPPED:
            if not ends and name not in open_until:
                until = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                if until is None:
                    open_until[name] = at
                elif not (behind := BEHIND.search(page, at, until.start())) or name not in ("button", "select"):
                    at = until.end()
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if ends else 1
            elif name == "br":
                pieces.append(" ")
            continue
        close()
        links = 0
        heading = not ends and re.fullmatch("h[1-6]", name) is not None
        if name in REGIONS:
            single = None
            if ends:
                last = next((i for i in range(len(regions) - 1, 0, -1) if regions[i].name == name), None)
                if last is not None:
                    del regions[last:]
            else:
                main, other, comments = kinds(m["attributes"])
                article = regions[-1].article or name in ("article", "main") or main
                # An article's header holds its title; articles and main elements aren't judged by their own names.
                other = other and name not in ("article", "main") or name in BOILERPLATE and not (name == "header" and article)
                regions.append(Region(name, regions[-1], article, other, comments))
        elif ends:
            if single and single[0] == name:
                single = None
        elif name in ("body", "html"):
            single = None
        else:
            _, other, comments = kinds(m["attributes"])
            single = (name, Region(name, regions[-1], regions[-1].article, other, comments)) if other or comments else None
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.link_density) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    total = max(1.0, sum(b.words * (1 - b.link_density) for b in found))
    some = any(b.region.article for b in found)
    places = []
    for b in found:
        levels, up, share, comment_share, region = NONE, 0, 2.0, 2.0, b.region
        while region is not None:
            if region.other or region.comments:
                levels = min(levels, up)
            # Beside the page's article no other container is main text, however long.
            part = region.words / total if region.holds or not some else 0.0
            if region.other:
                share = min(share, part)
            if region.comments:
                comment_share = min(comment_share, part)
            region, up = region.parent, up + 1
        places.append((b.heading, b.region.article, some and not b.region.article, levels, comment_share, share))
    return np.concatenate([own, before[:len(own)], after[:len(own)], np.array(places, float).reshape(-1, 6)], axis=1)


# The labelled table: pages whose blocks begin with + (main text) or - (not main text). L and S stand for a long and a
# short run of words.
LABELLED = (
    "<body><nav><ul><li><a>-home</a><li><a>-S</a></ul></nav><div class=ad>-S</div><article><h1>+S</h1><p>+L<p>+one<p>+S<p>+L</article><footer>-S</footer>",
    "<body><nav><a>-S</a></nav><article><h1>+S</h1><p><b>+S<br><p>+L</p><p>+S</p></article><footer>-S</footer></body>",
    "<body><nav><a>-S</a></nav><article><h1>+one</h1><p>+one</p></article><footer>-L</footer></body>",
    "<body><header>-S<p>-S</header><main><h1>+S</h1><p>+L<p>+L<ul><li>+S<li>+S</ul><p>+S</main><aside><h3>-S</h3><p>-L<p>-L</aside><footer>-one</footer>",
    "<body><div id=header><a>-S</a></div><div><h1>+S</h1><p>+L<p>+L<p>+S<p>+L</div><div id=comments><h3>-one</h3><p>-L<p>-L<p>-S</div><div id=footer>-S</div>",
    "<body><div class=menu><a>-one</a><p><a>-one</a><p><a>-one</a></div><h2>+S</h2><p>+L<p>+S<p>+L<div class=sidebar><p>-L<p><a>-S</a></div>",
    "<body><p><a>-S</a><p><a>-S</a><p><a>-one</a><h1>+S</h1><p>+L<p>+L<p>+L<p><a>-S</a><p><a>-S</a>",
    "<body><div role=alert>-L</div><article><p>+L<p>+L<div class=share><a>-one</a></div><p>+L<section class=comments><h2>-one</h2><article><p>-L</article><article><p>-S</article></section></article><form><p>-S<p>-L</form>",
    "<body><p>-one<p>-one<p>-one<p>-S<h1>+S</h1><p>+L<p>+L<p>+S<p>+L<p>-one<p>-one<p>-one",
    "<body><div class=cookie-notice>-L</div><div class=newsletter>-L<form>-S</form></div><main><p>+L<p>+one<p>+L</main><div class=related><p><a>-S</a><p><a>-S</a></div>",
    "<body><main><ul><li><a>+S</a><li><a>+S</a></ul><p>+L</main><aside>-S</aside><article><h1>+S</h1><p><a>+S</a><p>+L</article>",
    "<body><p><a>-L</a><p><a>-L</a><div>+L</div><div>+L</div><p><a>-L</a>",
    "<body><nav><a>-S</a></nav><article><h1>+S</h1><p>+L<p>+one<p>+S</article><footer>-S</footer>",
    "<body><p>-one<p>-S<article><p>+one<p>+S<p>+one<p>+S</article><p>-one<p>-S",
    # Main text in containers that are called something else.
    "<body class=modal-open><main><div class=elementor-widget-container><h1>+S</h1><p>+L<p>+L<p>+S<p>+L</div></main><footer>-S</footer>",
    "<body><nav><a>-S</a></nav><div class=layout-sidebar-right><div class=content><h1>+S</h1><p>+L<p>+one<p>+L<p>+L</div><div class=sidebar><p>-L<p><a>-S</a></div></div><footer>-S</footer>",
    "<body><div class=page-with-comments><div class=post><h2>+S</h2><p>+L<p>+L<p>+S<p>+L</div><ol class=comments><li>-L<li>-S<li>-L</ol></div>",
    "<body><form id=page><div id=header><a>-one</a></div><h1>+S</h1><p>+L<p>+L<p>+L<p>+L<div class=newsletter>-S</div></form>",
    "<body><div class='post-content social-sharing-on'><p>+L<p>+L<p>+S</div><div class=related><p><a>-S</a><p><a>-S</a></div>",
    "<body><div class=reply><p>+L<p>+S<p>+L</div><p><a>-one</a>",
    "<body><div class='content widget'><p>+L<p>+L<p>+S</div><footer>-L</footer>",
    "<body><div class=nav-closed><h1>+S</h1><p>+L<p>+L<p>+L</div><div class=footer>-L<p>-L</div>",
    "<body><div class=sidebar>-L<p>-L</div><div class=menu-item-page><h1>+S</h1><p>+L<p>+L<p>+L</div><p><a>-S</a>",
    "<body><main><article><p>+L<p>+L</article><section class=comments><article class=comment><p>-L<p>-L<p>-L<p>-L<p>-L</article></section></main>",
    "<body><div class=ad>-S<article><h1>+S</h1><p>+L<p>+S</article>",
    "<body><div class=promo>-one<article><p>+L</article>",
    "<body><div><h1>+one</h1><p>+L<p>+S<p>+L</div><p>-one<p>-one",
    "<body><div class=page-with-comments><h1>+one</h1><p>+L<p>+L<h2>+one</h2><p>+L</div><p>-one",
    "<body><div class=modal-open><h1>+one</h1><p>+L<p>+S<p>+L</div><footer>-one</footer>",
    "<body><div class=comments><h3>-one</h3><p>-S</div><h1>+S</h1><p>+L<p>+L<h2>+one</h2><p>+L",
    "<body><main><p>+L<p>+S<p>+L</main><section class=comments><h2>-one</h2><p>-L<p>-S<p>-L<p>-L<p>-L</section><footer>-L</footer>",
    "<body><div><h1>+S</h1><p>+L<p>+L</div><div><p><a>-S</a><p>-one<p><a>-S</a><p>-one<p><a>-S</a></div>",
    "<body class=has-sidebar><div class=site-header>-S</div><main class=has-sidebar><article class='post type-post category-legal tag-search'><header class=entry-header>"
    "<h1>+S</h1></header><p>+L<div class=legal-analysis><p>+L<p>+L</div><p>+S <math><mi>x</mi></math> word<p>+L</article></main><aside class=widget>-S</aside><footer>-S</footer>",
)
WORDS = {"L": "word " * 40, "S": "word " * 6}


@dataclass
class Node:
    """A question `feature <= limit` with the tree for yes and no, or an answer."""
    answer: bool
    feature: int = -1
    limit: float = 0.0
    yes: Node | None = None
    no: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> Node:
    """Decision tree by Gini impurity; of equally good questions the one on the last feature."""
    node = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return node
    best = 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= limit
            a, b = y[left], y[~left]
            impurity = 2 * a.mean() * (1 - a.mean()) * len(a) + 2 * b.mean() * (1 - b.mean()) * len(b)
            if impurity <= best:
                best, node.feature, node.limit = impurity, f, limit
    if node.feature >= 0:
        left = x[:, node.feature] <= node.limit
        node.yes, node.no = grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)
    return node


def answer(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.answer)
    left = x[:, node.feature] <= node.limit
    return np.where(left, answer(node.yes, x), answer(node.no, x))


def fit(labelled: tuple[str, ...] = LABELLED) -> Node:
    xs, ys = [], []
    for page in labelled:
        page = re.sub(r"([+-])([LS])\b", lambda m: m[1] + WORDS[m[2]], page)
        found = blocks(page)
        xs.append(features(found))
        ys += [b.text[0] == "+" for b in found]
    return grow(np.concatenate(xs), np.array(ys))


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, answer(tree, features(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    tree = fit()

    def run(batches):
        for batch in batches:
            for rows, parts in slices(batch, "html"):
                made = [main_text(p.decode("utf-8", "replace"), tree) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
