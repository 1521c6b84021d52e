"""Main-text extraction from raw HTML: flat text blocks, classified by a small decision tree.

A page becomes a flat sequence of text blocks (text between block-level tags). Each block gets its word count and link
density, those of its neighbours and of the prose near it, and hints: whether it stands in an article, in a part that its tag or its
class, id or role names as furniture (and how much of the page that part holds), in a heading or in a paragraph. A decision
tree, grown here on labelled blocks, keeps or drops the block.

The labelled table is TRAINING_PAGES and made-up pages of three kinds: with telling tags, with telling names, and of plain div
elements. On the last kind nothing but counts and densities tells the article; on the others these overrule hints that mislead, as
lists of links and teasers inside article elements or a whole page inside a form.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
UNSEEN = re.compile(r"""(?:^|[\s"'/])hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of HTML: elements that end a text block; that hold text which is not shown or not prose; that have no end tag.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style noscript template iframe object svg math title textarea select button canvas audio video noframes noembed".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that mark furniture or the article.
FURNITURE_TAGS = set("nav header footer aside form dialog menu fieldset".split())
ARTICLE_TAGS = {"article", "main"}
#: Words in class, id or role that mark furniture or the article.
FURNITURE_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup overlay modal newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments commentlist disqus respond reply replies toolbar search copyright contentinfo complementary disclaimer teaser adbox adslot adsbygoogle affiliate commercial taboola outbrain aside side sidenav rail dropdown topnav topbar sitemap logo branding form signin register poll survey responses response discussion feedback legal warning announcement paywall toast imprint colophon".split())
#: Furniture words that also name parts of an article: they do not count inside one.
AMBIGUOUS_WORDS = set("discussion response responses feedback legal warning".split())
#: Words beside which a furniture word still names furniture, and those that only say what a page has.
NEUTRAL_WORDS = set("site page main global primary secondary top bottom left right list items links posts box bar area section block container wrapper wrap inner outer slot unit".split())
STATE_WORDS = set("has have with without no not is show hide js".split())
#: Furniture by these tags holds no article of its own; other furniture may be a wrapper around the page's text.
FIRM_TAGS = FURNITURE_TAGS - {"form", "fieldset"}
ARTICLE_WORDS = set("article content post entry story main text".split())

#: Elements that hold running text of their own.
TEXT_TAGS = set("p li blockquote pre dd dt figcaption".split())
#: Blocks before and after one in which prose (blocks mostly without links) counts.
NEAR = 3

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "prose_before", "prose_after", "in_article", "in_furniture", "furniture_share", "heading", "paragraph")

#: Labelled pages: a block whose text starts with "keep" belongs to the main text, any other does not.
LONG = "with quite a few more words that go on as running prose does, and then some"
TRAINING_PAGES = [
    f'<body><nav><ul><li><a href="/">home</a></li><li><a href="/b">about us</a></li></ul></nav><div class="ad">buy {LONG}</div><article><h1>keep title</h1><p>keep {LONG}</p><p>keep.</p><p>keep <a href="x">linked only</a></p></article><footer>copyright of us &middot; {LONG}</footer></body>',
    f'<body><header><h1>site name</h1><p>welcome {LONG}</p></header><main><h2>keep heading</h2><p>keep {LONG}</p><ul><li>keep</li><li>keep item</li></ul><p>keep {LONG} {LONG}</p></main><aside><h3>more</h3><p>other {LONG}</p></aside></body>',
    f'<div id="menu"><a href="a">one</a> <a href="b">two</a></div><div class="post"><p>keep {LONG}</p><p>keep it</p><div class="share">tell friends</div><p>keep {LONG}</p></div><div class="comments"><p>reader says {LONG}</p><p>me too</p></div>',
    f'<div><a href="a">one link here</a></div><div><p>keep {LONG} {LONG}</p><p>keep {LONG} {LONG}</p><p>keep short close by</p><p>keep {LONG} {LONG}</p></div><div><a href="q">terms</a> <a href="r">privacy</a></div><div>imprint</div>',
    f'<div class="cookie-notice"><p>we use cookies {LONG}</p></div><article><p>keep</p><p>keep {LONG}</p><aside>box {LONG}</aside><form><p>write to us {LONG}</p></form><section class="comments"><article><p>reader {LONG}</p></article></section></article>',
    f'<td><a href="1">nav</a></td><td><h1>keep head</h1><p>keep {LONG} {LONG} {LONG}</p></td><td><a href="2">next page of many</a></td><p>tail</p>',
    f'<article><p>keep one</p><p>keep</p><p>keep <a href="a">all of this is a link inside of the article text</a></p></article><div class="related"><p>read on {LONG}</p><p>again</p></div><form><p>your name</p></form><p>tiny</p><div class="footer">rights {LONG}</div>',
    f'<body><div class="content-sidebar-wrap"><main class="has-sidebar"><p>keep {LONG}</p><section class="discussion"><p>keep {LONG}</p></section></main><aside>other {LONG}</aside></div></body>',
    f'<form><nav><a href="a">one</a></nav><article class="post comments-open"><p>keep {LONG}</p><p>keep</p><div class="comments">reader {LONG}</div></article><footer>rights</footer></form>',
]


def labelled_pages(count: int = 600, seed: int = 11) -> list[str]:
    """Made-up pages with labels as in TRAINING_PAGES, a third of them without any telling tag or name."""
    rng = random.Random(seed)
    marks = {
        "tags": {"menu": "nav", "top": "header", "article": "article", "foot": "footer", "side": "aside"},
        "names": {"menu": "div class='menu'", "top": "div id='site-header'", "article": "div class='post'", "foot": "div class='footer'", "side": "div class='related'"},
        "plain": {},
    }

    def wrap(part: str, inner: str) -> str:
        tag = marks[kind].get(part, "div")
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def some(least: int, most: int) -> str:
        return " ".join(rng.choice(("some", "more", "words", "of", "it")) for _ in range(rng.randint(least, most)))

    def linked(least: int, most: int) -> str:
        return f"<a href='x'>{some(least, most)}</a>"

    def links(tag: str = "li", least: int = 1, most: int = 3) -> str:
        return "".join(f"<{tag}>{linked(least, most)}</{tag}>" for _ in range(rng.randint(3, 9)))

    def paragraph() -> str:
        if rng.random() < 0.15:
            return f"<h2>keep {some(0, 6)}</h2>"
        if rng.random() < 0.1:
            return f"<ul>{''.join(f'<li>keep {some(0, 12)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        length = rng.choice((0, 1, 2, 4, 8, 20, 20, 40, 80, 150))
        text = f"keep {some(length, length + 3)}"
        if rng.random() < 0.25:
            text += f" {linked(1, max(1, rng.choice((length // 2, length, 3 * length))))} {some(1, 3)}"
        elif rng.random() < 0.05:
            text = f"keep {linked(2, 9)}"
        elif rng.random() < 0.05:
            text = f"<a href='x'>keep {some(1, 25)}</a>"
        return f"<p>{text}</p>"

    pages = []
    for i in range(count):
        kind = ("tags", "names", "plain")[i % 3]
        parts = [wrap("menu", f"<ul>{links()}</ul>" if rng.random() < 0.7 else " ".join(linked(1, 2) for _ in range(6)))]
        if rng.random() < 0.4:
            parts.append(wrap("top", some(1, 8)))
        if kind != "plain" and rng.random() < 0.6:
            parts.append(f"<div class='{rng.choice(('ad', 'cookie-notice', 'banner'))}'>{some(4, 40)}</div>")
        if kind == "plain" and rng.random() < 0.6:
            parts.append(f"<div>{some(3, 12)}</div>")
        if rng.random() < 0.3:
            parts.append("".join(wrap("article", linked(2, 30)) for _ in range(rng.randint(3, 6))))
        body = [f"<h1>keep {some(0, 12)}</h1>"] if rng.random() < 0.9 else []
        body += [paragraph() for _ in range(rng.randint(1, 12))]
        if kind != "plain" and rng.random() < 0.3:
            tag = rng.choice(("p", "p", "div", "td"))
            body = body[: rng.randint(0, 2)] + [f"<{tag}>keep {some(0, 3)}</{tag}>" for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.15:  # text without paragraph elements
            body = [f"<div>keep {some(25, 90)}</div>" for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.3:
            body.insert(rng.randint(1, len(body)), f"<ul>{links(most=rng.choice((4, 4, 15)))}</ul>")
        if kind == "tags" and rng.random() < 0.3:
            body.insert(rng.randint(1, len(body)), wrap("side", f"<h3>{some(1, 3)}</h3><p>{some(5, 60)}</p>"))
        parts.append(wrap("article", "".join(body)))
        if kind != "plain" and rng.random() < 0.25:  # a page cut short
            pages.append("".join(parts)[:-4] if rng.random() < 0.5 else "".join(parts))
            continue
        if kind != "plain" and rng.random() < 0.5:
            parts.append("<div class='comments'>" + "".join(f"<p>{some(2, 60)}</p>" for _ in range(rng.randint(1, 5))) + "</div>")
        if rng.random() < 0.3:
            parts.append(wrap("side", links(rng.choice(("div", "p", "li")), 2, 25)))
        if rng.random() < 0.3:
            parts.append(wrap("side", f"<p>{linked(1, 25)}</p>" if rng.random() < 0.5 else f"<div>{some(2, 40)}</div>") if kind != "plain" else f"<div>{linked(1, 25)}</div>")
        if rng.random() < 0.8:
            parts.append(wrap("foot", some(2, 20) if rng.random() < 0.6 else f"{some(1, 3)} {linked(1, 2)} {linked(1, 2)}"))
        page = "".join(parts)
        pages.append(f"<form>{page}</form>" if kind == "plain" and rng.random() < 0.3 else page)
    return pages


def names_furniture(tokens: list[str], in_article: bool) -> bool:
    """Whether a whole class name, id or role (its words) names furniture: cookie-notice and post-footer do, has-sidebar and comments-open do not."""
    words = FURNITURE_WORDS - AMBIGUOUS_WORDS if in_article else FURNITURE_WORDS
    if "".join(tokens) in words:
        return True
    if not tokens or words.isdisjoint(tokens):
        return False
    return all(t in words or t in NEUTRAL_WORDS for t in tokens) or tokens[-1] in words and tokens[0] not in STATE_WORDS


def kind_of(tag: str, attributes: str, in_article: bool = False) -> int:
    """-2 for an element that is not shown, -1 for one that holds furniture, 1 for one that holds an article, else 0.

    An article or main element is an article whatever its names.
    """
    if tag in ("body", "html"):
        return 0
    kind = -1 if tag in FURNITURE_TAGS else 1 if tag in ARTICLE_TAGS else 0
    if attributes and kind >= 0:
        if UNSEEN.search(attributes):
            return -2
        if kind > 0:
            return kind
        named = [[w.lower() for w in TOKEN.findall(name)] for value in NAMED.findall(attributes) for name in value.split()]
        if any(names_furniture(n, in_article) for n in named):
            return -1
        if tag not in HEADING and tag != "p" and any(not ARTICLE_WORDS.isdisjoint(n) for n in named):
            return 1
    return kind


def blocks(html: str) -> list[tuple[str, int, int, bool, bool, float, bool, bool]]:
    """The page's text blocks: text, words, linked words, in an article, in furniture, the share of the page's words that the innermost
    furniture holds, in a heading, in a paragraph.

    On a page whose articles all stand in furniture, or that has none, what looks like furniture but holds an article or main
    element is a wrapper and does not count (nav, header, footer and the like: only if they hold a main). Shares count only there, and
    only for furniture that may wrap text: it is 0 elsewhere.
    """
    out: list[tuple] = []
    stack: list[tuple[str, int, int, tuple[int, int], bool]] = []
    furniture: list[tuple[int, int, bool, bool]] = []  # first block, the one after the last, may wrap most words, holds an article
    seen = {"article": 0, "main": 0}
    free_article = False
    open_tags: dict[str, int] = defaultdict(int)
    within = {1: 0, 0: 0, -1: 0, -2: 0}
    parts: list[str] = []
    linked: list[str] = []
    links = headings = bare = 0
    raw_end: dict[str, bool] = {}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, text.count(" ") + 1, len("".join(linked).split()), within[1] > 0, within[-2] > 0, 0.0, headings > 0, bool(stack) and stack[-1][0] in TEXT_TAGS or bare > 0))
            parts.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked.append(piece)

    def close() -> str:
        nonlocal free_article
        tag, kind, first, held, free = stack.pop()
        open_tags[tag] -= 1
        within[kind] -= 1
        if first < len(out):
            if kind == -1:
                main = seen["main"] > held[1]
                furniture.append((first, len(out), tag not in FIRM_TAGS, main or tag not in FIRM_TAGS and seen["article"] > held[0]))
            elif kind == 1 and free:
                free_article = True
        return tag

    at, end = 0, len(html)
    while at < end:
        less = html.find("<", at)
        if less < 0:
            add(html[at:])
            break
        add(html[at:less])
        start = html[less + 1 : less + 2]
        if start in ("!", "?"):
            if html.startswith("<!--", less):
                stop = html.find("-->", less + 2)
                at = stop + 3 if stop >= 0 else end
            else:
                stop = html.find(">", less)
                at = stop + 1 if stop >= 0 else end
            continue
        found = TAG.match(html, less) or LOOSE_TAG.match(html, less)
        if not found:
            if start == "/" or start.isascii() and start.isalpha():
                stop = html.find(">", less)
                if stop < 0:
                    break  # an unfinished tag at the end of a cut page
                at = stop + 1
            else:
                add("<")
                at = less + 1
            continue
        at = found.end()
        tag, ending, attributes = found[2].lower(), bool(found[1]), found[3]
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                stop = None if raw_end.get(tag) is False else re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                raw_end[tag] = stop is not None
                if stop:
                    at = stop.end()
                elif tag in ("script", "style"):
                    break  # a cut page
            continue
        if tag == "a":
            links = 0 if ending else 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        bare = 0
        if tag in HEADING:
            headings = 0 if ending else 1
        if ending:
            if open_tags[tag]:
                while close() != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            close()
        if tag in ("article", "nav", "footer", "header", "aside", "main", "form", "section", "div", "table", "ul", "ol"):
            links = headings = 0
        if tag == "p" and attributes == "":
            bare = 1  # a paragraph that needs no place on the stack
        elif tag not in VOID:
            kind = kind_of(tag, attributes, within[1] > 0)
            stack.append((tag, kind, len(out), (seen["article"], seen["main"]), not within[-1] and not within[-2]))
            if kind == 1 and tag in seen:
                seen[tag] += 1
            open_tags[tag] += 1
            within[kind] += 1
    flush()
    while stack:
        close()
    if not furniture:
        return out
    words = [0, *accumulate(b[1] for b in out)]
    counted = [(first, last, 0.0 if free_article or not wraps else (words[last] - words[first]) / words[-1]) for first, last, wraps, holds in furniture if free_article or not holds]
    counted.sort(key=lambda f: (f[0], -f[1]))
    inside: list[tuple[int, float]] = []  # end and share of the furniture around a block; what lies inside firm furniture has no share
    at = 0
    for i, b in enumerate(out):
        while inside and inside[-1][0] <= i:
            inside.pop()
        while at < len(counted) and counted[at][0] <= i:
            inside.append((counted[at][1], min(counted[at][2], inside[-1][1]) if inside else counted[at][2]))
            at += 1
        if inside:
            out[i] = (*b[:4], True, inside[-1][1], *b[6:])
    return out


def features(found: list[tuple]) -> np.ndarray:
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    if n:
        _, words, linked, article, furniture, share, heading, paragraph = zip(*found, strict=True)
        w = np.array(words, float)
        d = np.array(linked, float) / w
        out[:, 0], out[:, 1] = w, d
        out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = w[:-1], d[:-1], w[1:], d[1:]
        prose = np.r_[np.zeros(NEAR + 1), np.cumsum(np.where(d < 0.5, w, 0)), np.zeros(NEAR)]
        prose[n + NEAR + 1 :] = prose[n + NEAR]
        out[:, 6] = prose[NEAR : n + NEAR] - prose[:n]
        out[:, 7] = prose[2 * NEAR + 1 :] - prose[NEAR + 1 : n + NEAR + 1]
        out[:, 8], out[:, 9], out[:, 10], out[:, 11], out[:, 12] = article, furniture, share, heading, paragraph
    return out


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1) -> tuple:
    """A classification tree by Gini impurity: (feature, threshold, left, right), or the share of kept blocks at a leaf (of ``least`` at least)."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = (1e-9, 0, 0.0)
    whole = len(y) * y.mean() * (1 - y.mean())
    for j in (8, 9, *(k for k in range(x.shape[1]) if k not in (8, 9))):  # where splits are equally good, hints give the simpler rule
        order = np.argsort(x[:, j], kind="stable")
        values, kept = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        here = np.flatnonzero((values[:-1] < values[1:]) & (n >= least) & (len(y) - n >= least))
        if not len(here):
            continue
        n, left = n[here], kept[here]
        right = kept[-1] - left
        gains = np.round(whole - left * (1 - left / n) - right * (1 - right / (len(y) - n)), 9)
        at = int(np.argmax(gains))
        if gains[at] > best[0] + 1e-9:
            best = (float(gains[at]), j, float((values[here[at]] + values[here[at] + 1]) / 2))
    if best[0] <= 1e-9:
        return (float(y.mean()),)
    go = x[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(x[go], y[go], depth - 1, least), grow_tree(x[~go], y[~go], depth - 1, least)


def fit_tree(pages: list[str] | None = None) -> tuple:
    found = [blocks(p) for p in pages or [*TRAINING_PAGES * 3, *labelled_pages()]]
    x = np.concatenate([features(f) for f in found])
    return grow_tree(x, np.array([b[0].startswith("keep") for f in found for b in f], float))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    feature, cut, left, right = tree
    go = x[:, feature] <= cut
    out = np.zeros(len(x), bool)
    out[go], out[~go] = decide(left, x[go]), decide(right, x[~go])
    return out


def extract(html: str, tree: tuple) -> str:
    found = blocks(html)
    return "\n".join(b[0] for b, keep in zip(found, decide(tree, features(found)), strict=True) if keep)


def html_text(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page's main text.

    White space inside a block is one space, blocks are joined in page order by one line feed. A null or empty page, or one
    without main text, has the empty text. A page cut short yields what it holds. A very long page is read whole, in time that grows
    with its length. Ties: there are none, as each block is kept or dropped by its own features. Rows are judged one by one:
    repeated rows repeat, null ids and urls stay, other columns are ignored, an empty table gives an empty result.
    """
    tree = tree or fit_tree()
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            kept = iter(decide(tree, np.concatenate([features(f) for f in found])).tolist()) if found else iter(())
            texts = ["\n".join([b[0] for b in f if next(kept)]) for f in found]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return map_arrow(source, run, f"page_id {dict(source.dtypes)['page_id']}, url string, text string, n_chars long")
