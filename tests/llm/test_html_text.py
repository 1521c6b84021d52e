import html
import re

import pytest

from orrery.llm.html_text import FEATURES, TRAINING_PAGES, blocks, decide, extract, features, fit_tree, html_text, labelled_pages

TREE = fit_tree()
CASES = [
    ("", ""),
    ("<p>", ""),
    ("<article><p>a &lt; b&amp;c &nbsp; d<br>e</p></article>", "a < b&c d e"),
    ("<article><h1>T</h1><p><b>x<br><p>y</p></article><footer>f</footer>", "T\nx\ny"),
    ("<article>one<!-- <p>no</p> --><script>var t='</p>';</script> two<style>p{}</style></article>", "one two"),
    ("<ARTICLE><P CLASS=lead>Up</P><DIV CLASS='cookieNotice'>no</DIV></ARTICLE>", "Up"),
    ("<article><p>whole</p><p>cut sho", "whole\ncut sho"),
    ("<article><p>whole</p><p>cut</p", "whole\ncut"),
    ("<article><p title='a > b'>v</p><p>1 < 2</p></article>", "v\n1 < 2"),
    ("<nav><a href=x>m</a></nav><main><p>m1</p><aside>s</aside><p>m2</p></main><div id=comments><p>c c c c c c c c c c c c c c c c c</p></div>", "m1\nm2"),
    ("<header>h</header><article><form>f<input></form><p>t</p><section class=comments><article>c</article></section><p>u</p></article>", "t\nu"),
    ("<div class='topBar'>t</div><div class='entry-content'><p class=notice>n<p>one<p>two</div><ol class=commentlist><li>c c c</ol><div id=adSlot1>x</div>", "one\ntwo"),
    ("<main><p>a<div style='display: none'>h</div><p>b<template>t</template><noscript>n</noscript></main><div role=contentinfo>i</div>", "a\nb"),
    ("<article><p>&#233;t&eacute; &amp;amp; &lt;p&gt;\n\t x</p></article>", "été &amp; <p> x"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert extract(page, TREE) == want


def test_tree_learns_its_table():
    for page in TRAINING_PAGES:
        found = blocks(page)
        assert decide(TREE, features(found)).tolist() == [b[0].startswith("keep") for b in found]


def test_linear_time_on_broken_markup():
    for page in ("<div>" * 50_000 + "</p>" * 50_000, "<!--" * 50_000, "<a '" * 20_000, "<script>" * 50_000, "<p " * 50_000, "<noscript>" * 20_000, "a" * 2_000_000):
        extract(page, TREE)


def test_against_the_pages_template(spark):
    """A plain cut of the article element by regular expressions gives the same, as these pages hold nothing else in it."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        inner = re.sub(r"<[^>]*$", "", inner[1]) if inner else ""
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    rows = [(1, None, "<article>x</article>", "t"), (1, None, "<article>x</article>", "t"), (None, "u", None, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text(df).collect()), key=str) == sorted([(1, None, "x", 1), (1, None, "x", 1), (None, "u", "", 0)], key=str)
    assert html_text(df.limit(0)).count() == 0


PROSE = "the article goes on with quite a few words that say what it is about and then with some more of them"
WRAPPED = [
    ("<div class='content-sidebar-wrap'><article><p>a</p></article><aside>s</aside></div>", "a"),
    ("<div class='sidebar'><main><p>a</p></main></div>", "a"),
    ("<main class='has-sidebar'><p>a</p><div class='sidebar'>s</div></main>", "a"),
    ("<article class='post comments-open'><p>a</p><div id='comments'>c</div></article>", "a"),
    ("<article><p>a</p><section class='discussion'><p>d</p></section></article>", "a\nd"),
    ("<form><header>h</header><article><p>a</p></article><footer>f</footer></form>", "a"),
    (f"<form><nav><a href=x>m</a></nav><p>{PROSE}</p><p>{PROSE}</p></form>", f"{PROSE}\n{PROSE}"),
    (f"<article><p>a</p></article><div class='post-comments'><article>{PROSE}</article></div><div class='site-footer'>{PROSE}</div>", "a"),
    ("<main style='display:none'><p>x</p></main><article><p>a</p></article>", "a"),
]


@pytest.mark.parametrize("page,want", WRAPPED)
def test_wrappers_are_not_furniture(page, want):
    assert extract(page, TREE) == want


def judged(pages, tree, blind=()):
    """For all blocks of the pages: decisions, labels, and what the tags alone say. ``blind``: features set to 0."""
    out = []
    for page in pages:
        found = blocks(page)
        x = features(found)
        x[:, list(blind)] = 0
        out += zip(decide(tree, x).tolist(), (b[0].startswith("keep") for b in found), (b[3] and not b[4] for b in found), strict=True)
    return out


def test_counts_and_densities_decide():
    """On labelled pages that the tree has not seen, counts and densities tell what tags do not; without them it fails."""
    pages = labelled_pages(300, 1234)
    for kind in range(3):
        rows = judged(pages[kind::3], TREE)
        assert sum(got == want for got, want, _ in rows) > 0.97 * len(rows)
        assert sum(hint == want for _, want, hint in rows) < 0.9 * len(rows)
    counts = [i for i, f in enumerate(FEATURES) if not f.startswith(("in_", "heading", "paragraph"))]
    rows = judged(pages, TREE, counts)
    assert sum(got == want for got, want, _ in rows) < 0.9 * len(rows)


def test_pages_without_telling_tags(spark):
    """The template's pages with article renamed, and with all of its tags and names gone, keep their article and nothing else."""
    kept = wanted = foreign = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = [b[3] and not b[4] for b in blocks(r.html)]
        renamed = r.html.replace("<article", "<div").replace("</article", "</div")
        for page in (renamed, re.sub("<(/?)(?:nav|footer)", r"<\1div", renamed).replace(' class="ad"', "")):
            found = blocks(page)
            got = decide(TREE, features(found)).tolist()
            kept += sum(g and w for g, w in zip(got, want, strict=True))
            foreign += sum(g and not w for g, w in zip(got, want, strict=True))
            wanted += sum(want)
    assert kept > 0.98 * wanted and foreign < 0.01 * wanted


def test_hints_are_overruled():
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(6))
    assert extract(f"<article><h1>t</h1><p>{PROSE}</p><ul>{links}</ul><p>{PROSE}</p></article>", TREE) == f"t\n{PROSE}\n{PROSE}"
    teasers = "".join(f"<article><a href=x>some teaser {i}</a></article>" for i in range(4))
    assert extract(f"<div>{teasers}</div><div><h1>t</h1><p>{PROSE}</p><p>{PROSE}</p></div>", TREE) == f"t\n{PROSE}\n{PROSE}"


def test_very_long_page(spark):
    page = "<nav><a href=x>m</a></nav><article>" + f"<p>{PROSE}</p>" * 30_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_text(df).first().n_chars == 30_000 * (len(PROSE) + 1) - 1
