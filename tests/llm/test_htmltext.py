"""Main text extraction."""

import html as entities
import random
import re

import pytest

from lorebase.llm import htmltext
from lorebase.sources.tables import table

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; line</h1>'
    "<p><b>One.<br><p>Two &eacute;\n  &#8364;&nbsp;x</p><div class='share-box'>Share</div><ul><li>a<li>b</ul>"
    '<table><tr><td>1<td>2</table><section id="comments"><p>Nice!</p></section></article><aside>Side</aside><form><p>Mail</p></form>'
    '<div class="cookie-notice">Cookies</div><footer>&copy; me</footer></body></html>'
)


def test_article():
    assert htmltext.extract(PAGE) == "Head & line\n\nOne.\n\nTwo é € x\n\na\n\nb\n\n1\n\n2"
    assert htmltext.extract("") == "" and htmltext.extract("plain &lt; text") == "plain < text"
    assert htmltext.extract("<main><header><h1>H</h1></header>x <i>y</i>z</main>") == "H\n\nx yz"
    assert htmltext.extract("<div>a<div>b</div>c</div>") == "a\n\nb\n\nc"
    assert htmltext.extract("<p>kept<script>if (a</b) '<p>no'</script> on") == "kept on"
    assert htmltext.extract("<div>" * 5000 + "deep") == "deep"


def test_wrappers_with_boilerplate_words_in_their_names():
    for wrap in ("<div class='content-sidebar-wrap'>{}</div>", "<div class='has-sidebar'>{}</div>", "<div id='page' class='with-comments x'>{}</div>", "<div class='sidebar'>{}</div>"):
        for inner in ("<main><p>Whole text.</p></main>", "<article><p>Whole text.</p></article>", "<div role=main class=no-sidebar><p>Whole text.</p></div>"):
            for outside in ("", "<div>Site</div>", "<nav>Menu</nav>"):
                for low in (None, frozenset()):
                    assert htmltext.extract(outside + wrap.format(inner), low) == "Whole text.", (wrap, inner, outside)
    assert htmltext.extract("<main>" + "<div class='sidebar'><article><p>Whole text.</p></article></div></main>") == "Whole text."
    assert htmltext.extract("<article class='post comments-open'><p>Whole text.</p></article><article class='post'><p>Second.</p></article>") == "Whole text.\n\nSecond."
    assert htmltext.extract("<article><div class='entry-share-enabled'><p>Whole text.</p></div></article>") == "Whole text."
    assert htmltext.extract("<div>Site</div><div class='no-sidebar'><p>Whole text here.</p></div>").endswith("Whole text here.")
    # what is named and short, or surely named, still goes
    teasers = "<div class='related-posts'><article>Other</article></div><div id='comments'><article>First!</article></div>"
    assert htmltext.extract(f"<article><p>Whole text.</p></article>{teasers}") == "Whole text."
    assert htmltext.extract(f"<main><p>Whole text.</p></main>{teasers}") == "Whole text."
    assert htmltext.extract("<main><p>Whole text.</p><div class='sidebar'>Side</div><div class='widget-3'>More and more and more</div></main>") == "Whole text."


def test_deep_pages_cost_linear_time_and_memory():
    import time
    import tracemalloc

    for page in ("<div>" * 20_000 + "deep", "<p>x<button>" * 20_000, "<div class=a>" * 20_000 + "deep", "<div></b>" * 20_000 + "x", "<article>x</article>" * 20_000, "<dl><dd>" * 20_000 + "x"):
        begin = time.process_time()
        _, rows = htmltext.style_rows(page)
        assert htmltext.extract(page, frozenset()) or "button" in page
        assert len(rows) <= 80_001 and time.process_time() - begin < 8, page[:30]
    tracemalloc.start()
    htmltext.style_rows("<div>" * 20_000 + "deep")
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_style_tree_equals_brute_force_entropies(spark):
    """The importance of every branch from its definition, over pages held as nested lists of (style, children or text)."""
    import math
    from collections import Counter

    rng = random.Random(9)

    def branch(depth):
        if depth == 0 or rng.random() < 0.3:
            return ("div." + rng.choice("abc"), rng.choice(["same words", "other words", f"own {rng.random()}"]))
        return ("div." + rng.choice("abc"), [branch(depth - 1) for _ in range(rng.randint(1, 3))])

    def markup(node):
        name, inner = node
        return f"<div class={name[4:]}>{inner if isinstance(inner, str) else ''.join(map(markup, inner))}</div>"

    common = [("div.d", "same words"), ("div.e", [("div.a", "same words"), ("div.f", "other words")]), ("div.g", "shared by some")]
    trees = [[branch(3) for _ in range(3)] + common[: rng.choice([2, 3])] for _ in range(12)]
    layouts, blocks, chains = {}, {}, {}

    def visit(node, above, page):
        """Notes layouts; returns the texts below."""
        name, inner = node
        path = (*above, name)
        chains[path] = None
        kids = [] if isinstance(inner, str) else inner
        layouts.setdefault(path, set()).add((page, " ".join(k[0] for k in kids)))
        texts = [inner] if isinstance(inner, str) else [t for k in kids for t in visit(k, path, page)]
        blocks.setdefault(path, set()).update((page, t) for t in texts)
        return texts

    for page, tree in enumerate(trees):
        for node in tree:
            visit(node, ("html",), page)
    want = set()
    for path in chains:
        low = Counter(v for _, v in layouts[path]).values()
        total = sum(low)
        presentation = -sum(c / total * math.log(c / total, len(trees)) for c in low)
        texts = Counter(v for _, v in blocks[path]).values()
        content = 1 - sum(c * math.log(c, len(trees)) for c in texts) / sum(texts)
        if 0.1 * presentation + 0.9 * content < 0.3:
            above = None
            for style in path:
                above = htmltext._below(above, style)
            want.add(above[0])
    pages = spark.createDataFrame([("h", "".join(map(markup, tree))) for tree in trees], "host string, html string").repartition(3)
    assert 3 <= len(want) < len(chains) and {h: set(x) for h, x in htmltext.low_branches(pages).collect()} == {"h": want}


def test_never_fails():
    rng = random.Random(1)
    parts = ["<", ">", "<p", "</", "<!--", "-->", "<![if x]>", "<![CDATA[", "]]>", "<?", "&", "&#x;", "&#99999999;", "<article>", "</p>", "x", "<script>", '"', "'", "=", "<a b=c", "\0", "<!", "<table><tr>"]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        htmltext.extract(html)
        htmltext.style_rows(html)


def site(host, n, body):
    return [(i, f"http://{host}/{i}", body(i), "clash") for i in range(n)]


@pytest.fixture(scope="module")
def pages(spark):
    shared = lambda i: f'<div class="box"><p>Always the same words</p></div><div class="story"><p>Story number {i} told.</p></div>'
    copied = lambda i: '<div class="story"><p>One copied story.</p></div>'
    article = lambda i: f'<article><p>Text {i}</p><p>Refrain.</p><div class="blurb">Read more here</div></article>'
    rows = [*site("a.org", 8, shared), *site("b.org", 8, copied), *site("c.org", 8, article), *site("d.org", 2, shared)]
    rows += [(100, None, shared(1), "clash"), (None, "http://a.org/n", None, "clash"), (101, "http://a.org/", "", "clash"), (102, "none", "<p>x", "clash")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)


def test_style_tree_cuts_only_shared_branches(pages):
    rows = htmltext.main_text(pages).collect()
    text = {(r.url, r.page_id): r.text for r in rows}
    assert len(rows) == 30 and all(r.n_chars == len(r.text) for r in rows)
    assert text["http://a.org/3", 3] == "Story number 3 told."
    assert text["http://b.org/3", 3] == "One copied story."
    assert text["http://c.org/3", 3] == "Text 3\n\nRefrain."
    assert text["http://d.org/1", 1] == text[None, 100] == "Always the same words\n\nStory number 1 told."
    assert text["http://a.org/n", None] == text["http://a.org/", 101] == "" and text["none", 102] == "x"
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_style_tree_decides_on_names_of_several_words(spark):
    body = lambda i: (
        f'<div class="logo-text">Site {i}</div><div class="content-sidebar-wrap"><div class="share-box">Share this</div><div class="no-sidebar">Story {i}</div></div>'
        '<p class="related-line">See more</p><div class="comments">Nice</div>'
    )
    rows = htmltext.main_text(spark.createDataFrame([r[:3] for r in site("w.org", 6, body)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"Site {i}\n\nStory {i}" for i in range(6)}


def test_equals_articles_of_the_table(spark, sf):
    rows = {r.page_id: r.text for r in htmltext.main_text(table(spark, sf, "pages")).collect()}
    for r in table(spark, sf, "pages").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]


        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert rows[r.page_id] == "\n\n".join(filter(None, blocks))
