"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles: a node is a path of tags and classes. For every
branch that may hold boilerplate, entropies over the host's distinct pages tell how varied its layout
(presentation) and its blocks (content) are. Branches of low importance are cut from each page, after
those whose tag or class already names them as menus, notices, adverts, forms or comments. A class that
holds other words too, such as has-sidebar, proves nothing: there the tree decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import stage
from lorebase.llm.urls import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# an opening tag closes these open elements, up to the nearest of the barriers
_ROWS, _CELLS = ("tr", "td", "th"), ("td", "th")
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (_ROWS, ("table",)), "td": (_CELLS, ("table", "tr")), "th": (_CELLS, ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", *_ROWS), ("table",)), "tfoot": (("thead", "tbody", *_ROWS), ("table",)),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
CLOSES |= {tag: (("p",), ("button", "table", "td", "th", "caption", "object", "template")) for tag in BLOCK - {*CLOSES, "html", "caption", "thead"}}
CUT_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas math audio video"
    " dialog menu search datalist".split()
)
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar side footer cookie cookies consent gdpr notice notices alert popup modal overlay comment comments"
    " commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login"
    " pagination pager toolbar skip widget masthead topbar".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
PLAIN = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong a span br code figure figcaption li td th tr tbody thead".split())
FOUND = "host string, page long, path long, kind int, value long"
GAMMA, THRESHOLD, LEAST_PAGES = 0.9, 0.3, 3
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(eq=False)
class Node:
    tag: str
    names: tuple[str, ...] = ()
    role: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)  # child nodes and strings

    @property
    def style(self) -> str:
        return ".".join((self.tag, *self.names))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.counts: dict[str, int] = {}  # open elements by tag, so a tag that closes nothing costs nothing

    def _close(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.counts[node.tag] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        closed, barriers = CLOSES.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1) if any(map(self.counts.get, closed)) else ():
            at = self.open[depth].tag
            if at in barriers:
                break
            if at in closed:
                self._close(depth)
                if at in ("p", "li", "option"):
                    break
        known = dict(reversed(attrs))  # the first of repeated attributes counts
        names = tuple(sorted({*(known.get("class") or "").split(), *(known.get("id") or "").split()}))
        look = (known.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in look
        node = Node(tag, names, (known.get("role") or "").lower(), hidden)
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1) if self.counts.get(tag) else ():
            if self.open[depth].tag == tag:
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


@lru_cache(maxsize=1 << 16)
def _words(names: tuple[str, ...], inside: bool) -> int:
    """0 if no class or id has a word of boilerplate, 1 if only beside other words, 2 if one consists of them."""
    level = 0
    for name in names:
        words = {w.lower() for w in _WORDS.findall(name) if not w.isdigit()}
        if cut := {w for w in words if w in CUT_WORDS or (w == "header" and not inside)}:
            level = max(level, 1 + (cut == words))
    return level


def _hard(node: Node, inside: bool) -> bool:
    """Whether tag, role or state name the element as something other than the article."""
    return node.tag in CUT_TAGS or node.hidden or node.role in CUT_ROLES or (node.tag == "header" and not inside)


def _level(node: Node, inside: bool) -> int:
    """How surely class or id name the element as something other than the article: 0 not, 1 beside other words, 2 surely."""
    if node.tag in ("html", "body", "main") or not node.names:
        return 0
    level = _words(node.names, inside)
    return 0 if level == 1 and (node.tag == "article" or node.role == "main") else level


def _removable(node: Node, inside: bool) -> bool:
    """Whether the style tree may cut this branch; plain text elements go only by name, so copied articles stay."""
    if node.tag in PLAIN:
        return _level(node, inside) == 1
    return not inside or bool(node.names) or node.tag in CUT_TAGS


def _weights(root: Node) -> dict[int, int]:
    """Characters of text below every element, by id(), without what tag, role or state cut inside it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node) and not _hard(p, True)]
    out: dict[int, int] = {}
    for node in reversed(order):
        out[id(node)] = sum(len("".join(p.split())) if isinstance(p, str) else out.get(id(p), 0) for p in node.parts)
    return out


def _starts(root: Node) -> tuple[list[Node], set[int]]:
    """Where extraction starts, and the ids of named elements that hold an article or main and so are no boilerplate.

    The outermost articles, else main elements, else the whole page. Articles and main elements below elements
    with boilerplate in their names count too if they hold more text than all that stands outside of them: the
    longest start found elsewhere, else the rest of the page. Shorter ones are teasers and comments.
    """
    found: list[list[list[tuple[int, Node, tuple]]]] = [[[], []] for _ in range(3)]  # by level and kind
    for kind, test in enumerate((lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main")):
        todo: list[tuple[Node, int, tuple]] = [(root, 0, ())]
        place = 0
        while todo:
            node, level, above = todo.pop()
            place += 1
            if test(node) and not _hard(node, True):
                found[max(level, _level(node, True))][kind].append((place, node, above))
            elif not _hard(node, False):
                if own := _level(node, False):
                    level, above = max(level, own), (node, above)
                todo += [(p, level, above) for p in reversed(node.parts) if isinstance(p, Node)]
    holders: set[int] = set()
    starts = found[0][0] or found[0][1]
    weights = _weights(root) if any(map(any, found[1:])) else {}
    for level in (1, 2):
        wrapped = found[level][0] or found[level][1]
        held = sum(weights.get(id(n), 0) for _, n, _ in wrapped)
        rest = weights.get(id(root), 0) - held
        if level == 1 or held > rest:
            for _, node, above in (*found[level][0], *found[level][1]):
                holders.add(id(node))
                while above and id(above[0]) not in holders:
                    holders.add(id(above[0]))
                    above = above[1]
        least = max((weights.get(id(n), 0) for _, n, _ in starts), default=0 if held > rest else rest)
        starts = sorted([*starts, *(w for w in wrapped if weights.get(id(w[1]), 0) > least)], key=lambda w: w[0])
    return [n for _, n, _ in starts] or [root], holders | {id(n) for _, n, _ in starts}


Path = tuple[int, "Path | None"]  # hash of the styles from the start down to an element, and the path above it


def _below(path: Path | None, style: str) -> Path:
    return xxhash.xxh3_64_intdigest(style.encode("utf-8", "surrogatepass"), path[0] + (1 << 63) if path else 0) - (1 << 63), path


def walk(node: Node, inside: bool, leave) -> Iterator[tuple[Path | None, str | None]]:
    """Text pieces as (path of the branch, text); None ends a block. ``leave(node, hash of its path, inside)`` skips a branch.

    Iterative, and a path is one hash more than the path above it, so deep nesting costs neither stack nor memory.
    """
    todo: list = [(node, None, inside)]
    while todo:
        item = todo.pop()
        if item is None:
            yield None, None
            continue
        part, path, inside = item
        if isinstance(part, str):
            yield path, part
            continue
        path = _below(path, part.style)
        if leave(part, path[0], inside):
            if part.tag in BLOCK:
                yield None, None
            continue
        if part.tag == "br":
            yield path, " "
        inside = inside or part.tag in ("article", "main")
        if part.tag in BLOCK:
            yield None, None
            todo.append(None)
        todo += [(p, path, inside) for p in reversed(part.parts)]


def _joined(pieces: Iterator[tuple[Path | None, str | None]]) -> Iterator[tuple[Path, str]]:
    """Blocks as (path of the first text, text) with single spaces; empty ones are left out."""
    held: list[str] = []
    first = None
    for path, text in pieces:
        if text is None:
            if block := " ".join("".join(held).split()):
                yield first, block
            held, first = [], None
        else:
            if first is None and not text.isspace():
                first = path
            held.append(text)
    if block := " ".join("".join(held).split()):
        yield first, block


def extract(html: str, low: frozenset[int] | None = None) -> str:
    """The main text; ``low`` are the paths of low importance on the page's host, None if the host has no tree.

    With a tree, a class or id that has other words beside those of boilerplate cuts nothing. Without, it cuts
    what holds less than half of the text. If these or the low branches hold all text that is left, they are not cut.
    """
    root = parse(html)
    starts, holders = _starts(root)
    inside = starts[0] is not root
    weights = _weights(root) if low is None else {}
    half = sum(weights.get(id(s), 0) for s in starts) / 2

    def text(cut: frozenset[int], named: bool) -> str:
        def leave(node: Node, path: int, deep: bool) -> bool:
            if _hard(node, deep) or (path in cut and _removable(node, deep)):
                return True
            level = _level(node, deep)
            return bool(level) and id(node) not in holders and (level == 2 or (named and weights.get(id(node), 0) < half))

        return "\n\n".join(b for start in starts for _, b in _joined(walk(start, inside, leave)))

    return text(low or frozenset(), low is None) or text(frozenset(), False)


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_rows(html: str) -> tuple[int, set[tuple[int, int, int]]]:
    """A page's signature (its article) and its nodes: (path, 0, layout) and (path, 1, block) of removable branches."""
    root = parse(html)
    starts, holders = _starts(root)
    kept = lambda n, _path, deep: _hard(n, deep) or (_level(n, deep) == 2 and id(n) not in holders)
    page = _hash("\n".join(b for s in starts for _, b in _joined(walk(s, starts[0] is not root, kept))))
    rows: set[tuple[int, int, int]] = set()
    outside = {id(s) for s in starts if s is not root}
    # paths are relative to the start of extraction; branches outside an article are seen from the root
    for top in starts if starts[0] is root else [*starts, root]:
        branches: set[int] = set()

        def note(node: Node, path: int, deep: bool, seen=branches, top=top) -> bool:
            if node.tag in ("head", "script", "style") or (top is root and id(node) in outside):
                return True
            if _removable(node, deep):
                seen.add(path)
                layout = " ".join(p.style for p in node.parts if isinstance(p, Node))
                rows.add((path, 0, _hash(layout)))
            return False

        for path, block in _joined(walk(top, top is not root, note)):
            value, above = _hash(block), path
            while above:
                if above[0] in branches:
                    if (above[0], 1, value) in rows:
                        break  # and so in every branch above
                    rows.add((above[0], 1, value))
                above = above[1]
    return page, rows


def low_branches(pages: DataFrame, *, gamma: float = GAMMA, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Branches of low importance: ``host, low`` (sorted path hashes, maybe none) of every host with enough pages.

    With m distinct pages on a host, a block on c of them has content entropy log_m(c); a branch's
    content importance is one minus the mean over its blocks, its presentation importance the entropy
    (base m) of its layouts. The composite weighs them by ``gamma``. Counts are taken over distinct
    pages, so copies of one page prove nothing; hosts with fewer than ``least_pages`` cut nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple] = set()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page, found = style_rows(html.as_py())
                rows.add((host, page, None, 2, page))
                rows.update((host, page, *row) for row in found)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "path", "kind", "value"])

    rows = pages.mapInArrow(run, FOUND).distinct()
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    n_of = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what).otherwise(0.0))
    c = F.col("c").cast("double")
    nodes = stage(
        counts.groupBy("host", "path").agg(
            n_of(2, F.lit(1.0)).alias("m"), n_of(1, c).alias("blocks"), n_of(1, c * F.log(c)).alias("shared"),
            n_of(0, c).alias("layouts"), n_of(0, c * F.log(c)).alias("like"),
        ), "nodes",
    )
    hosts = nodes.filter("path IS NULL").select("host", "m").filter(F.col("m") >= least_pages)
    base = F.log("m")
    content = F.when(F.col("blocks") > 0, 1 - F.col("shared") / F.col("blocks") / base).otherwise(1.0)
    layout = F.when(F.col("layouts") > 0, (F.log("layouts") - F.col("like") / F.col("layouts")) / base).otherwise(1.0)
    scored = nodes.drop("m").join(hosts, "host").withColumn("importance", (1 - gamma) * layout + gamma * content)
    low = F.when(F.col("importance") < threshold, F.col("path"))  # null for the page itself
    return scored.groupBy("host").agg(F.sort_array(F.collect_list(low)).alias("low"))


def main_text(pages: DataFrame, **options) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null html is empty, and so is its text. A null url (or one without host) belongs to the empty
    host, where nothing is merged. Repeated rows and null page_ids are kept; an empty table gives no
    rows; other columns are ignored. A long or deeply nested html is read whole, in time linear in its elements and, for the
    tree, in the removable branches above each block. Branches with equal importance are treated alike. Only hashes and counts of nodes are shuffled, and pages only if
    the table of low branches is too large for Spark to broadcast.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    low = stage(low_branches(own.filter("host <> ''").select("host", "html"), **options), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extract(html.as_py(), None if cut is None else frozenset(cut))
                for html, cut in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = own.join(low, "host", "left").select("page_id", "url", "html", "low")
    types = dict(own.dtypes)
    return joined.mapInArrow(run, f"page_id {types['page_id']}, url string, text string, n_chars long")
