"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters per tag, adjusted by how much of them stands
in links. The node whose children's densities have the greatest sum is the content; the least
density on its path to the body is the threshold at which other parts of the page join it.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments go before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.runtime import spread

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
#: A start tag of the key ends an open element of the first set, if none of the second is open inside that.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that never hold article text, roles that say so, and words of classes and ids that do.
DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head iframe input map menu nav noframes noembed noscript object option script select style svg template textarea title video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
DROPPED_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "alert banner consent cookie cookies gdpr modal notice notices notification notifications overlay popup privacy toast "
    "breadcrumb breadcrumbs menu menus nav navbar navigation pager pagination topbar "
    "aside rail related recommended recommendations sidebar sidebars trending widget widgets "
    "comment comments commentlist discussion disqus replies reply respond "
    "copyright colophon footer header masthead "
    "follow login newsletter search share sharing signup social subscribe subscription".split()
)
#: Of these, the ones of a page's top, where its title may stand.
TOP_WORDS = frozenset("banner header masthead topbar".split())
#: Words that say of a header that it is the article's own.
OWN_HEADER = frozenset("article content entry headline main post story title".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD, _HUMP = re.compile(r"[A-Za-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its place in page order is its index, and `last` the index of the last one inside it."""

    __slots__ = ("tag", "parent", "last", "hinted", "top", "article", "main", "dropped", "chars", "link_chars", "tags", "link_tags", "direct", "density", "total")

    def __init__(self, tag: str, parent: int) -> None:
        self.tag, self.parent, self.last = tag, parent, 0
        self.hinted = self.top = self.article = self.main = self.dropped = False
        self.chars = self.link_chars = self.tags = self.link_tags = self.direct = 0
        self.density = self.total = 0.0


def _describe(node: Node, given: str) -> None:
    """Take from a tag's attributes what they say of its role."""
    found = {}
    for name, value in _ATTRIBUTE.findall(given):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    role = found.get("role", "").lower().strip()
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {x.lower() for x in _WORD.findall(f"{names} {_HUMP.sub(' ', names)}")}  # sideBar1 is sidebar, adBox an ad
    bad = words & DROPPED_WORDS
    if bad == {"header"} and words & OWN_HEADER or bad <= TOP_WORDS and node.tag in HEADINGS:
        bad = set()
    node.top = bool(bad) and bad <= TOP_WORDS
    node.article = node.tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody"
    node.main = node.tag == "main" or role == "main"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    node.dropped = hidden or role in DROPPED_ROLES
    node.hinted = bool(bad)


class Page:
    """The tree of a page, and its pieces: (index of the element, its text or None where a block begins or ends)."""

    def __init__(self, html: str) -> None:
        self.nodes = [Node("#root", 0)]
        self.pieces: list[tuple[int, str | None]] = []
        self._stack = [0]
        self._open: dict[str, int] = {}
        self._inline: list[dict[str, int]] = [{}]  # open inline elements inside each open block
        self._read(html)
        while len(self._stack) > 1:
            self._pop()
        self.nodes[0].last = len(self.nodes) - 1

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._stack[-1], unescape(text) if "&" in text else text))

    def _push(self, tag: str, attributes: str) -> None:
        node = Node(tag, self._stack[-1])
        node.article, node.main = tag == "article", tag == "main"
        if attributes:
            _describe(node, attributes)
        self.nodes.append(node)
        at = len(self.nodes) - 1
        node.last = at
        if tag in BLOCK:
            self.pieces.append((at, None))
        if tag in VOID:
            if tag in ("br", "wbr"):
                self.pieces.append((at, " " if tag == "br" else ""))
            return
        self._stack.append(at)
        if tag in BLOCK:
            self._open[tag] = self._open.get(tag, 0) + 1
            self._inline.append({})
        else:
            self._inline[-1][tag] = self._inline[-1].get(tag, 0) + 1

    def _pop(self) -> str:
        at = self._stack.pop()
        node = self.nodes[at]
        node.last = len(self.nodes) - 1
        if node.tag in BLOCK:
            self._open[node.tag] -= 1
            self._inline.pop()
            self.pieces.append((at, None))
        else:
            self._inline[-1][node.tag] -= 1
        return node.tag

    def _close(self, tag: str) -> None:
        """End the innermost open element of a name; an inline one only within its block. A stray end tag says nothing."""
        if (self._open if tag in BLOCK else self._inline[-1]).get(tag, 0):
            while self._pop() != tag:
                pass

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and self._open.get("p", 0):
            self._close("p")
        if tag in ENDS:
            ended, within = ENDS[tag]
            for at in reversed(self._stack):
                name = self.nodes[at].tag
                if name in within:
                    break
                if name in ended:
                    self._close(name)
                    break
        if tag in HEADINGS and self.nodes[self._stack[-1]].tag in HEADINGS:
            self._pop()
        self._push(tag, attributes)

    def _read(self, html: str) -> None:
        at, begun, n = 0, 0, len(html)  # begun: where text that isn't kept yet begins
        while (at := html.find("<", at)) >= 0:
            following = html[at + 1 : at + 2]
            if following in ("!", "?") or (following == "/" and not html[at + 2 : at + 3].isalpha() and html[at + 2 : at + 3]):
                self._text(html[begun:at])
                if html.startswith("<!--", at):
                    end = html.find("-->", at + 2)
                    end = end + 3 if end >= 0 else n
                else:
                    end = html.find(">", at) + 1 or n
                at = begun = end
                continue
            if not (following.isascii() and following.isalpha()) and following != "/":
                at += 1
                continue
            self._text(html[begun:at])
            found = _TAG.match(html, at)
            if found:
                closing, tag, attributes = found[1], found[2].lower(), found[3]
                end = found.end()
            else:  # a quote that is never closed, or no end at all
                end = html.find(">", at) + 1 or n
                body = html[at + 1 : end].rstrip(">")
                closing = "/" if body.startswith("/") else ""
                tag, attributes = (re.split(r"[\s/]", body.lstrip("/"), maxsplit=1)[0].lower() or "x") if end < n or html.endswith(">") else "", ""
            at = begun = end
            if not tag:
                continue
            if closing:
                if tag == "br":
                    self._start("br", "")
                else:
                    self._close(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                stop = _CLOSING[tag].search(html, at)
                at = begun = stop.end() if stop else n  # all of these are dropped, texts and all
                self._close(tag)
        self._text(html[begun:])


def _composite(chars: int, link_chars: int, tags: int, link_tags: int, links: float) -> float:
    """Composite text density; `links` is the share of the body's characters that stand in links."""
    if chars == 0:
        return 0.0
    linked, tags = max(link_chars, 1), max(tags, 1)
    base = log(chars / max(chars - link_chars, 1) * linked + links * chars + e)
    return chars / tags * log(chars / linked * tags / max(link_tags, 1)) / log(base)


def _drop(nodes: list[Node]) -> None:
    """Decide what is left out: by element, by role, and by the words of class and id.

    These don't count where an article stands inside, nor a first heading, but for the words of a
    page's top; and those not inside an article, whose top is its own.
    """
    holds, titled = [False] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i] or nodes[i].article or nodes[i].main
        titled[nodes[i].parent] |= titled[i] or nodes[i].tag == "h1"
    within = [False] * len(nodes)  # an article or main element
    for i in range(1, len(nodes)):
        node, parent = nodes[i], nodes[nodes[i].parent]
        within[i] = within[node.parent] or node.article or node.main
        kept = holds[i] or (within[node.parent] if node.top else titled[i]) or node.tag in ("html", "body", "main")
        page_header = node.tag == "header" and not within[i]
        node.dropped = parent.dropped or node.dropped or node.tag in DROPPED or page_header or (node.hinted and not kept)


def _measure(page: Page) -> int:
    """Fill in every node's counts, density and sum of densities; the index of the body."""
    nodes = page.nodes
    in_link = [False] * len(nodes)
    for i in range(1, len(nodes)):
        in_link[i] = nodes[i].tag == "a" or in_link[nodes[i].parent]
    for i, text in page.pieces:
        if text and not nodes[i].dropped and (n := len(" ".join(text.split()))):
            nodes[i].direct += n
            nodes[i].chars += n
            nodes[i].link_chars += n * in_link[i]
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if not node.dropped:
            up = nodes[node.parent]
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + in_link[i]
    body = next((i for i, x in enumerate(nodes) if x.tag == "body"), 0)
    links = nodes[body].link_chars / max(nodes[body].chars, 1)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if not node.dropped:
            node.density = _composite(node.chars, node.link_chars, node.tags, node.link_tags, links)
            own = node.direct * in_link[i]
            node.total += _composite(node.direct, own, 1, int(in_link[i]), links)
            if i:
                nodes[node.parent].total += node.density
    return body


def _children(nodes: list[Node], up: int) -> Iterator[int]:
    i = up + 1
    while i <= nodes[up].last:
        yield i
        i = nodes[i].last + 1


def _chosen(page: Page) -> list[tuple[int, int]]:
    """Ranges of nodes that hold the content, in page order."""
    nodes = page.nodes
    _drop(nodes)
    body = _measure(page)
    full = [i for i in range(len(nodes)) if not nodes[i].dropped and nodes[i].chars]
    if not full:
        return []
    roots = [i for i in full if nodes[i].article] or [i for i in full if nodes[i].main] or [body if nodes[body].chars else 0]
    outer: list[int] = []
    for i in roots:  # not those inside others
        if not outer or i > nodes[outer[-1]].last:
            outer.append(i)
    inside = [i for r in outer for i in range(r, nodes[r].last + 1) if not nodes[i].dropped and nodes[i].chars]
    best = max(inside, key=lambda i: (nodes[i].total, -i))
    path = [best]
    while path[-1] not in (body, 0):
        path.append(nodes[path[-1]].parent)
    threshold = min(nodes[i].density for i in path)
    root = next(r for r in outer if r <= best <= nodes[r].last)
    if nodes[root].article or nodes[root].main:  # the page says where its articles begin and end
        return [(r, nodes[r].last) for r in outer if r == root or nodes[r].density >= threshold]
    ranges = [(best, nodes[best].last)]
    if best in (body, 0):  # nothing encloses the content: what is mostly links is no part of it
        ranges = [(best, best), *((i, nodes[i].last) for i in _children(nodes, best) if 2 * nodes[i].link_chars <= nodes[i].chars)]
    for child, up in zip(path, path[1:]):
        for i in _children(nodes, up):
            node = nodes[i]
            if i != child and not node.dropped and node.chars:
                prose = node.tag in PROSE and 2 * node.link_chars <= node.chars
                if node.density >= threshold or node.tag in HEADINGS or (prose and child == best):
                    ranges.append((i, node.last))
        if nodes[up].direct and _composite(nodes[up].direct, 0, 1, 0, 0.0) >= threshold:
            ranges.append((up, up))
    return sorted(ranges)


def main_text(html: str | None) -> str:
    """The article of a page as blocks, a line each; empty without one."""
    if not html:
        return ""
    page = Page(html)
    kept = bytearray(len(page.nodes))
    for first, last in _chosen(page):
        kept[first : last + 1] = b"\x01" * (last + 1 - first)
    lines: list[str] = []
    block: list[str] = []
    for i, text in page.pieces:
        if text is None:
            if block:
                lines.append(" ".join("".join(block).split()))
                block = []
        elif kept[i] and not page.nodes[i].dropped:
            block.append(text)
    lines.append(" ".join("".join(block).split()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of `pages` (page_id, url, html), of the whole html.

    A null or empty html, and a page of nothing but boilerplate, has an empty text. A tag or
    comment that never ends takes the rest of the page, as browsers have it. Repeated rows get
    equal answers; further columns are not read. Each page stays in its task, in time linear
    in its length.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return spread(given).mapInArrow(run, "page_id long, url string, text string, n_chars long")
