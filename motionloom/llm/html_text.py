"""Main text of HTML pages by composite text density.

A page is read into a DOM (implied end tags, raw text elements and unclosed inline elements are
handled; markup that is not closed is text).  Elements that by their tag or by their whole class, id
or role name are no part of an article (menus, page headers and footers, sidebars, forms, scripts,
styles, adverts, notices, reader comments) take no part.  Every other node gets the composite density
of its characters per tag, adjusted by its share of link text and of link tags against the body's;
the densities of a node's children are summed, and the node with the largest sum is the heart of the
article.  A name that holds such a word beside others, as related-work does, is only a doubt: its
sums count half, and it goes if it is mostly links or less than half as dense as the thinnest node on
the path from the body to the heart.

If the heart lies in, or directly holds, an article or main element, that element is taken.  Otherwise the
article is the lowest element around it that holds every subtree as dense as the thinnest node on
the path.  There, but never in an article or main element, blocks that are mostly links and thinner
than that are dropped.

Text is taken in page order: white space inside a block becomes one space, blocks are joined by
one space, character references are decoded.  Null and empty pages, and pages without text, give
the empty string.  Pages without an id keep a null id.  Repeated pages give repeated rows.  Only id,
url and html are read, so further columns cannot clash.  Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

#: A tag: its name ends at quotes and brackets, too.  Attributes without brackets in quotes are read at once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'<]*+)((?:[^>"'<]++|"[^"<>]*+"|'[^'<>]*+')*+)(>?)""")
_PLAIN = re.compile(r"""[^>"']*+""")
_DIGITS = re.compile(r"&#0*+([0-9]{8,});?")  # beyond Unicode, and perhaps beyond what int() takes
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER = frozenset("nav aside footer form menu head script style noscript iframe template svg math canvas object embed audio video button select textarea input label fieldset dialog title xmp noembed noframes".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
_SAME = {"li": (("li",), frozenset(("ul", "ol", "menu"))), "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))), "tr": (("tr",), frozenset(("table",))), "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))), "option": (("option",), frozenset(("select", "datalist")))}
_ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus login menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing about what an element holds, beside a word of the list above.
_GENERIC = frozenset(
    "area areas articles author bar block body bottom box button buttons center col collapse column component container content count desktop div drop dropdown fixed form global group head header footer holder icon icons image img inner item items label left lines link links list lists main meta mobile module more new news number open outer page pane panel post posts primary reader readers replies reply right row secondary section site slot small stories sticky story tab tabs text thread title toggle top topics unit user users view wide wrap wrapper zone".split()
)
_CONTENT = frozenset("article content main post story entry body text".split())
_WEAK = frozenset("alert banner modal notice notices notification popup promo toolbar widget".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in _RAW}


class _Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "density", "peak", "gone", "doubt")

    def __init__(self, tag: str, parent: _Node | None, gone: bool, doubt: bool = False):
        self.tag, self.parent, self.gone, self.doubt = tag, parent, gone, doubt
        self.kids: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density, self.peak = 0.0, -1.0  # its own, and the largest of its subtree


def _aside(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is left out by its tag or name, and whether its name leaves a doubt."""
    if tag in _NEVER:
        return True, False
    if tag == "header":
        return not inside, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    names = [_WORD.findall(x.lower()) for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()]
    every = {w for own in names for w in own}
    spared = {"sidebar"} if every & {"has", "with", "no", "without"} else set()  # such as content with-sidebar
    if every & _CONTENT:
        spared |= _WEAK
    bad = [own for own in names if _ASIDE.intersection(own) - spared]
    certain = any(not set(own) - _ASIDE - _GENERIC for own in bad)
    return certain, bool(bad) and not certain


class _TagEnds:
    """Ends of tags whose attributes hold brackets in quotes, or quotes that are not closed.

    Where reading on from a place has led to an unclosed quote is remembered, so all tags of a page together
    take time in proportion to its length.
    """

    def __init__(self, page: str):
        self.page, self.failed = page, set()
        self.last = {quote: page.rfind(quote) for quote in "\"'"}

    def find(self, place: int) -> int:
        """The place of the ``>`` that closes a tag; of the next one if a quote in the tag is not closed."""
        at, seen = place, []
        while at not in self.failed:
            seen.append(at)
            at = _PLAIN.match(self.page, at).end()
            if at == len(self.page):
                break
            quote = self.page[at]
            if quote == ">":
                return at
            if at >= self.last[quote]:
                break
            at = self.page.find(quote, at + 1) + 1
        self.failed.update(seen)
        return self.page.find(">", place)


def parse(page: str) -> _Node:
    """The DOM of a page, under a root node; left-out elements are marked."""
    root = _Node("", None, False)
    open_, n, place, last = [root], len(page), 0, page.rfind(">")
    ends = _TagEnds(page)
    depths: dict[str, list[int]] = {}  # of open elements, by tag
    blocks: list[int] = [0]  # of open blocks other than p

    def close(depth: int) -> None:
        """Close all elements from a depth on."""
        while len(open_) > depth:
            depths[open_.pop().tag].pop()
        while blocks[-1] >= depth:
            blocks.pop()

    def deepest(tags: Iterable[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    while place < n:
        start = page.find("<", place)
        if start < 0 or start > last:  # what follows is not closed
            comment = page.find("<!--", place)
            open_[-1].kids.append(page[place : n if comment < 0 else comment])
            break
        if start > place:
            open_[-1].kids.append(page[place:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            place = end + 3 if end >= 0 else n
            continue
        if page[start + 1] in "!?":
            place = page.find(">", start) + 1
            continue
        m = _TAG.match(page, start)
        if m is None:
            open_[-1].kids.append("<")
            place = start + 1
            continue
        end = m.end() - 1 if m[4] else ends.find(m.end(2))
        tag, attributes, place = m[2].lower(), page[m.end(2) : end], end + 1
        if m[1]:
            if depths.get(tag):
                close(depths[tag][-1])
            elif tag == "br":
                open_[-1].kids.append(_Node("br", open_[-1], False))
            continue
        if tag in _CLOSES_P and deepest(("p",)) > blocks[-1]:
            close(depths["p"][-1])
        if tag in _SAME:
            same, stop = _SAME[tag]
            found = deepest(same)
            if found > deepest(stop):
                close(found)
        at = open_[-1]
        gone, doubt = _aside(tag, attributes, bool(depths.get("article") or depths.get("main")))
        node = _Node(tag, at, at.gone or gone, doubt)
        at.kids.append(node)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS and tag not in _RAW:
            continue
        if tag in _RAW:
            found_end = _ENDS[tag].search(page, place)
            after = page.find(">", found_end.end()) if found_end else -1
            place = after + 1 if after >= 0 else n
            continue
        depths.setdefault(tag, []).append(len(open_))
        if tag in _BLOCKS and tag != "p":
            blocks.append(len(open_))
        open_.append(node)
    return root


def _measure(body: _Node) -> list[_Node]:
    """Counts the characters, tags and links of every node; the nodes, children first."""
    order, stack = [], [(body, False, False)]
    while stack:
        node, in_link, counted = stack.pop()
        if not counted:
            stack.append((node, in_link, True))
            stack += [(k, in_link or k.tag == "a", False) for k in reversed(node.kids) if not isinstance(k, str) and not k.gone]
            continue
        for kid in node.kids:
            if isinstance(kid, str):
                size = len("".join(kid.split()))
                node.chars += size
                node.link_chars += size * in_link
            elif not kid.gone:
                node.chars += kid.chars
                node.link_chars += kid.link_chars
                node.tags += kid.tags + 1
                node.link_tags += kid.link_tags + (kid.tag == "a")
        order.append(node)
    return order


def composite_density(node: _Node, body: _Node) -> float:
    """Characters per tag, scaled down by the node's share of link characters and link tags."""
    if not node.chars:
        return 0.0
    plain = max(node.chars - node.link_chars, 1)
    links, link_tags, tags = max(node.link_chars, 1), max(node.link_tags, 1), max(node.tags, 1)
    base = math.log(node.chars / plain * node.link_chars + body.link_chars / max(body.chars, 1) * node.chars + math.e)
    return node.chars / tags * max(math.log(node.chars / links * tags / link_tags), 0.0) / max(math.log(base) if base > 1 else 0.0, 1.0)


def _find(node: _Node, tags: tuple[str, ...]) -> list[_Node]:
    found, stack = [], [node]
    while stack:
        at = stack.pop()
        if at is not node and at.tag in tags:
            found.append(at)
        else:
            stack += [k for k in reversed(at.kids) if not isinstance(k, str) and not k.gone]
    return found


def _gather(node: _Node, least: float, doubted: float, out: list[str]) -> None:
    """Text of a node; blocks of links thinner than ``least`` and doubtful elements thinner than ``doubted`` stay out."""
    stack: list[tuple[_Node | str, bool]] = [(k, False) for k in reversed(node.kids)]
    while stack:
        kid, in_header = stack.pop()
        if isinstance(kid, str):
            if not in_header:
                out.append(kid)
            continue
        if kid.tag == "br":
            out.append(" ")
        if kid.doubt and (kid.density < doubted or 2 * kid.link_chars > kid.chars):
            continue
        if kid.gone or kid.tag in _BLOCKS and kid.link_chars > 0.6 * kid.chars and kid.link_tags > 1 and kid.density < least:
            continue
        if kid.tag in _BLOCKS:
            out.append(" ")
            stack.append((" ", False))
        in_header = (in_header or kid.tag == "header") and kid.tag not in _HEADINGS
        stack += [(k, in_header) for k in reversed(kid.kids)]


def main_text(page: str) -> str:
    """The article text of one page."""
    root = parse(page)
    body = next(iter(_find(root, ("body",))), root)
    order = _measure(body)
    if not body.chars:
        return ""
    for node in order:
        node.density = composite_density(node, body)
        node.peak = max([node.density, *(k.peak for k in node.kids if not isinstance(k, str) and not k.gone)]) if node.chars else -1.0
    doubtful: set[int] = set()
    for node in reversed(order):  # parents first
        if node.doubt or node.parent is not None and id(node.parent) in doubtful:
            doubtful.add(id(node))
    best = max(order, key=lambda x: (sum(k.density * (0.5 if k.doubt else 1) for k in x.kids if not isinstance(k, str) and not k.gone) * (0.5 if id(x) in doubtful else 1), x.chars))
    if not any(not isinstance(k, str) and not k.gone and k.chars for k in best.kids):
        best = body
    around: _Node | None = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is None:
        within = _find(best, ("article",)) or _find(best, ("main",))
        around = within[0] if len(within) == 1 and 2 * within[0].chars > best.chars else None
    best = around or best
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(x.density for x in path)
    if around is None:
        for below, at in zip(path[:-1], path[1:], strict=True):
            own = _Node("", at, False)  # the text directly in it
            own.chars = sum(len("".join(k.split())) for k in at.kids if isinstance(k, str))
            if own.chars and composite_density(own, body) >= least or any(not isinstance(k, str) and k is not below and not k.gone and k.peak >= least for k in at.kids):
                best = at
    pieces: list[str] = []
    _gather(best, least if around is None else 0.0, least / 2, pieces)
    joined = _DIGITS.sub("\ufffd", "".join(pieces))
    return " ".join(unescape(joined).split())


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text="html"):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
