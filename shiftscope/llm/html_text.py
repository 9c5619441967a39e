"""Operator 1 - main text of web pages by tree scoring.

A page is parsed into a tree of elements.  Page furniture (navigation, headers, footers,
asides, notices, adverts, forms, comments, hidden elements, scripts and styles) is cut
by element, role and words of the class and id.  Every paragraph passes points for its length and
its commas to its ancestors: all of them to the parent, half to the next, and a third of what
the one before got to each further up.  A container's points are discounted by its link density
and raised where its name or tag says that it holds content.  The container with the most
points is kept, and with it those siblings that score or read like it, and all that stands
between them.  Inside an article or main element the siblings of each level up to that element
are looked at, and stay unless they are boxes of links without a heading; elsewhere the
siblings of one level.

The text is the container's blocks in page order, one a line: character references are
decoded and each run of white space, a line break element too, is one space.

Defined results: a null or empty page has the empty text; a page without any paragraph
that scores gives the blocks of its article, main or body element; of a body, boxes of links
are left out; repeated rows come out one by one; an empty table gives an empty result; extra
columns are ignored.  Nothing is capped: a page is parsed whole, and parsing and scoring take
time in proportion to its length, however deep or unclosed its elements are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm.common import slices, table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "svg", "math")
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - set("body html td th tr tbody thead tfoot caption option optgroup legend".split())
#: An open element of the key ends where one of the value starts, unless a stop element lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
SCOPE = {"td", "th", "table", "caption", "html", "body", "button"}
#: Kinds of elements whose open ones are counted: the key's elements, within the innermost of the stops.
KINDS = [({"p"}, SCOPE), *((ENDS[t][0], ENDS[t][1]) for t in ("li", "dt", "tr", "td", "option"))]
KIND_OF = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
MATE_OF = {t: [k for k, (mates, _) in enumerate(KINDS) if t in mates] for t in set().union(*(m for m, _ in KINDS))}
STOP_OF = {t: [k for k, (_, stops) in enumerate(KINDS) if t in stops] for t in set().union(*(s for _, s in KINDS))}
CUT = set("nav footer aside form button select input fieldset dialog menu object canvas audio video search label datalist".split())
CUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CUT_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs footer foot header masthead sidebar side rail aside widget widgets ad ads adv advert adverts advertisement "
    "advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "subscribe subscription newsletter signup login share sharing social comment comments commentlist disqus reply replies respond discussion "
    "related recommended recommendations pagination pager paging toolbar search form skip hidden copyright legal disclaimer outbrain taboola teaser".split()
)
KEEP_WORDS = set("article content entry main post story text body".split())
#: Words that cut nothing where a word of the content stands beside them.
SOFT_WORDS = set("header head foot share sharing social promo legal form search side rail widget hidden skip notes banner login signup".split())
CONTENT = {"article", "main"}
PARAGRAPH = set("p pre td blockquote dd li div section".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_COMMA = re.compile(r"[,،、，﹐﹑;]")


class Node:
    __slots__ = ("boxed", "commas", "cut", "far", "kids", "links", "n_links", "near", "parent", "points", "size", "tag", "words")

    def __init__(self, tag: str, parent: Node | None, words: frozenset = frozenset()):
        self.tag, self.parent, self.words = tag, parent, words
        self.kids: list = []
        self.cut, self.boxed = False, False
        self.size = self.links = self.n_links = self.commas = 0
        self.near = self.far = self.points = 0.0


class Stack:
    """Open elements; counts of them by tag and kind tell at once whether an end has a start."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.open: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]  # by innermost block
        self.kinds: list[list[int]] = [[0] for _ in KINDS]
        self.content = 0

    def push(self, node: Node) -> None:
        tag = node.tag
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in BLOCK:
            self.inline.append({})
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        for k in MATE_OF.get(tag, ()):
            self.kinds[k][-1] += 1
        for k in STOP_OF.get(tag, ()):
            self.kinds[k].append(0)
        self.content += tag in CONTENT

    def pop(self) -> str:
        tag = self.nodes.pop().tag
        self.open[tag] -= 1
        if tag in BLOCK:
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        for k in STOP_OF.get(tag, ()):
            self.kinds[k].pop()
        for k in MATE_OF.get(tag, ()):
            self.kinds[k][-1] -= 1
        self.content -= tag in CONTENT
        return tag

    def end(self, tag: str) -> None:
        """An end tag; an inline one reaches no further than its block."""
        if (self.open if tag in BLOCK else self.inline[-1]).get(tag):
            while self.pop() != tag:
                pass

    def end_kind(self, k: int) -> None:
        """Ends the innermost open element of a kind, if one is in scope."""
        if self.kinds[k][-1]:
            n = self.kinds[k][-1]
            while len(self.kinds[k]) and self.kinds[k][-1] == n:
                self.pop()


def _look(tag: str, attrs: str) -> tuple[frozenset, bool]:
    """(words of class and id, whether role, hidden or style cut the element)."""
    if not attrs or attrs.isspace() or tag == "a":
        return frozenset(), False
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words = frozenset(w.lower() for w in _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}"))
    style = found.get("style", "").replace(" ", "").lower()
    gone = found.get("role", "").lower() in CUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    return words, gone


def _cuts(node: Node, in_content: bool) -> bool:
    if node.tag in ("html", "body", *CONTENT):
        return node.tag in CONTENT and bool(node.words & CUT_WORDS) and not node.words & KEEP_WORDS
    if node.tag in CUT:
        return True
    if node.tag == "header":
        return not in_content
    found = node.words & CUT_WORDS
    if not found or node.tag in HEADING:
        return False
    # "entry-header" is part of an entry, "post-comments" and "page-header" are not
    return bool(found - SOFT_WORDS) or not node.words & KEEP_WORDS


def parse(page: str) -> Node:
    root = Node("html", None)
    stack = Stack(root)
    nodes = stack.nodes
    at, end = 0, len(page)
    raw_ends: dict[str, re.Pattern] = {}

    def say(text: str) -> None:
        if text:
            nodes[-1].kids.append(text)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(unescape(page[at:]))
            break
        m = _TOKEN.match(page, lt)
        if m is None:  # a bare less-than sign
            say(unescape(page[at : lt + 1]))
            at = lt + 1
            continue
        say(unescape(page[at:lt]))
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # a tag that the page's end cuts off
            break
        tag = m[2].lower()
        if m[1]:
            stack.end(tag)
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            close = raw_ends.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I)).search(page, at)
            at = close.end() if close else end
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                nodes[-1].kids.append("" if tag == "wbr" else " " if tag == "br" else Node("hr", nodes[-1]))
            continue
        if tag in ENDS_P:
            stack.end_kind(0)
        if tag in ENDS:
            k = KIND_OF[tag]
            stack.end_kind(k)
            while tag == "tr" and stack.kinds[k][-1]:  # a cell and its row
                stack.end_kind(k)
        words, gone = _look(tag, m[3])
        node = Node(tag, nodes[-1], words)
        node.cut = gone or _cuts(node, stack.content > 0)
        nodes[-1].kids.append(node)
        if not m[3].rstrip().endswith("/") or tag in BLOCK:
            stack.push(node)
    return root


def _measure(root: Node) -> list[Node]:
    """Elements in page order, with what their text amounts to; cut ones are left out."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in reversed(node.kids) if type(k) is Node and not k.cut]
    for node in reversed(order):
        for k in node.kids:
            if type(k) is str:
                node.size += len(" ".join(k.split()))
                node.commas += len(_COMMA.findall(k))
        if node.tag == "a":
            node.links, node.n_links = node.size, node.n_links + 1
        up = node.parent
        if up is not None:
            up.size += node.size
            up.links += node.links
            up.n_links += node.n_links
            up.commas += node.commas
            up.boxed = up.boxed or node.boxed or node.tag in BLOCK
    return order


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _paragraph(node: Node) -> bool:
    return node.tag in PARAGRAPH and node.size >= 25 and (node.tag in ("p", "pre") or not node.boxed)


def _score(order: list[Node]) -> Node | None:
    """The container with the most points; each element hands its paragraphs' points up once."""
    best = None
    for node in reversed(order):
        if _paragraph(node):
            own = (1 + node.commas + min(node.size / 100, 3)) * (1 - _density(node))
            if node.parent is not None:
                node.parent.near += own
        if node.parent is not None:
            node.parent.far += node.near / 2 + node.far / 3
        bonus = 1.5 if node.tag in CONTENT or node.words & KEEP_WORDS else 0.7 if node.parent is None else 1.0
        node.points = (node.near + node.far) * bonus * (1 - _density(node))
    for node in order:
        if node.points and (best is None or node.points > best.points):
            best = node
    return best


def _menu(node: Node) -> bool:
    """A list or box that is several links and little else."""
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.n_links >= 3 and _density(node) > 0.7


def _ends(node: Node) -> bool:
    """Whether an element's text ends like a sentence."""
    while node.kids:
        last = next((k for k in reversed(node.kids) if (k.strip() if type(k) is str else not k.cut and k.size)), None)
        if last is None:
            return False
        if type(last) is str:
            return last.rstrip().endswith((".", "!", "?"))
        node = last
    return False


def _blocks(kids: list, menus: bool) -> list[str]:
    """The texts between borders of block elements, white space made one space; ``menus``: whether boxes of links stay."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        if line := " ".join("".join(now).split()):
            out.append(line)
        now.clear()

    todo: list = list(reversed(kids))
    while todo:
        k = todo.pop()
        if k is None:
            close()
        elif type(k) is str:
            now.append(k)
        elif not k.cut and (menus or not _menu(k)):
            if k.tag in BLOCK:
                close()
                todo.append(None)
            todo += reversed(k.kids)
    close()
    return out


def _beside(best: Node) -> list:
    """The kids of the best container's parent that stay: those that score or read like it, and what is between."""
    need = max(10.0, 0.2 * best.points)
    kids, keep = best.parent.kids, []
    for i, k in enumerate(kids):
        if type(k) is Node and not k.cut and (k is best or k.points >= need or k.tag in ("h1", "h2") or (k.tag == "p" and _density(k) < 0.25 and (k.size > 80 or _ends(k)))):
            keep.append(i)
    out, marks = [], set(keep)
    for i in range(keep[0], keep[-1] + 1):
        k = kids[i]
        if i in marks or type(k) is str or not _menu(k) or _led(kids, i):
            out.append(k)
    return out


def _led(kids: list, i: int) -> bool:
    """Whether a heading stands right before a box of links."""
    while i > 0:
        i -= 1
        if type(kids[i]) is Node or kids[i].strip():
            return type(kids[i]) is Node and kids[i].tag in HEADING
    return False


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    best = _score(order)
    if best is None:
        best = max((n for n in order if n.tag in CONTENT), key=lambda n: n.size, default=root)
        return "\n".join(_blocks([best], best is not root))
    path, top = [best], best
    while top is not None and top.tag not in CONTENT:
        top = top.parent
        path.append(top)
    if top is None:
        if best.parent is None:
            return "\n".join(_blocks([best], False))
        return "\n".join(_blocks(_beside(best), True))
    # inside an article: the siblings of each level stay unless they are boxes of links without a heading
    for node, child in zip(path[1:], path):
        node.kids = [k for i, k in enumerate(node.kids) if k is child or type(k) is str or not _menu(k) or _led(node.kids, i)]
    return "\n".join(_blocks([top], True))


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page; map-only."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(_extract, SCHEMA)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
