"""Main text of web pages by tree scoring.

Every block of text gives points for its length and its commas to its parent, and each element hands FADE of its points on to its own; an
element's points are discounted by its link density. The best element, widened to the article that holds it, is kept with those siblings that score
alike, without the menus, notices, adverts, forms and comments inside it.

Defined cases: a null or empty page gives the empty text; markup that never closes, stray end tags and cut character references
are read as browsers read them (end tags and implied ends reach no farther than a table cell or, for items of lists, the nearest other
block); of elements with equal scores the larger one is the best, then the first; repeated rows are handled each for itself; an empty table gives an empty result; other columns of
the input are ignored. Pages are handled one at a time, so memory is bounded by the longest page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FADE = 0.4
# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select object canvas video audio".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button menu dialog fieldset label input head".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "td", "th"}
SCOPE_ENDS = frozenset("table td th body html button caption".split())
TABLE = frozenset("table caption tbody thead tfoot tr td th".split())
# A start tag ends these, if none of those lies between.
IMPLIED = {"tr": ("tr", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("tbody thead tfoot tr", ("table",)), "thead": ("tbody thead tfoot tr", ("table",)), "tfoot": ("tbody thead tfoot tr", ("table",))}
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
SPECIAL = BLOCK - {"address", "div", "p"}
# Words of class, id and role that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices popup modal overlay social share sharing related recommended comment comments disqus respond replies newsletter subscribe subscription signup widget toolbar pagination pager login skip legal gdpr complementary contentinfo search dialog alert".split())
KEPT = frozenset("article body main content post entry story".split())
# Inside an article only these, as a whole class, id or role, mark what is not its text; the first line on any element, the others on containers.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
INSERTED = FOREIGN | frozenset("banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie notice popup modal overlay social share sharing related recommended comment comments disqus respond replies newsletter subscribe subscription signup widget toolbar pagination pager login complementary contentinfo search dialog alert".split())
CONTAINERS = frozenset("div section ul ol dl table header figure center details".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())

# A quote counts after an equals sign only, and only if it closes.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "commas", "dropped", "inside", "links", "n_links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: dict):
        self.tag, self.parent, self.attrs, self.children = tag, parent, attrs, []
        self.points = 0.0
        self.size = self.links = self.n_links = self.commas = 0
        self.dropped = self.inside = False


class _Open:
    """The open elements, and where those of each name stand among them, so that nobody walks up the tree."""

    def __init__(self, top: Node):
        self.nodes, self.where, self.special, self.scopes = [top], {}, [0], [0]

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.where.setdefault(node.tag, []).append(k)
        if node.tag in SPECIAL:
            self.special.append(k)
        if node.tag in SCOPE_ENDS:
            self.scopes.append(k)

    def last(self, tag: str) -> int:
        return self.where[tag][-1] if self.where.get(tag) else 0

    def close(self, k: int) -> None:
        """Closes the elements from the k-th on; the 0th is never closed."""
        if not k:
            return
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.where[tag].pop()
            if tag in SPECIAL:
                self.special.pop()
            if tag in SCOPE_ENDS:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        k = self.last(tag)
        if tag in TABLE:
            self.close(k if tag == "table" or k > self.last("table") else 0)
        elif k >= self.scopes[-1]:  # else it lies outside the cell
            self.close(k)

    def begin(self, tag: str) -> None:
        """Closes what a start tag ends."""
        if tag in CLOSES_P and (k := self.last("p")) > self.scopes[-1]:
            self.close(k)
        if tag in ITEMS and (k := max(map(self.last, ITEMS[tag]))) == self.special[-1]:
            self.close(k)
        if tag in IMPLIED:
            closed, ends = IMPLIED[tag]
            stop = max(map(self.last, ends))
            found = [w[k] for t in closed.split() if t not in ends and (w := self.where.get(t)) and (k := bisect_right(w, stop)) < len(w)]
            self.close(min(found, default=0))


def parse(page: str) -> Node:
    """The tree of a page; text is kept as str children, references decoded run by run."""
    top = Node("html", None, {})
    held = _Open(top)
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = end if m is None else m.start()
        if stop > at:
            held.nodes[-1].children.append(entities.unescape(page[at:stop]))
        if m is None:
            break
        at = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        if m[1]:
            held.end(tag)
            continue
        if tag in ("html", "body") and len(held.nodes) == 1:
            continue
        if tag in RAW and not (tag in ("svg", "math") and m[3].endswith("/")):
            at = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at).end()
            continue
        held.begin(tag)
        attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(m[3])} if m[3].strip(" /") else {}
        new = Node(tag, held.nodes[-1], attrs)
        held.nodes[-1].children.append(new)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            held.push(new)
    return top


def _off(node: Node) -> bool:
    """Whether the element is marked as something other than the article."""
    a = node.attrs
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not node.inside:  # a page's header goes; an article's header holds its title
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    names = " ".join(a.get(k, "") for k in ("class", "id", "role"))
    if node.inside:  # what an article says of its own parts is no mark: whole names count, and of those few on a text
        whole = set(names.lower().split())
        return bool(whole & (INSERTED if node.tag in CONTAINERS else FOREIGN)) and not whole & KEPT
    marks = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()))
    return node.tag not in ("article", "main", "body") and bool(marks & MARKS) and not (marks & KEPT and node.tag in ("section", "div") and not marks & {"comment", "comments", "ad", "ads", "sidebar", "related"})


def _measure(top: Node) -> list[Node]:
    """Sizes, links, commas and points of all elements; returns them, children after parents."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        up = node.parent
        node.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        node.dropped = (up is not None and up.dropped) or _off(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        own = "" if node.dropped else WHITE.sub(" ", " ".join(c for c in node.children if isinstance(c, str))).strip()
        node.size += len(own)
        node.commas += own.count(",") + own.count("，") + own.count("、")
        if node.tag == "a":
            node.links, node.n_links = node.size, node.n_links + 1
        up = node.parent
        if up is not None:
            up.size += node.size
            up.links += node.links
            up.n_links += node.n_links
            up.points += FADE * node.points
            if node.tag not in BLOCK:
                up.commas += node.commas
            elif node.size and not node.dropped and (own or node.tag in ("p", "pre", "td", "blockquote")):
                up.points += 1 + node.commas + min(node.size / 100, 3)
    return order


def _blocks(nodes: list[Node | str], out: list[str], loose: bool) -> None:
    """Appends the text blocks of some neighbours in page order, with an explicit stack. Outside an article, lists of links are menus."""
    inline: list[str] = []

    def flush() -> None:
        text = WHITE.sub(" ", "".join(inline)).strip()
        inline.clear()
        if text:
            out.append(text)

    around = Node("div", None, {})
    around.children = nodes
    stack: list = [(around, 0)]
    while stack:
        here, k = stack.pop()
        if k == 0 and here.tag in BLOCK:
            flush()
        if k < len(here.children):
            stack.append((here, k + 1))
            child = here.children[k]
            if isinstance(child, str):
                inline.append(child)
            elif child.tag == "br":
                inline.append(" ")
            elif child.tag == "hr":
                flush()
            elif child.tag not in VOID and not child.dropped and not (loose and _linked_list(child)):
                stack.append((child, 0))
        elif here.tag in BLOCK:
            flush()
    flush()


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _linked_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.n_links >= 3 and _density(node) > 0.6


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not page or not page.strip():
        return ""
    top = parse(page)
    order = _measure(top)
    live = [n for n in order if not n.dropped and n.size]
    if not live:
        return ""
    bonus = {"article": 25, "main": 15, "div": 5, "section": 3, "td": 3, "pre": 3, "blockquote": 3}
    score = {id(n): (n.points + bonus.get(n.tag, 0)) * (1 - _density(n)) for n in live if n.points}
    if not score:
        best = top
    else:
        best = max((n for n in live if id(n) in score), key=lambda n: (score[id(n)], n.size))
        up = best
        while up is not None:  # the article around the best element belongs to it whole
            if up.tag in ("article", "main") or up.attrs.get("role") == "main":
                best = up
                break
            up = up.parent
    kept: list[Node | str] = []
    whole = best.tag in ("main", "article")  # an article is whole as it is
    for s in best.parent.children if best.parent is not None else [best]:
        if s is best:
            kept.append(s)
        elif isinstance(s, str):
            kept += [] if whole else [s]
        elif not s.dropped and s.size:
            alike = s.tag == best.tag != "main" and score.get(id(s), 0) >= max(10.0, 0.3 * score.get(id(best), 0))
            if alike or (not whole and _density(s) < 0.25 and (s.tag in TEXTS or s.tag not in BLOCK)):
                kept.append(s)
    out: list[str] = []
    _blocks(kept, out, loose=not (best.inside or whole))
    return "\n\n".join(out)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text and n_chars (code points)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x) for x in b["_html"]]
            yield pd.DataFrame({key: b[key], url: b[url], "text": text, "n_chars": [len(x) for x in text]})

    rows = pages.select(key, url, pages[html].alias("_html"))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
