"""Main text of web pages by composite text density (operator 3).

A forgiving parser builds the tree of a page; menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are cut out of it by element, role, visibility and name. For every node that remains the
composite density weighs characters for each tag by how little of them is link text; a node's density sum adds those
of its children. The node with the largest sum is sought in the whole body; the least density on its path to the body
is the threshold, and the topmost nodes that reach it hold the main text. Article and main elements count like others;
they only keep what is named like boilerplate from being cut out with the article in it, and in them names cut out no
more than reader comments, adverts, link lists and other articles.

Defined results: null and empty html give an empty string and 0, as does a page without text; broken or cut off markup
is read as far as it goes; pages are read whole, in time linear in their length and depth; of nodes with equal density
sums the first in page order is taken; repeated rows are read each for itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S,
)
LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements without an end, elements whose content is no markup, and elements that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in "script style title textarea noscript iframe xmp noembed noframes".split()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br xmp".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "br", "html", "body"}
#: What ends an element that is open: new element -> (open elements that it ends, elements that shield them).
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}
SCOPE = frozenset("ul ol dl table div section article main body td th aside nav footer header form".split())
#: Elements of drawings and formulas end where one of these begins.
FOREIGN = ("svg", "math")
BREAKOUT = BLOCK | frozenset("b big br code em i img s small span strike strong sub sup tt u var".split())
DROPPED = frozenset("nav footer aside button label legend select input textarea script style noscript template iframe object embed canvas svg dialog menu title head audio video annotation".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that boilerplate is called by, and words that stand beside them in a name without changing what it means.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies feedback discussion reactions".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promoted".split())
NAMES = frozenset(
    "promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer share sharing social related recommended recommendations widget widgets toolbar pagination pager".split()
)
BESIDE = frozenset("site page global main top bottom left right inner outer wrapper wrap container content section area box block bar list item items link links button buttons icon icons module panel slot unit zone group holder region row column posts articles stories entries recent popular user users reader readers form thread body label text sticky js is desktop mobile primary secondary".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []


class _Open:
    """The open elements. The places of each name in their list are known, so nothing is sought by walking up."""

    def __init__(self):
        self.root = Node("html")
        self.path, self.places, self.scopes = [self.root], {"html": [0]}, []

    def last(self, *names: str) -> int:
        best = -1
        for n in names:
            places = self.places.get(n)
            if places and places[-1] > best:
                best = places[-1]
        return best

    def add(self, name: str, attrs: str, stays: bool) -> Node:
        child = Node(name, attrs, self.path[-1])
        self.path[-1].items.append(child)
        if stays:
            self.places.setdefault(name, []).append(len(self.path))
            if name in SCOPE:
                self.scopes.append(len(self.path))
            self.path.append(child)
        return child

    def end(self, place: int, shield: int = 0) -> None:
        """End the element at a place, and all in it, unless an element in between shields it."""
        if place <= max(0, shield):
            return
        while len(self.path) > place:
            name = self.path.pop().tag
            self.places[name].pop()
            if name in SCOPE:
                self.scopes.pop()

    def shield(self) -> int:
        return self.scopes[-1] if self.scopes else 0


def parse(page: str) -> Node:
    """The tree: each node's items are nodes and strings, in page order; character references are decoded.

    The time is linear in the page, whatever its depth.
    """
    open_, at, end = _Open(), 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None or (m.lastgroup == "text" and m["text"] == "<"):
            loose = LOOSE.match(page, at)
            if loose:
                m = loose
            elif m is None:
                break
        at = m.end()
        kind = m.groupdict()
        if kind.get("text"):
            open_.path[-1].items.append(entities.unescape(kind["text"]))
        elif kind.get("name"):
            name = kind["name"].lower()
            if kind["close"]:
                _close(open_, name)
            else:
                at = _begin(open_, name, kind["attrs"], page, at)
    return open_.root


def _begin(open_: _Open, name: str, attrs: str, page: str, at: int) -> int:
    """A new element; returns the place where reading goes on."""
    if name in ("html", "body"):
        if name == "body" and len(open_.path) == 1:
            open_.add(name, attrs, True)
        return at
    foreign = open_.last(*FOREIGN)
    inside = foreign > open_.last("foreignobject")
    if inside and name in BREAKOUT:
        open_.end(foreign)
        inside = False
    if name in CLOSES_P:
        open_.end(open_.last("p"), open_.shield())
    if name in ENDS:
        ended, shields = ENDS[name]
        open_.end(open_.last(*ended), open_.last(*shields))
    elif name == "tr":
        row = open_.last("tr")
        open_.end(row if row > open_.last("table") else open_.last("td", "th"), open_.last("table"))
    elif name == "a":
        open_.end(open_.last("a"), open_.shield())
    closed = attrs.endswith("/")
    if name in RAW and not (inside and closed):
        stop = RAW[name].search(page, at)
        if name == "xmp":
            open_.add(name, attrs, False).items.append(page[at:stop.start() if stop else len(page)])
        return stop.end() if stop else len(page)
    open_.add(name, attrs, name not in VOID and not (closed and (inside or name in FOREIGN or name not in BLOCK)))
    return at


def _close(open_: _Open, name: str) -> None:
    if name in ("html", "body"):
        return
    place = open_.last(*HEADINGS) if name in HEADINGS else open_.last(name)
    if place > 0:
        open_.end(place, 0 if name in BLOCK else open_.shield())  # an inline end tag doesn't reach beyond its block
    elif name in ("p", "br"):
        open_.add(name, "", False)


def _attrs(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)}


def verdict(node: Node, inside: bool) -> str:
    """What a node is by element, role, visibility and name: '', 'dropped', 'comment', 'advert' or 'named'.

    A name counts if all words of it are of boilerplate or stand beside such. Headings are no boilerplate.
    inside: in an article or main element.
    """
    tag = node.tag
    if tag in ("html", "body"):
        return ""
    if tag in DROPPED or tag == "header" and not inside:
        return "dropped"
    found = "named" if tag == "form" else ""
    if not node.attrs.strip():
        return found
    a = _attrs(node.attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return "dropped"
    if a.get("role", "").lower() in ROLES:
        return "dropped"
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = {w.lower() for w in WORDS.findall(name) if len(w) > 1} - BESIDE
        if not words or not words <= COMMENTS | ADVERTS | NAMES:
            continue
        if words & COMMENTS:
            return "comment"
        if words & ADVERTS and tag not in ("article", "main"):
            found = "advert"
        elif not found and tag not in HEADINGS and tag not in ("article", "main"):
            found = "named"
    return found


def boilerplate(root: Node) -> set[Node]:
    """Nodes to be cut out.

    In an article, what is only named like boilerplate goes if at least half of its text is links, or if it holds other
    articles. What holds the article, or most of the page's text outside links, stays whatever its name. The article is
    the article or main element with the most text, or one with more than half as much, if that is more than the page
    has without all that is named like boilerplate. Reader comments are no article; they are only held for their share
    of the text where there is no other article or main element.
    """
    order, is_, within, articles, lost = [], {}, {}, [], []
    stack = [(root, False, False, False)]  # in an article, in something dropped or among comments, in something lost
    while stack:
        node, inside, out, gone = stack.pop()
        is_[node], within[node] = verdict(node, inside), inside
        if is_[node] and not gone:
            lost.append(node)
        out, gone = out or is_[node] in ("dropped", "comment"), gone or bool(is_[node])
        if node.tag in ("article", "main"):
            inside = True
            if not out:
                articles.append(node)
        order.append(node)
        stack += [(x, inside, out, gone) for x in node.items if not isinstance(x, str)]
    cut = {x for x in order if is_[x] == "dropped"}
    if len(cut) == sum(map(bool, is_.values())):
        return cut
    plain: dict[Node, int] = {}
    chars: dict[Node, int] = {}
    others: dict[Node, int] = {}
    for node in reversed(order):
        kids = [x for x in node.items if not isinstance(x, str)]
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        chars[node] = own + sum(chars[x] for x in kids)
        plain[node] = 0 if node.tag == "a" else own + sum(plain[x] for x in kids)
        others[node] = sum(others[x] + (x.tag == "article") for x in kids)
    articles = [x for x in articles if plain[x]]
    stays, most = plain[root] - sum(plain[x] for x in lost), max((plain[x] for x in articles), default=0)
    held = {x for x in order if is_[x] and 2 * plain[x] > plain[root] and not (articles and is_[x] == "comment")}
    for x in articles:
        if 2 * plain[x] > most and plain[x] > stays:
            while x is not None and x not in held:
                held.add(x)
                x = x.parent
    for x in order:
        if is_[x] in ("comment", "advert") or is_[x] == "named" and (not within[x] or x.tag == "form" or others[x] or 2 * plain[x] <= chars[x]):
            if x not in held:
                cut.add(x)
    return cut


def prune(root: Node) -> None:
    """Cut out what is boilerplate, and count characters, tags and link text of the rest, bottom up."""
    cut = boilerplate(root)
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.items = [x for x in node.items if isinstance(x, str) or x not in cut]
        order.append(node)
        stack += [x for x in node.items if not isinstance(x, str)]
    for node in reversed(order):
        own = [x for x in node.items if isinstance(x, str)]
        kids = [x for x in node.items if not isinstance(x, str)]
        node.chars = sum(len("".join(x.split())) for x in own) + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = sum(k.link_tags for k in kids) + sum(k.tag == "a" for k in kids)
    body = next((x for x in order if x.tag == "body"), root)
    for node in reversed(order):
        node.density = _density(node, body)
        node.total = sum(x.density for x in node.items if not isinstance(x, str))


def _density(node: Node, body: Node) -> float:
    """Characters for each tag, times log(C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e); a 0 counts as 1."""
    c, t = node.chars, max(1, node.tags)
    lc, lt, plain = max(1, node.link_chars), max(1, node.link_tags), max(1, c - node.link_chars)
    if not c:
        return 0.0
    base = math.log(c / plain * lc + body.link_chars / max(1, body.chars) * c + math.e)
    return c / t * math.log(c / lc * t / lt) / math.log(base)


def _walk(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [k for k in reversed(x.items) if not isinstance(k, str)]


def main_nodes(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order."""
    body = next((x for x in _walk(root) if x.tag == "body"), root)
    # a text node that stands alone makes its parent dense, so a node's own density counts where it has no children
    value = lambda x: max(x.total, x.density)
    if not body.chars:
        return []
    best = max(_walk(body), key=value)
    least, x = best.density, best
    while x is not None and x is not body:
        least, x = min(least, x.density), x.parent
    found, stack = [], [body]
    while stack:
        x = stack.pop()
        if x is not body and x.chars and x.density >= least:
            found.append(x)
        else:
            stack += [k for k in reversed(x.items) if not isinstance(k, str)]
    if best is body or not found:
        return [body]
    return found


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, white space within a block as one space, blocks joined by a line break."""
    blocks, now = [], []

    def flush() -> None:
        s = " ".join("".join(now).split())
        if s:
            blocks.append(s)
        now.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif x.tag in BLOCK:
                flush()
                stack.append(None)
                stack += reversed(x.items)
            else:
                stack += reversed(x.items)
        flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return text_of(main_nodes(root))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    @F.pandas_udf("text string, n_chars long")
    def run(html: pd.Series) -> pd.DataFrame:
        texts = [main_text(p) for p in html]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", run.asNondeterministic()("html").alias("r")).select("page_id", "url", "r.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return extracted(common.table(spark, sf_dir, "pages"))
