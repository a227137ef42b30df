"""Main text of web pages by tree scoring.

A page is parsed into a tree of blocks. Each paragraph gives points to its ancestors, for being one, for its commas and
for its length; a container's points are discounted by its share of link text. The container with the most points
holds the article, and those of its siblings that score well or read like prose stay with it. Names of classes and
kinds of elements lower what is given through them. Inside the chosen container, menus, asides, forms, adverts, notices
and reader comments are left out, and what only may be such if its links or controls say so as well.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, text_str

# Element names, and words of class and id names. An element whose name is in HIDDEN is never shown; one
# in ASIDE isn't article text by its kind; STRONG names say the same, WEAK ones only make it likely.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object svg math canvas audio video button select textarea input datalist".split())
ASIDE = frozenset("nav aside footer menu dialog form".split())
CONTROLS = frozenset("input select textarea button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr html body".split())
# an opening tag that ends an open one of the same family, up to the element that holds the family
ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRONG = frozenset("ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments commentlist disqus replies respond cookie cookies consent gdpr notice popup modal overlay share sharing social related recommended newsletter subscribe signup login pagination pager toolbar outbrain taboola".split())
WEAK = frozenset("promo banner header masthead footer foot side rail widget widgets reply discussion search copyright legal disclaimer skip tags meta".split())
GOOD = frozenset("article body content entry main page post text blog story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# attribute values in quotes may hold ">"; a quote counts only right after "="
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
NAME = re.compile(r"[a-z]+", re.I)
SPACES = re.compile(r"\s+")
MALUS = 0.1  # what is left of points given through an element that is likely not article text


class Node:
    __slots__ = ("tag", "parent", "children", "hidden", "aside", "weak", "good", "points", "bonus", "scored", "weight", "length", "links", "commas", "paragraphs", "controls")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.hidden = self.aside = self.weak = self.good = self.scored = False
        self.points = self.bonus = 0.0
        self.weight = 1.0
        self.length = self.links = self.commas = self.paragraphs = self.controls = 0

    @property
    def density(self) -> float:
        return self.links / max(1, self.length)

    @property
    def worth(self) -> float:
        """Points discounted by the share of link text, and by where the container stands."""
        return (self.points + self.bonus) * (1 - self.density) * self.weight


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def judge(node: Node, source: str) -> None:
    node.hidden, node.aside = node.tag in HIDDEN, node.tag in ASIDE
    if source and not source.isspace():
        a = attributes(source)
        names = {x.lower() for x in NAME.findall(f"{a.get('class', '')} {a.get('id', '')}")}
        node.good = bool(names & GOOD) or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody"
        if node.tag in ("body", "html"):
            return
        style = a.get("style", "").replace(" ", "").lower()
        node.hidden |= "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style
        # "post" beside "comments" or "share" doesn't make them text; it does for names that are weak by themselves
        node.aside |= bool(names & STRONG) or a.get("role") in ROLES
        node.weak = bool(names & WEAK) and not node.good


class Stack:
    """Open elements, and where those of each name stand, so that a look-up takes no walk."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def open(self, name: str, upto: tuple[str, ...] = ()) -> int | None:
        """Place of the last open element of a name, if none of `upto` was opened after it."""
        own = self.places.get(name)
        if not own or any(self.places.get(x) and self.places[x][-1] > own[-1] for x in upto):
            return None
        return own[-1]

    def close(self, place: int) -> None:
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]


def parse(page: str) -> Node:
    root = Node("html", None)
    stack, at = Stack(root), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        now = stack.nodes[-1]
        if not m:
            now.children.append(page[at:])
            break
        if m.start() > at:
            now.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            place = stack.open(name, ("article", "section", "div", "table", "body") if name == "p" else ("table",) if name not in ("table", "body") and name in CLOSES_P else ())
            if place is not None and name != "body":
                stack.close(place)
            continue
        if name == "html" or name == "body" and stack.open("body") is not None:
            continue
        if name in CLOSES_P and (place := stack.open("p", ("table", "td", "th", "button", "object"))) is not None:
            stack.close(place)
        if name in ENDS:
            family, upto = ENDS[name]
            for old in family.split():
                if (place := stack.open(old, upto)) is not None:
                    stack.close(place)
        if name in HEADINGS and stack.nodes[-1].tag in HEADINGS:
            stack.close(len(stack.nodes) - 1)
        now = stack.nodes[-1]
        node = Node(name, now)
        judge(node, m[3])
        now.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            stack.push(node)
    return root


def nodes(root: Node) -> list[Node]:
    """All elements that are shown, parents first, with their weights."""
    out, todo = [], [(root, False)]
    while todo:
        n, within = todo.pop()
        if n.hidden:
            continue
        if n.tag == "header" and not within:
            n.aside = True
        if n.parent is not None:
            n.weight = n.parent.weight * (MALUS if n.aside or n.weak else 1)
        out.append(n)
        within |= n.tag in ("article", "main")
        todo += [(c, within) for c in reversed(n.children) if isinstance(c, Node)]
    return out


def score(root: Node) -> Node | None:
    """Gives points to containers and returns the best; None if there is no text, or only such as is no article's."""
    every = nodes(root)
    for n in reversed(every):
        for c in n.children:
            if isinstance(c, str):
                n.length += len(c.strip())
                n.commas += c.count(",") + c.count("，") + c.count("、")
            else:
                n.controls += c.controls + (c.tag in CONTROLS)
                if not c.hidden and not c.aside:
                    n.length += c.length
                    n.commas += c.commas
                    n.links += c.length if c.tag == "a" else c.links
                    n.paragraphs += c.paragraphs
        n.paragraphs += n.tag == "p" and n.length >= 25
    for n in every:
        # a paragraph is a block that holds text itself, or in inline markup
        if n.tag in BLOCK and n.length and (n.tag in ("p", "pre", "td", "blockquote", "li", "dd") or any(isinstance(c, str) and not c.isspace() for c in n.children)):
            own = 1 + n.commas + min(n.length / 100, 3)
            if n.length < 25:
                own = 0.5 if n.tag == "p" else 0
            up, share = n.parent or n, 1.0
            for level in range(4):
                if up is None:
                    break
                if up.tag in BLOCK:
                    if not up.scored:
                        up.scored = True
                        up.bonus = {"article": 25, "main": 15, "div": 5, "section": 3}.get(up.tag, 0) + 25 * up.good
                    up.points += own * share * n.weight / up.weight
                    share = {0: 0.5, 1: 0.3}.get(level, 0.15)
                up = up.parent
    scored = [n for n in every if n.scored and n.length]
    if not scored:
        return None if any(n.aside for n in every) or not root.length else root
    best = whole(max(scored, key=lambda n: n.worth))
    n = best
    while n is not None:
        if n.aside and (n.tag in ASIDE - {"form"} or n.tag == "header" or n.paragraphs < 2):
            return None
        n = n.parent
    return best


def whole(best: Node) -> Node:
    """The container, or the innermost article around it, if the rest of that is text of the same article by its links and points."""
    n = best.parent
    while n is not None and n.tag not in ("article", "main"):
        n = n.parent
    if n is None:
        return best
    others = sum(1 for c in n.children if isinstance(c, Node) and c.tag == "article" and not c.aside)
    rest, links = n.length - best.length, n.links - best.links
    return n if others < 2 and links <= 0.33 * max(1, rest) and n.worth >= 0.2 * best.worth else best


def kept(best: Node) -> list[Node]:
    """The best container with those siblings that belong to the article, in page order."""
    parent = best.parent
    if parent is None or parent.tag == "html":
        return [best]
    least = max(10.0, best.points * 0.2)
    out = []
    for c in parent.children:
        if not isinstance(c, Node) or c.hidden or c.aside and c is not best:
            continue
        if c is best or c.scored and c.points * (1 - c.density) >= least and not c.weak:
            out.append(c)
        elif best.tag not in ("article", "main") and not c.weak and c.length:
            # paragraphs and titles beside it
            title = c.tag in HEADINGS or c.tag in ("header", "hgroup") and any(isinstance(x, Node) and x.tag in HEADINGS for x in c.children)
            if title and not c.links or c.tag == "p" and (c.length > 80 and c.density < 0.25 or c.length <= 80 and not c.links):
                out.append(c)
    return out


def left_out(node: Node, within: Node) -> bool:
    """Whether an element inside the article isn't part of it. Names alone don't take away what holds most of the text."""
    if node.hidden:
        return True
    if node.aside:
        return node.tag in ASIDE - {"form"} or 2 * node.length <= within.length
    return node.weak and (node.density > 0.5 or node.controls > 0) and 2 * node.length <= within.length


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif n is not node and left_out(n, node):
            continue
        elif n.tag == "hr":
            flush()
        elif n.tag == "br":
            line.append(" ")
        elif n.tag not in VOID:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(n.children)
    flush()
    return out


def main_text(page: str) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    best = score(parse(page))
    return "" if best is None else "\n".join(b for n in kept(best) for b in blocks(n))


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars.

    Null and empty pages, and pages without text, give an empty text. Repeated rows, null ids and null urls stay as
    they are; an empty table gives an empty table; other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def fn():
        def work(batch):
            texts = [main_text(x) for x in text_str(batch, html_col)]
            return {id_col: batch.column(id_col), url_col: batch.column(url_col), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return per_row(pages, [F.col(f"`{c}`") for c in (id_col, url_col, html_col)], f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long", fn)
