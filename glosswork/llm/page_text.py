"""Main text of web pages by composite text density.

A page's tags become a tree in which what is surely not the article (scripts, menus, forms, and parts that say by role or
name that they are notices, adverts or comments) is left out. For every other node the density is its characters per tag,
adjusted for links. The subtree whose children's densities have the largest sum is the article's body; the least density on
the way from it up to the page's body is the threshold for other parts. Each page is one row, worked on inside its Spark task.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import fresh, ship_by_value, texts_in

#: Kinds of elements in the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript textarea title template".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
br option""".split())
DROPPED = set("""head script style noscript template iframe object embed applet svg canvas nav aside footer button select
textarea input label fieldset dialog menu title xmp noembed noframes audio video map""".split())
#: An element of the first kind ends open elements of the second, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCK - {"br", "option", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SCOPE = {"table", "td", "th", "body", "html", "div", "section", "article", "main", "blockquote", "li", "figure", "aside", "object",
          "button", "nav", "footer", "header", "form"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NAMES = re.compile(r"""(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banners?|sponsor\w*|promos?|promotions?|cookies?|consent|gdpr|
notices?|newsletters?|subscri\w*|signup|shar(?:e|ing)|socials?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|masthead|
comments?|commentlist|disqus|repl(?:y|ies)|respond|reactions|related|recommend\w*|popups?|modals?|overlay|widgets?|toolbars?|paginat\w*|
pager|login|search)(?:$|[\s_-])""", re.X | re.I)
#: Of these, names that the wrapper of an article often has beside its own.
_WRAPPERS = re.compile(r"(?:^|[\s_-])(?:sidebars?|menus?|nav|navbar|footers?|widgets?|login|search|overlay|banners?|ads?|shar(?:e|ing)|socials?)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")


#: Classes that tell a state or a layout and not what an element is.
_STATES = re.compile(r"(?<!\S)(?:(?:has|no|with|without)-\S+|\S+-(?:open|closed|enabled|disabled|on|off))(?!\S)", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, drop: int = 0):
        self.tag, self.parent, self.drop, self.parts = tag, parent, drop, []
        if parent is not None:
            parent.parts.append(self)


def _named_away(tag: str, attributes: str) -> int:
    """Whether an element's role, name or state says that it isn't part of an article: 2 if surely, 3 by a name or 1 by one
    that wrappers have, both of which ``_prune`` looks at again, 0 if not."""
    if not attributes and tag == "form":
        return 3
    if not attributes or tag in ("html", "body", "main", "article"):
        hidden = {k.lower() for k, _ in _ATTRIBUTE.findall(attributes)} if attributes else ()
        if tag != "article" or not attributes:
            return 2 * ("hidden" in hidden)
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "role" and value.lower() in ROLES:
            return 2
        if name == "class":
            value = _STATES.sub(" ", value)
        if name in ("class", "id") and _NAMES.search(value):
            return 1 if _WRAPPERS.search(value) else 3
    return 3 * (tag == "form")


def parse(page: str) -> Node:
    """The tree of a page. It takes anything: what is missing is closed, what doesn't match is passed over."""
    root = Node("html", None)
    at, here = 0, root
    opened: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain

    def back_to(outer: Node) -> Node:
        node = here
        while node is not outer:
            opened[node.tag] -= 1
            node = node.parent
        return outer

    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            here.parts.append(page[at:])
            break
        if mark > at:
            here.parts.append(page[at:mark])
        found = _TAG.match(page, mark) or _LOOSE.match(page, mark)
        if found is None:
            here.parts.append("<")  # not markup
            at = mark + 1
            continue
        at = found.end()
        if not found[2]:
            continue  # a comment or a declaration
        tag = found[2].lower()
        if found[1]:
            node = here if opened[tag] else root
            while node is not root and node.tag != tag:
                if node.tag in ("table", "body") and tag in ("b", "i", "a", "span", "em", "strong", "p"):
                    node = root
                    break
                node = node.parent
            if node is not root:
                here = back_to(node.parent)
            elif tag == "br" or tag == "p":
                here.parts.append(" ")
            continue
        if tag in _ENDS_P and opened["p"]:
            here = back_to(_close(here, {"p"}, _SCOPE))
        if tag in ENDS and any(opened[t] for t in ENDS[tag][0]):
            here = back_to(_close(here, *ENDS[tag]))
        if tag in ("html", "body") and not _named_away(tag, found[3]):
            if tag == "body":
                here = Node(tag, back_to(here.parent) if here.tag == "head" else here)
                opened[tag] += 1
            continue
        if here.tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            here = back_to(here.parent)  # the head ends where something else begins
        node = Node(tag, here, 2 * (tag in DROPPED) or _named_away(tag, found[3]))
        if tag in VOID or found[3].endswith("/") and tag in ("svg", "path", "iframe"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            if end is None:
                break
            node.parts.append(page[at:end.start()])
            close = page.find(">", end.end())
            at = len(page) if close < 0 else close + 1
            continue
        here = node
        opened[tag] += 1
    return root


def _close(here: Node, ended: set[str], stops: set[str]) -> Node:
    """The parent of the nearest open element that is ended, or the same place."""
    node = here
    while node.parent is not None and node.tag not in stops:
        if node.tag in ended:
            outer = node.parent
            while outer.tag in ended and outer.parent is not None:
                outer = outer.parent
            return outer
        node = node.parent
    return here


def _preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.drop]
    return out


def _sizes(root: Node) -> tuple[dict[Node, int], set[Node]]:
    """The characters under each node, without those that no mark can bring back, and the nodes above an article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    sizes, above = {}, set()
    for node in reversed(order):  # children first
        inner = [p for p in node.parts if isinstance(p, Node)]
        sizes[node] = sum(len(p.strip()) for p in node.parts if isinstance(p, str)) + sum(sizes[p] for p in inner if p.drop != 2)
        if any(p in above or p.tag in ("article", "main") and not p.drop for p in inner):
            above.add(node)
    return sizes, above


def _prune(root: Node) -> None:
    """Keep an element that only a name marks if it holds most of the page's text, or is named as wrappers are, or a form, and
    holds an article."""
    found, stack = None, [(root, False)]
    while stack:
        node, in_article = stack.pop()
        for part in node.parts:
            if not isinstance(part, Node):
                continue
            inside = in_article or part.tag in ("article", "main")
            if part.tag == "header":
                if not inside:
                    part.drop = 2
            elif part.drop in (1, 3):
                sizes, above = found = found or _sizes(root)
                holds = part.tag != "article" and part in above and (part.drop == 1 or part.tag == "form")
                most = (5 * sizes[part] > 4 * sizes[root] if part.drop == 1 else 2 * sizes[part] > sizes[root]) and sizes[part] > 0
                part.drop = 0 if holds or most else 2
            if not part.drop:
                stack.append((part, inside))


def _measure(order: list[Node]) -> None:
    """Characters, tags and those of links under each node, its density, and the sum of its children's densities."""
    for node in reversed(order):  # children first
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part.strip())
            elif not part.drop:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, max(node.link_tags, 1)
    body = order[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        if not node.chars:
            node.density = 0.0
            continue
        tags, plain = max(node.tags, 1), max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        inner = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
        node.density = node.chars / tags * max(math.log(max(inner, 1.0)), 0.0) / base
    for node in order:
        node.sum = sum(p.density for p in node.parts if isinstance(p, Node) and not p.drop)


def _strongest(order: list[Node]) -> Node:
    return max(order, key=lambda n: n.sum)  # of equal ones the first in page order


def main_nodes(root: Node) -> list[Node]:
    """The marked parts of a page, in page order."""
    _prune(root)
    bodies = [n for n in _preorder(root) if n.tag == "body"]
    order = _preorder(bodies[0] if len(bodies) == 1 else root)
    _measure(order)
    top = order[0]
    if not top.chars:
        return []
    best = _strongest(order)
    if best.sum == 0:
        return [top]
    up, article, region, threshold = best, None, None, best.density
    while True:
        threshold = min(threshold, up.density)
        if up.tag == "article":
            article = up
        if up.tag in ("article", "main"):
            region = up
        if up is top:
            break
        up = up.parent
    best = article or best  # the page itself says how far the article goes; other parts still need the density
    marked, stack, path, up = [], [top], set(), best
    while up is not None:
        path.add(up)
        up = up.parent
    titles = {n for n in _preorder(region) if n.tag == "h1"} if region is not None else set()
    while stack:
        node = stack.pop()
        if node is best or node in titles or node is not top and node not in path and (
                node.density >= threshold and node.chars and node.tag in BLOCK):
            marked.append(node)
        elif node.tag != "a" or node in path:  # what is inside a link has no density of its own
            stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.drop]
    return marked


def rendered(nodes: list[Node]) -> str:
    out: list[str] = []
    for top in nodes:
        out.append(" ")
        stack: list = [top]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif not part.drop:
                inner = part.parts
                stack += [" ", *reversed(inner), " "] if part.tag in BLOCK else reversed(inner)
    return " ".join(html.unescape("".join(out)).split())


def main_text(page: str | None) -> str:
    return rendered(main_nodes(parse(page))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of each page: its blocks joined by one space, white space within a block turned into one space.

    Character references are decoded. A null or empty page, and one without an article, has an empty text. Long pages are
    read whole; repeated rows stay; an empty table gives none. A column of that name is replaced, others stay.
    """
    at = fresh(pages, "_html")
    wanted = pages.drop(name).withColumn(at, F.col(html_col)) if html_col.lower() != name.lower() else pages.withColumn(
        at, F.col(html_col)).drop(name)
    kept = [c for c in wanted.columns if c != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_in(batches, at):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([main_text(t) for t in texts], pa.string())], [*kept, name])

    return wanted.mapInArrow(run, wanted.select(kept).withColumn(name, F.lit("")).schema)


ship_by_value(__name__)
