"""Main text of HTML pages by composite text density.

A page is read into a tree; menus, forms, adverts, comments and the like are cut by their tags and names, the latter unless
they stand around the core. Each node's density is its characters per tag, raised for text outside links and lowered for text in them; a node's sum is that of its
children's densities. The node with the greatest sum is the core of the article; going up from it towards the body,
the subtree is widened as long as the density stays above the body's own. Lists of links are dropped outside the core.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Fixed values of the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br caption legend option".split()
)
CLOSES_P = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot br caption legend option".split())
#: Starting one of these ends an open one of the named, up to the border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
P_BORDER = frozenset("table td th caption button object template html body".split())
END_BORDER = frozenset("table td th caption html".split())

#: Elements and names that hold no article text.
NO_TEXT = frozenset("nav footer aside form button select option input label fieldset dialog menu head object embed audio video canvas datalist".split()) | RAW
#: Words of a class, id or role. A name is cut into words at signs, digits and capitals; one of these words tells what an
#: element is for. The first are never part of an article; the second may also name a wrapper around one, and so may the
#: first where the name ends with a word for one.
NO_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored sidebar sidebars menu menus navbar nav navigation breadcrumb breadcrumbs footer masthead "
    "comment comments disqus reply replies respond cookie cookies consent newsletter pagination pager complementary contentinfo".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
WRAPPER_OR_NOT = frozenset(
    "banner promo promos promotion notice notices alert popup modal overlay subscribe signup share sharing social related recommended recommendations toolbar widget widgets hidden skip".split()
)
WRAPPERS = frozenset("content contents body wrapper wrap container page layout text main article post entry area".split())
#: Words that make a name tell a state and not a purpose, as in has-sidebar, menu-open or overflow-hidden.
STATES = frozenset("no not has have with without is are on off open opened close closed count counter enabled disabled active overflow show shown visually free".split())
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Elements that are never cut by their attributes; that are never cut by their names; and whose id is no reason to cut them,
#: as it may be an anchor of the text.
KEPT = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORED = frozenset("p a b i em strong span li dt dd td th tr blockquote pre code".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"""["'>]""")
SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")


@lru_cache(1 << 16)
def purpose(name: str) -> int:
    """2 for a name of what is never part of an article, 1 for one that may name a wrapper too, 0 for others."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or STATES.intersection(words):
        return 0
    if COMMENT_WORDS.intersection(words):
        return 2
    if NO_TEXT_WORDS.intersection(words):
        return 1 if words[-1] in WRAPPERS else 2
    return 1 if WRAPPER_OR_NOT.intersection(words) else 0


def cut_by(attributes: str, names: Sequence[str] = ("class", "id", "role")) -> tuple[bool, int]:
    """Whether an element is hidden, and whether it is named as one without article text, by purpose()."""
    hidden, named = False, 0
    seen = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in seen:
            continue  # the first of a name holds
        seen.add(name)
        if name == "hidden":
            hidden = hidden or value.strip().lower() != "false"
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name == "style":
            hidden = hidden or bool(NO_DISPLAY.search(html.unescape(value)))
        elif name in names:
            named = max([named, *(purpose(x) for x in value.split())])
    return hidden, named


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether it ends an element, its name, attributes) of each tag; comments and declarations have no name.

    Quoted values may hold any sign. From the first tag on that a missing quote leaves open to the page's end, tags end
    at the next `>`. A comment without an end reaches to the page's end. Every character is looked at a few times.
    """
    place, quotes = 0, True
    while (start := page.find("<", place)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            place = len(page) if end < 0 else end + 3
            yield start, place, False, None, ""
            continue
        name = NAME.match(page, start + 1)
        if not name:
            place = start + 1
            if page[place : place + 1] in ("!", "?", "/"):
                end = page.find(">", place)
                if end < 0:
                    return
                place = end + 1
                yield start, place, False, None, ""
            continue
        end = -1
        if quotes:
            at = name.end()
            while (mark := MARK.search(page, at)) and mark[0] != ">":
                at = page.find(mark[0], mark.end()) + 1
                if not at:
                    mark = None
                    break
            if mark:
                end = mark.start()
            else:
                quotes = False
        if end < 0:
            end = page.find(">", name.end())
            if end < 0:
                return
        place = end + 1
        yield start, place, bool(name[1]), name[2].lower(), page[name.end() : end]


class Node:
    __slots__ = ("chars", "children", "cut", "density", "link_chars", "link_tags", "named", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, cut: bool):
        self.tag, self.parent, self.cut, self.named = tag, parent, cut, 0
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def tree(page: str) -> Node:
    """The page's elements and texts, with left-out end tags supplied.

    Open elements are counted by their tag, so that no walk up the tree is made for one that isn't open.
    """
    root = at = Node("html", None, False)
    place = skip = 0
    open_: Counter[str] = Counter()

    def climb(to: Node) -> Node:
        node = at
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent
        return to

    for start, end, closing, name, attributes in tokens(page):
        if start < skip:
            continue  # inside an element whose content is no markup
        if start > place:
            at.children.append(page[place:start])
        place = end
        if name is None:
            continue
        if closing:
            node = at if open_[name] else root
            while node is not root and node.tag != name:
                if node.tag in END_BORDER and name not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot", "article", "main", "section", "div"):
                    node = root
                    break
                node = node.parent
            if node is not root:
                at = climb(node.parent)
            elif name == "p":
                at.children.append(Node("p", at, False))
            continue
        if name == "html" and at is root:
            continue
        if name in CLOSES_P and open_["p"]:
            node = at
            while node is not root and node.tag not in P_BORDER and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                at = climb(node.parent)
        if name in ENDS and any(open_[x] for x in ENDS[name][0]):
            closed, border = ENDS[name]
            node, up = at, None
            while node is not root and node.tag not in border:
                if node.tag in closed:
                    up = node.parent
                node = node.parent
            if up is not None:
                at = climb(up)
        if name == "body" and at.tag == "head":
            at = climb(at.parent)
        cut = name in NO_TEXT
        named = 0
        if attributes and not cut and name not in KEPT:
            cut, named = cut_by(attributes, () if name in HEADINGS else ("class", "role") if name in ANCHORED else ("class", "id", "role"))
        if name == "header" and not cut:
            cut = not (open_["article"] or open_["main"])
        if name in RAW:
            if not attributes.endswith("/"):
                last = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, place)
                place = skip = last.end() if last else len(page)
            continue
        node = Node(name, at, cut)
        node.named = named
        at.children.append(node)
        if name not in VOID and not attributes.endswith("/"):
            at = node
            open_[name] += 1
    if place < len(page):
        at.children.append(page[place:])
    return root


def kept_nodes(root: Node) -> list[Node]:
    """Nodes that aren't cut, nor below one that is, in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    return order


def cut_named(root: Node) -> None:
    """Cuts the elements that are named as no part of an article, whatever their size.

    Those that never are go first, unless they are around the page's main element or first heading. Then the core of what
    is left is found, without those that may be wrappers where an article or main element stands outside them, and of
    these all go that aren't around it.
    """
    order = kept_nodes(root)
    if not any(n.named for n in order):
        return
    holds: set[int] = set()  # nodes around a main element or a first heading
    for node in order:
        if node.tag in ("main", "h1"):
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for node in order:
        node.cut = node.cut or node.named == 2 and id(node) not in holds
    order = kept_nodes(root)
    doubtful = [n for n in order if n.named]
    if not doubtful:
        return
    below: set[int] = set()
    for node in order:  # parents come first
        if node.named or id(node.parent) in below:
            below.add(id(node))
    aside = any(n.tag in ("article", "main") and id(n) not in below and any(isinstance(c, Node) or c.strip() for c in n.children) for n in order)
    for node in doubtful:
        node.cut = aside
    core = core_of(root)[0]
    around: set[int] = set()
    while core is not None:
        around.add(id(core))
        core = core.parent
    for node in doubtful:
        node.cut = id(node) not in around


def measure(root: Node) -> list[Node]:
    """Counts of every node, in page order; cut nodes are left out."""
    order = kept_nodes(root)
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.sum = 0.0
    for node in reversed(order):
        node.chars += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    return order


def densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t = node.chars, max(node.tags, 1)
        if not c:
            continue
        outside = max(c - node.link_chars, 1)
        base = math.log(c / outside * node.link_chars + share * c + math.e)
        ratio = c / max(node.link_chars, 1) * t / max(node.link_tags, 1)
        node.density = c / t * (math.log(ratio) / math.log(base) if base > 1.0001 and ratio > 0 else math.log(max(ratio, 1e-9)) * 10_000)
    for node in order:
        if node.parent is not None:
            node.parent.sum += node.density


def blocks_of(top: Node, core: Node | None) -> list[str]:
    """Texts of a subtree's blocks in page order, with white space made one space and references decoded.

    Lists of links are left out where they stand outside the core.
    """
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip(" ")
        if text:
            out.append(text)
        run.clear()

    inside: set[int] = set()
    around: set[int] = set()
    above = core
    while above is not None:
        around.add(id(above))
        above = above.parent
    todo: list = [top]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        elif not item.cut:
            if item.tag in BLOCKS:
                end()
                todo.append(None)
            if item is core or id(item.parent) in inside:
                inside.add(id(item))
            elif id(item) not in around and item.link_tags > 1 and item.tag in BLOCKS and item.link_chars > 0.6 * item.chars:
                continue  # a list of links
            todo.extend(reversed(item.children))
    end()
    return out


def core_of(root: Node) -> tuple[Node | None, Node | None]:
    """(core, body): the node of the greatest sum of densities and the body; no body where there is no text."""
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if not body.chars:
        body = root
    if not body.chars:
        return None, None
    densities(order, body)
    core = max(order[order.index(body) :], key=lambda n: n.sum)
    return (core if core.sum > 0 else None), body


def main_text(page: str | None) -> str:
    """A page's main text; empty for a null page and one without text."""
    if not page:
        return ""
    root = tree(page)
    cut_named(root)
    chosen, body = core_of(root)
    if body is None:
        return ""
    best = node = chosen or body
    while node is not body and node.parent is not None and node is not root:
        node = node.parent
        if node is body or node.density < body.density:
            break
        best = node
    return "\n".join(blocks_of(best, chosen))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row.

    A null or empty HTML gives an empty text. Pages of any length are read whole. Repeated rows give repeated results, and
    ids and URLs, null ones too, stay as they are. An empty table gives an empty result. Columns other than the three named
    don't matter, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    bounded_batches(pages)
    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
