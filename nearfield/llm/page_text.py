"""Main text of web pages by composite text density.

For every node of the page's tree the density is its characters per tag, adjusted by links: link text and link tags
lower it, so menus are thin and running text is dense. The sum of the densities of a node's children is highest where
dense blocks stand side by side: that node is the article, or its innermost part if sums are equal. The least density
on the path from it to the body is the threshold that parts beside the path must reach to be taken in as well; an
element called article or main on that path is taken whole. Parts that are no article by their markup (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are cut out before anything is counted.
A form, or a part hidden for its name, that holds the article or most of the page's text is not.

A null page counts as empty and gives an empty text, pages may be of any length, a null page_id stays null. Repeated
rows give repeated results; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tasks import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
NO_TEXT = frozenset(
    "head script style noscript template iframe object svg canvas audio video map title "
    "form button select textarea input option datalist dialog menu nav aside footer".split()
)
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: A start tag of the first kind ends an open paragraph, as in the HTML standard.
ENDS_PARAGRAPH = BLOCKS - frozenset("body br caption html tbody td tfoot th thead tr".split())
#: Elements that end an open one of the same kind, as far up as the second set.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements whose id is often made from their text: only a whole name marks them.
HEADED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = HEADED - {"p"}
#: Elements of running text, however short.
RUNNING = HEADED | frozenset("blockquote pre ol dl figure figcaption hr br details summary".split())
#: Elements that are a part of running text and never hold an article.
WITHIN_TEXT = HEADED | frozenset(
    "a abbr b bdi bdo big br cite code del dfn em font hr i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var".split()
)
HOLDS = frozenset(["article", "main", "body"])
#: Words in class, id, role or data-role that mark a part as no article.
NO_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies disqus footer header login masthead menu modal nav navbar "
    "navigation newsletter notice pagination pager popup promo promoted promotion related replies search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Those of them that mark a part even if it holds elements of its own called article.
NEVER_ARTICLE = frozenset("comment comments commentlist disqus related replies sidebar promo promoted promotion ad ads".split())
#: Names with such a beginning tell about the page, not about the part: has-sidebar, no-ads.
ABOUT_PAGE = re.compile(r"\b(?:has|have|with|without|no|is|not)[-_][\w-]*")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: How a line about rights begins, at the foot of a page.
IMPRINT = re.compile(r"©|\(c\)|copyright\b|impressum\b|imprint\b", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "children", "hidden", "chars", "link_chars", "tags", "link_tags", "density", "sum", "blocks")

    def __init__(self, tag: str, parent: Node | None, hidden: bool = False) -> None:
        self.tag, self.parent, self.hidden = tag, parent, hidden
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.blocks = False


class Tree(HTMLParser):
    """A tree as browsers would build it for common mistakes: unclosed paragraphs and list items, stray end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.by_name: set[int] = set()
        # hidden parts that may hold most of the page's text
        self.doubtful: list[Node] = []
        self.has_article = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag == "body":
            # whatever the head left open ends here
            self.at = self.root
        if tag in ENDS_PARAGRAPH:
            self._close(frozenset(["p"]), BLOCKS - {"p"})
        elif tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        node = Node(tag, self.at, tag in NO_TEXT or _no_article(tag, attrs, self.at))
        self.at.children.append(node)
        if node.hidden and (tag == "form" or tag not in NO_TEXT) and not _marks(attrs) & NEVER_ARTICLE:
            self.by_name.add(id(node))
            if not _unseen(attrs):
                self.doubtful.append(node)
        if tag in ("article", "main") and not node.hidden:
            self.has_article = True
            # a part that holds the article is hidden for no name it has
            above = self.at
            while above is not None:
                if id(above) in self.by_name:
                    above.hidden = False
                above = above.parent
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "iframe", "script", "path"):
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self._open("p"):
            return
        stop = HOLDS if tag not in HOLDS else frozenset()
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _open(self, tag: str) -> bool:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def _close(self, tags: frozenset, within: frozenset) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in within:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent


def _marks(attrs: list, whole: tuple[str, ...] = ()) -> set[str]:
    """Words of the names given to an element that mark it as no article; of names in the attributes ``whole`` only
    those that have no other words."""
    found: set[str] = set()
    for n, v in attrs:
        if v and n in ("class", "id", "role", "data-role"):
            names = ABOUT_PAGE.sub(" ", v.lower())
            for words in map(WORDS.findall, names.split() if n in whole else [names]):
                marks = NO_ARTICLE.intersection(words)
                if n not in whole or len(marks) == len(set(words)):
                    found |= marks
    return found


def _within_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def _unseen(attrs: list) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true"
               or name == "style" and value and "display:none" in value.replace(" ", "").lower() for name, value in attrs)


def _no_article(tag: str, attrs: list, parent: Node | None) -> bool:
    if tag in ("html", "body", "main"):
        return False
    marks = _marks(attrs)
    if tag == "article":
        return bool(marks and _marks(attrs, ("id",)) & NEVER_ARTICLE)
    if tag == "header" or marks == {"header"}:
        # a header within an article holds its title
        return not _within_article(parent)
    if marks and (tag in HEADED or _within_article(parent)):
        marks = _marks(attrs, ("class", "id"))
    return bool(marks) or _unseen(attrs)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    if tree.doubtful:
        _reveal(tree)
    return tree.root


def _reveal(tree: Tree) -> None:
    """Shows forms that hold more text outside of links than all that is visible; on pages without an article, so do
    parts hidden for their names."""
    if not any(n.hidden and (n.tag == "form" or not tree.has_article) for n in tree.doubtful):
        return
    doubtful = {id(n) for n in tree.doubtful if n.tag == "form" or not tree.has_article}
    visible = sum(len("".join(c.split())) for n in _in_order(tree.root, links=False) for c in n.children if isinstance(c, str))
    nodes, todo, held = [], [tree.root], {}
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str) and c.tag != "a")
    for node in reversed(nodes):
        own = sum(len("".join(c.split())) if isinstance(c, str) else held.get(id(c), 0) for c in node.children)
        if node.hidden and id(node) in doubtful and own > visible:
            node.hidden = False
        held[id(node)] = 0 if node.hidden else own


def _in_order(root: Node, links: bool = True) -> list[Node]:
    """Visible nodes, parents before children, without recursion; without those in links unless ``links``."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.hidden and (links or c.tag != "a"))
    return found


def measure(root: Node) -> list[Node]:
    """Fills in characters, tags, densities and sums of every visible node."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            elif not child.hidden:
                node.chars += child.chars
                node.link_chars += child.link_chars
                node.tags += child.tags + 1
                node.link_tags += child.link_tags + (child.tag == "a")
                node.blocks |= child.blocks or child.tag in BLOCKS and child.tag != "br"
        if node.tag == "a":
            node.link_chars = node.chars
    body = max(root.chars, 1)
    share = root.link_chars / body
    for node in nodes:
        node.density = composite_density(node.chars, node.link_chars, node.tags, node.link_tags, share, body)
    for node in nodes:
        node.sum = sum(c.density for c in node.children if not isinstance(c, str) and not c.hidden)
        # text that stands directly in a node counts like a child with one tag
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if own and node.tag != "a":
            node.sum += composite_density(own, 0, 1, 0, share, body)
    return nodes


def composite_density(chars: int, link_chars: int, tags: int, link_tags: int, link_share: float, body: int) -> float:
    """Characters per tag times a logarithm whose base grows with the share of link text, so that links lower it."""
    if not chars:
        return 0.0
    tags, link_tags, linked = max(tags, 1), max(link_tags, 1), max(link_chars, 1)
    plain = max(chars - link_chars, 1)
    value = chars / linked * tags / link_tags
    base = math.log(chars / plain * link_chars + link_share * chars + math.e)
    return chars / tags * math.log(max(value, 1.0)) / math.log(1.0 + base)


def main_node(root: Node) -> Node | None:
    """The node to take text from: the article around the densest node, or else the body with what is no content hidden.

    The node whose children's densities sum to most is content. The least density on its path to the body is the
    threshold that other parts beside the path must reach.
    """
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if not root.chars:
        return None
    inside = [n for n in nodes if n.chars and n.tag not in WITHIN_TEXT] or [body]
    # of equal sums the innermost: what is around it adds nothing
    best = inside[0]
    for node in inside:
        if node.sum > best.sum or node.sum == best.sum and _above(node, best):
            best = node
    path, node = [best], best
    while node is not body and node.parent is not None:
        node = node.parent
        path.append(node)
    for node in path:
        # an article whose dense part is one of several sections is taken whole
        if node.tag in ("article", "main"):
            return node
    threshold = min(n.density for n in path)
    for node, inner in zip(path, [None, *path]):
        _keep_content(node, inner, threshold, root)
    return path[-1]


def _above(node: Node, other: Node) -> bool:
    """Whether ``other`` holds ``node``."""
    while node.parent is not None:
        node = node.parent
        if node is other:
            return True
    return False


def _pieces(node: Node) -> list[list[int]]:
    """Places of the children that belong together: a block each, and runs of text with the elements within them."""
    pieces: list[list[int]] = []
    running = False
    for at, child in enumerate(node.children):
        if not isinstance(child, str) and child.hidden:
            continue
        block = not isinstance(child, str) and (child.tag in BLOCKS or child.blocks)
        if block or not running:
            pieces.append([at])
        else:
            pieces[-1].append(at)
        running = not block
    return pieces


def _text(pieces: list[Node | str]) -> str:
    return "".join(c for n in pieces for c in ([n] if isinstance(n, str) else [
        x for inner in _in_order(n) for x in inner.children if isinstance(x, str)])).strip()


def _keep_content(node: Node, inner: Node | None, threshold: float, root: Node) -> None:
    """Empties the pieces of a node before its first and behind its last piece of content.

    Above the densest node (``inner`` is the path's next node then) a piece is content if its density reaches the
    threshold and it is no line about rights, or if it is a heading right before content; what lies between must not be
    mostly links. In the densest node itself all kinds of running text are content.
    """
    pieces = _pieces(node)
    good, linked = [], []
    for places in pieces:
        own = [node.children[at] for at in places]
        first = own[0] if not isinstance(own[0], str) else None
        chars = sum(len("".join(c.split())) if isinstance(c, str) else c.chars for c in own)
        links = sum(c.link_chars for c in own if not isinstance(c, str))
        tags = sum(c.tags + 1 for c in own if not isinstance(c, str)) if len(own) > 1 or first is None else first.tags
        link_tags = sum(c.link_tags + (c.tag == "a") for c in own if not isinstance(c, str))
        density = composite_density(chars, links, tags, link_tags, root.link_chars / max(root.chars, 1), max(root.chars, 1))
        running = inner is None and first is not None and first.tag in RUNNING and 2 * links <= chars
        imprint = not running and chars < 500 and IMPRINT.match(_text(own))
        good.append(chars > 0 and (first is not None and first is inner or running or density >= threshold and not imprint))
        linked.append(2 * links > chars)
    for at in range(len(pieces) - 2, -1, -1):
        child = node.children[pieces[at][0]]
        if not isinstance(child, str) and child.tag in HEADINGS and good[at + 1] and not linked[at]:
            good[at] = True
    kept = [at for at, one in enumerate(good) if one]
    for at, places in enumerate(pieces):
        if kept and kept[0] <= at <= kept[-1] and (good[at] or inner is None or not linked[at]):
            continue
        for place in places:
            child = node.children[place]
            if isinstance(child, str):
                node.children[place] = ""
            else:
                child.hidden = True


def text_of(node: Node) -> str:
    """Blocks in page order, joined by a line break; white space inside a block is one space."""
    blocks: list[str] = []
    current: list[str] = []

    def end() -> None:
        block = SPACE.sub(" ", "".join(current)).strip()
        if block:
            blocks.append(block)
        current.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            current.append(item)
        elif not item.hidden:
            if item.tag in BLOCKS:
                end()
                todo.append(None)
            todo.extend(reversed(item.children))
    end()
    return "\n".join(blocks)


def main_text(html: str) -> str:
    root = parse(html)
    node = main_node(root)
    return text_of(node) if node is not None else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of characters for every page. A map: no shuffle."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, html in rows:
            text = main_text(html)
            yield page_id, url, text, len(text)

    return map_rows(pages, each, "page_id bigint, url string, text string, n_chars bigint")
