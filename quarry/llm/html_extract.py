"""Main-text extraction by composite text density (Sun, Song & Liao, SIGIR 2011).

Every node of the parsed page gets ``density = chars / tags`` with a composite correction for link text; a node's
density sum adds the densities of its children.  The threshold is the smallest density on the path from the body to
the node with the largest density sum, and the selected content is the maximum-sum subtree of every block that reaches it.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import prepare

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text.
NOISE = frozenset("head script style noscript template nav header footer aside form button select option textarea iframe object embed svg math canvas audio video dialog menu title noembed noframes xmp input label".split())
#: Words of class, id or role values that mark boilerplate blocks, unless the block holds the page's content (`settle`).
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus discussion replies reply respond share sharing social related recommended recommendations widget toolbar pagination pager skip search login".split()
)
#: A name with one of these tells what the page has or lacks ("has-sidebar"), not what the element is.
STATE_WORDS = frozenset("has no not with without".split())
#: Elements whose boilerplate-looking class is ignored: they are the page's main content by definition.
MAIN = frozenset("html body article main".split())
#: Of these, what a page declares to be an article.
DECLARED = frozenset("article main".split())
#: Blocks of text, which are no containers of others' articles.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd pre blockquote table figure figcaption address details summary header".split())
#: Opening one of these closes an open p.
CLOSES_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot legend summary figcaption".split())
#: Opening the key closes an open element of the value, up to a container of the third set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "suspect", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, suspect: bool = False):
        self.tag, self.parent, self.noise, self.suspect = tag, parent, noise, suspect
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its kind or hidden, and whether its class, id or role only suggests so."""
    if tag in NOISE:
        return True, False
    if not attrs.strip():
        return False, False
    suspect = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True, False
        if name in ("class", "id", "role") and tag not in MAIN and not suspect:
            for word in value.lower().split():
                found = _WORDS.findall(word)
                suspect = suspect or not NOISE_WORDS.isdisjoint(found) and STATE_WORDS.isdisjoint(found)
    return False, suspect


def _inside(node: Node | None, tags: frozenset) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> Node:
    """A forgiving tree: unclosed and stray tags, missing body and cut-off pages all give a tree."""
    root = Node("html", None)
    here, at, size = root, 0, len(page)

    def close_to(tag_set: set[str] | frozenset, stops: set[str] | frozenset) -> None:
        nonlocal here
        node = here
        while node is not None and node.parent is not None and node.tag not in stops:
            if node.tag in tag_set:
                here = node.parent
            node = node.parent

    def text(value: str) -> None:
        if value:
            here.children.append(_html.unescape(value) if "&" in value else value)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        name, attrs, closing = (m[2] or m[5] or "").lower(), m[3] or m[6] or "", bool(m[1] or m[4])
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        if closing:
            node = here
            while node is not None and node.tag != name:
                # an inline end tag doesn't reach beyond its block
                node = None if node.tag in BLOCK and name not in BLOCK and node.tag not in ("p",) else node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if name in ("html", "body"):
            if name == "body":
                close_to({"head"}, frozenset())
            continue
        if name in CLOSES_P:
            close_to({"p"}, {"article", "section", "div", "main", "td", "th", "li", "blockquote", "figure", "nav", "aside", "footer", "header", "form", "table"})
        if name in CLOSES:
            close_to(*CLOSES[name])
        if here.tag == "head" and (name in BLOCK or name == "a"):
            here = here.parent or root
        noise, suspect = _boilerplate(name, attrs)
        if name == "header" and _inside(here, DECLARED):
            noise = attrs != "" and _boilerplate("div", attrs)[0]  # the head of the article itself
        node = Node(name, here, noise, suspect)
        here.children.append(node)
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        here = node
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes outside boilerplate, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.noise]
    return order


def settle(root: Node) -> None:
    """Make suspects noise, except those that hold a main, the largest article (in the main, if there is one), or, without
    an article, most of the page's text outside links."""
    order = _walk(root)
    if not any(n.suspect for n in order):
        return
    plain: dict[int, int] = {}
    for node in reversed(order):
        own = sum(len(_SPACE.sub(" ", c).strip()) if isinstance(c, str) else plain.get(id(c), 0) for c in node.children)
        plain[id(node)] = 0 if node.tag == "a" else own
    mains = [n for n in order if n.tag == "main" and plain[id(n)]]
    held, inside = set(), {id(n) for n in mains or [root]}
    for node in order:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    articles = [n for n in order if n.tag == "article" and plain[id(n)] and id(n) in inside]
    for node in mains + ([max(articles, key=lambda n: plain[id(n)])] if articles else []):
        while node is not None:
            held.add(id(node))
            node = node.parent
    for node in order:  # beside a main or an article, a suspect is noise whatever it holds
        if node.suspect and id(node) not in held and (articles or id(node) not in inside or 2 * plain[id(node)] <= plain[id(root)]):
            node.noise = True


def measure(root: Node) -> list[Node]:
    """Fill in chars, tags, link figures, composite densities and density sums of every node."""
    order = _walk(root)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c).strip())
            elif not c.noise:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += 1 if c.tag == "a" else c.link_tags
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for node in reversed(order):
        if node.chars:
            tags, plain = max(node.tags, 1), max(node.chars - node.link_chars, 1)
            lift = node.chars / plain * node.link_chars + body_links / body_chars * node.chars + math.e
            ratio = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
            node.density = node.chars / tags * (math.log(max(ratio, 1.0 + 1e-9)) / math.log(math.log(lift) + 1.0 + 1e-9) if node.link_chars else 1.0)
        kids = [c for c in node.children if isinstance(c, Node) and not c.noise]
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        node.total = sum(c.density for c in kids) + own
    return order


def _block(node: Node) -> Node:
    while node.parent is not None and node.tag not in BLOCK:
        node = node.parent
    return node


def _article(node: Node, root: Node, threshold: float) -> Node:
    """The article that a maximum-sum subtree is part of.

    A declared article around it; else, of a block without blocks in it (a paragraph), the block that holds it.  There, text
    beside the paragraph belongs to it, but containers under the threshold are left out.
    """
    around = node
    while around is not None:
        if around.tag in DECLARED:
            return around
        around = around.parent
    if node is root or any(isinstance(c, Node) and c.tag in BLOCK and not c.noise for c in node.children):
        return node
    holder = _block(node.parent)
    for c in holder.children:
        if isinstance(c, Node) and c.tag in BLOCK and c.tag not in TEXTUAL and c.density < threshold:
            c.noise = True
    return holder


def select(root: Node) -> list[Node]:
    """The subtrees to extract, in page order; none lies in another.

    The threshold is the smallest density on the path from the body to the node with the largest density sum.  From the
    body downwards, every block whose density reaches the threshold gives the node with the largest density sum in it, so
    that an article in several blocks comes out whole; each is widened to its article (`_article`).
    """
    settle(root)
    for n in measure(root):  # outside declared articles, blocks that are mostly links are menus
        n.noise = n.noise or n is not root and n.tag in BLOCK and n.link_chars * 2 > n.chars > 0 and not _inside(n, DECLARED)
    order = [n for n in _walk(root) if n.chars]
    if not order:
        return [root]
    top = {id(n): n for n in order}  # the node with the largest sum in each subtree, the outer and earlier one of equals
    for n in reversed(order):
        kids = [top[id(c)] for c in n.children if isinstance(c, Node) and id(c) in top and not c.noise]
        top[id(n)] = max([n, *kids], key=lambda x: x.total)
    threshold, node = math.inf, _block(top[id(root)])
    while node is not None:
        threshold = min(threshold, node.density if node.density > 0 else threshold)
        node = node.parent
    chosen, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in BLOCK:
            chosen.append(_block(top[id(node)]))
        todo += [c for c in node.children if isinstance(c, Node) and id(c) in top and c.density >= threshold]
    taken = {id(_article(n, root, threshold)) for n in {id(n): n for n in chosen}.values()}
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if id(node) in taken:
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and id(c) in top]
    return found


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under ``node`` in page order; white space inside one becomes one space."""
    found: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if piece:
            value = _SPACE.sub(" ", "".join(piece)).strip()
            if value:
                found.append(value)
            piece.clear()

    todo: list = [(node, False)]
    while todo:
        item, leaving = todo.pop()
        if isinstance(item, str):
            piece.append(item)
        elif leaving:
            flush()
        elif item is not node and item.noise:
            continue
        elif item.tag == "br":
            piece.append(" ")
        else:
            if item.tag in BLOCK:
                flush()
                todo.append((item, True))
            todo += [(c, False) for c in reversed(item.children)]
    flush()
    return found


def extract(page: str | None) -> str:
    return "\n".join(x for node in select(parse(page)) for x in blocks(node)) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, plus text (main text, blocks joined by one newline) and n_chars (its code points).

    Null and empty html give an empty text, as does a page with boilerplate elements only (a class alone never empties a
    page: what holds most of its text stays); nothing is capped.  Every row is
    handled alone (a map without a shuffle): ties cannot arise, repeated rows give repeated results, an empty table
    gives an empty table.  Extra columns pass through; columns called text or n_chars are replaced.
    """
    prepare(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = pages.select(*others).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*others, F.col(html_col)).mapInArrow(_extract, schema)


def op10_html_extract(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages.select("page_id", "url", "html"))
