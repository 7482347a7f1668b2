"""Main text of web pages by composite text density.

The page is parsed to a tree. For a node with C characters of text under it, T tags, of which C_l
and T_l in links, and with the page body's C_b and C_lb, the composite density is

    C / T * ln(C * T / (C_l * T_l)) / ln(ln(C * C_l / (C - C_l) + C_lb * C / C_b + e))

with every count, and C - C_l, at least one, and the first logarithm at least zero. It is high for long text
in few tags and falls with the share of links. The density sum of a node is that of its children. The content is looked for from the node of the
largest density sum: the least density on its path up to the body, the body left out (it has every
navigation bar's links, and short plain notices would pass it), is the threshold, and within each child
of the body at or above it the subtree with the largest sum is taken.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.names import named
from palimpsest.storage import ship

OUT = "page_id long, title string, text string, n_chars int, n_nodes int, threshold double, max_sum double"

#: A quote delimits an attribute's value only right after the equals sign.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)""", re.S)
#: Elements nested deeper than this become siblings, as in browsers; their text is kept.
MAX_DEPTH = 512
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript template svg head iframe object select button".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Open elements that a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Elements beyond which an implied end doesn't reach.
_WALL = frozenset("table ul ol dl body html div article section td th".split())
_P_ENDS = _BLOCK - {"br", "body", "html", "td", "th", "tr", "li", "tbody", "thead", "tfoot"}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "skip", "depth", "c", "t", "lc", "lt", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.depth = 0 if parent is None else parent.depth + 1
        self.skip = tag in _SKIP or (parent is not None and parent.skip)
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.sum = 0.0


def parse(source: str) -> tuple[Node, str]:
    """(root, title). Kids are nodes and strings; text has its references resolved."""
    root = Node("html", None)
    at, here, title, end = 0, root, "", len(source)

    def text(a: int, b: int) -> None:
        if a < b and not here.skip:
            s = source[a:b]
            here.kids.append(html.unescape(s) if "&" in s else s)

    find = _TOKEN.search
    while at < end:
        m = find(source, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            n = here
            while n is not root and n.tag != tag:  # MAX_DEPTH steps at most
                n = n.parent
            if n is not root:
                here = n.parent
            continue
        if tag == "html":
            continue
        if tag in _P_ENDS and here.tag == "p":
            here = here.parent
        elif tag in _P_ENDS:  # an open p may lie under inline elements
            n = here
            while n.tag not in _WALL and n.tag != "p":
                n = n.parent
            if n.tag == "p":
                here = n.parent
        if tag in _ENDS:
            n, hit = here, None
            while n.parent is not None and (n.tag not in _WALL or n.tag in _ENDS[tag]):
                if n.tag in _ENDS[tag]:
                    hit = n
                n = n.parent
            if hit is not None:
                here = hit.parent
        if tag == "body":
            here = root
            body = next((k for k in root.kids if isinstance(k, Node) and k.tag == "body"), None)
            if body is not None:
                here = body
                continue
        if here.depth >= MAX_DEPTH:
            here = here.parent
        node = Node(tag, here)
        here.kids.append(node)
        if tag in _RAW:
            close = _RAW[tag].search(source, at)
            stop = close.start() if close else end
            if tag == "title" and not title:
                title = _SPACE.sub(" ", html.unescape(source[at:stop])).strip()
            elif not node.skip and tag not in ("title", "iframe"):
                node.kids.append(source[at:stop])
            at = close.end() if close else end
        elif tag not in _VOID and not m.group(3).rstrip().endswith("/"):
            here = node
        elif tag not in _VOID:
            here = node if tag not in ("svg", "path") else here
    return root, title


def _post(root: Node) -> list[Node]:
    """Nodes, children before parents, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in n.kids if isinstance(k, Node)]
    return out[::-1]


def measured(root: Node) -> list[Node]:
    """Counts, densities and sums of all nodes, children first."""
    nodes = _post(root)
    for n in nodes:
        for k in n.kids:
            if isinstance(k, Node):
                n.c += k.c
                n.t += k.t + (not k.skip)
                n.lc += k.lc
                n.lt += k.lt
            else:
                n.c += len(_SPACE.sub(" ", k).strip())
        if n.tag == "a":
            n.lc, n.lt = n.c, n.t + 1
    body = body_of(root)
    c_b, lc_b = max(1, body.c), max(1, body.lc)
    for n in nodes:
        if n.c and not n.skip:
            n.density = density(n.c, n.t, n.lc, n.lt, c_b, lc_b)
        n.sum = sum(k.density for k in n.kids if isinstance(k, Node))
    return nodes


def density(c: int, t: int, lc: int, lt: int, c_b: int, lc_b: int) -> float:
    """Composite text density of counts; the base of the logarithm is at least ln(1 + e)."""
    rest, t, lc, lt = max(1, c - lc), max(1, t), max(1, lc), max(1, lt)
    return c / t * math.log(max(1.0, c * t / (lc * lt))) / math.log(math.log(c * lc / rest + lc_b * c / c_b + math.e))


def body_of(root: Node) -> Node:
    return next((k for k in root.kids if isinstance(k, Node) and k.tag == "body"), root)


def best_under(n: Node) -> Node:
    """The first node in document order of the largest density sum under n, or n."""
    best, stack = n, [n]
    while stack:
        x = stack.pop()
        if x.sum > best.sum:
            best = x
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.skip]
    return best


def content(root: Node) -> tuple[list[Node], float, float]:
    """(nodes taken, threshold, largest density sum) of a measured tree."""
    body = body_of(root)
    top = best_under(body)
    if not body.c:
        return [], 0.0, 0.0
    threshold, n = top.density, top
    while n is not None and n is not body:
        threshold = min(threshold, n.density)
        n = n.parent
    taken = []
    for k in body.kids:
        if isinstance(k, Node) and not k.skip and k.c and k.density >= threshold:
            taken.append(best_under(k))
    return taken or [top], threshold, top.sum


def written_text(nodes: list[Node]) -> str:
    """Text in document order, blocks on lines of their own."""
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(_SPACE.sub(" ", k))
        elif not k.skip:
            block = k.tag in _BLOCK
            if block:
                parts.append("\n")
                stack.append("\0")
            stack += reversed(k.kids)
    lines = "".join("\n" if p == "\0" else p for p in parts).split("\n")
    return "\n".join(x for x in (_SPACE.sub(" ", line).strip() for line in lines) if x)


def extract(source: str) -> tuple[str, str, int, float, float]:
    """(title, text, nodes, threshold, largest sum) of a page."""
    root, title = parse(source)
    nodes = measured(root)
    taken, threshold, top = content(root)
    return title, written_text(taken), len(nodes), threshold, top


def extracted(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a page (schema ``OUT``), from whatever markup it has.

    A null or empty page has an empty title and text. Pages may be of any length: the work grows in
    proportion to it. Unclosed and misplaced tags are closed where the enclosing element ends, and elements
    deeper than ``MAX_DEPTH`` become siblings. A null id stays null (ids are whole numbers); repeated rows
    give repeated rows. Of nodes with equal sums the first in the page counts. Other columns are ignored; an
    empty table gives no rows.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                some = batch.slice(k, 512)
                rows = [extract(s or "") for s in some.column(1).to_pylist()]
                title, text, n, threshold, top = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
                cols = [some.column(0), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int32()), pa.array(n, pa.int32()), pa.array([round(x, 6) for x in threshold], pa.float64()), pa.array([round(x, 6) for x in top], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])

    return pages.select(named(id_col).cast("long").alias("page_id"), named(html_col).alias("html")).mapInArrow(run, OUT)
