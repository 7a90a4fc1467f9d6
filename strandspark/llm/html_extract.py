"""HTML extraction by composite text density.

Every page is parsed into a tree.  Boilerplate that its tags, roles or names
give away (menus, headers, footers, sidebars, notices, adverts, forms,
comments) and hidden parts are taken out; a name counts only if all of its words
do, so that ``share-price`` and ``article-header`` stay.  Each node's density is its characters
per tag, adjusted for links: more link characters and link tags make it less.
A node's density sum is that of its children's densities; the subtree of the
largest sum is the core.  The smallest density on the path from the body to the
core is the threshold: other subtrees off that path come along if they reach it.
If the core lies in an ``article`` or ``main``, all of that is the main text.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas".split())
#: Of these the ones whose content is text up to their end tag, wherever that is.
TEXT_ONLY = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br".split())
DROPPED = frozenset("nav footer aside form button select datalist header menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Elements whose id is an anchor of their own text and names no part of the page.
LABELLED = frozenset("h1 h2 h3 h4 h5 h6 p a td th tr li dt dd".split())
#: Elements whose names say nothing: the page's trunk, and parts of a line.
UNNAMED = frozenset("html body article main span b i em strong code mark small sub sup abbr cite q u s kbd var samp time dfn ins del font".split())
#: Words of class names and ids that mark boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications "
    "outbrain overlay pager pagination popup promo promotion recommended related respond share sharing sidebar skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
#: Words that say nothing of their own beside those.
PLAIN = frozenset("area bar bottom box btn button buttons center col column container content footer form global header icons inner item items js left link links list main outer page panel post posts right row section signup site slot sticky text thread top unit wrap wrapper zone".split())
#: Elements that end an open element when they start.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
#: What an implied end does not reach across.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "option": ("select", "datalist"), "p": ("td", "th", "table", "div", "article", "section", "li", "blockquote", "body", "main")}
#: Controls that hold no blocks: one left open ends where a block starts.
CONTROLS = ("select", "datalist", "button")

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]+|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"[A-Za-z][a-z0-9]*|[A-Z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.drop = tag, parent, [], False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def names_boilerplate(name: str, inside_main: bool = False) -> bool:
    """Whether a class name or id is made of words of boilerplate, and plain ones, alone; an article's own header is none."""
    words = [w.lower() for w in _WORD.findall(name)]
    return any(w in NAMES and not (inside_main and w == "header") for w in words) and all(w in NAMES or w in PLAIN or w.isdigit() for w in words)


def _boilerplate(tag: str, attrs: str, inside_main: bool) -> bool:
    if tag in DROPPED and not (tag == "header" and inside_main):
        return True
    if not attrs or attrs.isspace():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        low = value.lower()
        if (name == "class" and tag not in UNNAMED or name == "id" and tag not in UNNAMED and tag not in LABELLED) and any(names_boilerplate(v, inside_main) for v in value.split()):
            return True
        if name == "role" and low.strip() in ROLES or name == "hidden" and low != "until-found" or name == "aria-hidden" and low == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return True
    return False


class _Open:
    """The open elements, and where each tag stands among them: ends are found without walking up."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def last(self, tags) -> int:
        """The place of the innermost of these tags; 0 if none is open (the root never ends)."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def push(self, node: Node) -> None:
        for key in (node.tag, "*block") if node.tag in BLOCK else (node.tag,):
            self.at.setdefault(key, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Ends the element at this place and all inside it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            for key in (node.tag, "*block") if node.tag in BLOCK else (node.tag,):
                self.at[key].pop()


def parse(page: str) -> Node:
    """The page's tree in time linear in its length.

    Elements left open end with their parents; stray ends are ignored, and so
    are ends of inline elements that would end a block.
    """
    root = Node("body", None)
    open_, at, n = _Open(root), 0, len(page)
    ends_seen: dict[str, int] = {}
    while at < n:
        m = _PART.search(page, at)
        if m is None:
            open_.nodes[-1].parts.append(page[at:])
            break
        if m.start() > at:
            open_.nodes[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = open_.last((tag,))
            if place and (tag in BLOCK or place > open_.last(("*block",))):
                open_.cut(place)
            continue
        if tag in ("html", "head", "body"):
            continue
        closed = m[3].rstrip().endswith("/")
        if tag in RAW:
            if not closed and ends_seen.get(tag, 0) <= n:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                elif tag in TEXT_ONLY:
                    at = n
                else:  # left open: its start tag alone goes, and no later one is looked for
                    ends_seen[tag] = n + 1
            continue
        if tag in BLOCK and (place := open_.last(CONTROLS)):
            open_.cut(place)
        ends = CLOSES.get(tag) or (("p",) if tag in BLOCK and tag != "br" else None)
        if ends:
            stop = open_.last(SCOPE.get(tag if tag in CLOSES else "p", ()))
            rows = tag in ("td", "th", "tr", "tbody", "thead")
            while (place := open_.last(ends)) > stop:
                open_.cut(place)
                if not rows:
                    break
        child = Node(tag, open_.nodes[-1])
        child.drop = _boilerplate(tag, m[3], open_.last(("article", "main")) > 0)
        child.parent.parts.append(child)
        if tag not in VOID and not closed:
            open_.push(child)
    return root


def _nodes(root: Node):
    """Kept nodes, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [p for p in node.parts if not isinstance(p, str) and not p.drop]


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and density sums; returns the kept nodes, parents first."""
    order = list(_nodes(root))
    for node in reversed(order):
        node.chars = sum(len(_BLANK.sub("", p)) if isinstance(p, str) else 0 for p in node.parts)
        for p in node.parts:
            if not isinstance(p, str) and not p.drop:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    c_all, l_all = max(1, root.chars), root.link_chars
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c == 0:
            continue
        plain = max(1, c - lc)
        base = math.log(c / plain * lc + l_all / c_all * c + math.e)
        node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / math.log(base + 1e-9) if base > 1 + 1e-9 else c / t * math.log(c / max(1, lc) * t / max(1, lt) + math.e)
        node.density = max(0.0, node.density)
    for node in order:
        node.total = sum(p.density for p in node.parts if not isinstance(p, str) and not p.drop) + (node.density if not any(not isinstance(p, str) for p in node.parts) else 0.0)
    return order


def content_roots(root: Node) -> list[Node]:
    """The subtrees of the main text, in page order."""
    order = measure(root)
    if root.chars == 0:
        return []
    core = max(order, key=lambda x: x.total)
    path, up, hold = [], core, None
    while up is not None:
        path.append(up)
        if up.tag in ("article", "main"):
            hold = up if hold is None or up.tag == "article" else hold
        up = up.parent
    if hold is None:  # the core may also stand around the article
        inner = [x for x in order if x.tag == "article"] or [x for x in order if x.tag == "main"]
        if inner:
            return inner
        least = min(x.density for x in path)
        on_path, picked = set(map(id, path)), []
        stack = [root]
        while stack:
            node = stack.pop()
            if node is core:
                picked.append(node)
            elif id(node) in on_path:
                stack += [p for p in reversed(node.parts) if not isinstance(p, str) and not p.drop]
            elif node.chars and node.density >= least:
                picked.append(node)
        return picked
    return [hold]


def blocks(roots: list[Node]) -> list[str]:
    """The text of each block, white space made one space, blank ones left out."""
    out, run = [], []

    def flush():
        if text := _BLANK.sub(" ", _html.unescape("".join(run))).strip():
            out.append(text)
        run.clear()

    for root in roots:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif not x.drop:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.parts)
        flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by one line feed."""
    return "\n".join(blocks(content_roots(parse(page or ""))))


def _kernel(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            texts = [main_text(p) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null and empty pages have an empty text, as have pages of boilerplate
    alone; of equal density sums the first node in page order wins; text outside any
    tag is the body's.  Repeated rows get equal results; an empty table gives
    no rows; other columns are ignored.
    """
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_kernel, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
