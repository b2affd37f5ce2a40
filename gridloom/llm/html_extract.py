"""Main text of web pages by composite text density.

Every page is parsed into a small DOM.  A node's density is its characters per
tag, adjusted for links: text inside links counts against the node, relative to
the link share of the whole body.  A node's score is the sum of its children's
densities; the subtree with the highest score is the core of the article.  The
lowest density on the path from the core up to the body is the threshold that
sibling subtrees must reach to be kept as well, and text directly in a node of the
path, with its inline elements, unless half of it or more is links.  If an article or main element lies on that path, the text is the content of the
outermost one, where nothing short is lost: only blocks that miss the threshold and are
lists of links are left out.

Forms, and elements whose class, id or role names furniture, are left out unless
they wrap the article.  A name does so if all its words are furniture words or words
for places and containers, one at least a furniture word: "site-header" and
"related-posts" do, "related-work", "share-price" and "article-header" do not.  An
element wraps the article if the text outside holds no article or main element and it
does, or it holds WRAPS times as many characters outside links as all that is kept.

Defined results: a null or empty page, or one without article text, gives the
empty string.  Text before any tag, unclosed tags, cut tags and unknown
references are handled; nothing is dropped for its length.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, kept_columns, strings

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Fixed values of HTML: elements without content, elements whose content is not
#: markup, elements that stay inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open paragraph, and the elements that a new one of the
#: same kind ends.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements that are never part of an article.
BOILERPLATE_TAGS = frozenset("nav header footer aside button select menu dialog head input datalist object applet canvas audio video".split())
#: Words in class, id or role that mark furniture around an article.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promoted promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer bottombar copyright colophon "
    "sidebar aside rail widget widgets complementary "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "comment comments disqus respond reply replies discussion "
    "share sharing social follow newsletter subscribe subscription signup login search "
    "related recommended recommendations trending popular outbrain taboola "
    "contentinfo form tags hidden".split()
)
#: Words that say where or in what form furniture stands, not what it is about.
PLACE_WORDS = frozenset(
    "page site global local user reader readers main primary secondary article articles post posts entry story stories blog "
    "top bottom left right upper lower inner outer first last mobile desktop sticky fixed floating "
    "area bar block body box button buttons card cards col column container content feed group holder icon icons inline item items links list panel "
    "region row section sections slot stack strip thread toolbar tools unit wrap wrapper zone html js id".split()
)
#: Words that make a header one of the text, not of the page.
TEXT_WORDS = frozenset("article post entry story section content block card".split())
#: A marked element with that many times the text of the page outside it wraps the article.
WRAPS = 4
#: Links, and their share of the characters, that make a list of links of a block inside an article.
LINKS, LINK_SHARE = 2, 0.8
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its children in page order, strings among them."""

    __slots__ = ("boiler", "chars", "density", "depth", "hard", "kids", "link_chars", "link_tags", "score", "tag", "tags", "up")

    def __init__(self, tag: str, up: Node | None, hard: bool, marked: bool = False):
        self.tag, self.up, self.hard, self.boiler = tag, up, hard, hard or marked
        self.depth = up.depth + 1 if up is not None else 0
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0


class _Open:
    """The open elements, with the depths of those of each kind, so that no start or end tag has to look at all of them."""

    def __init__(self, root: Node):
        self.path = [root]
        self.depths: dict[str, list[int]] = {}

    def deepest(self, *kinds: str) -> int:
        """The depth of the innermost open element of some kinds, 0 if none is open."""
        return max((self.depths[k][-1] for k in kinds if self.depths.get(k)), default=0)

    @staticmethod
    def _kinds(tag: str) -> tuple[str, ...]:
        """A tag counts under its name, and as a block or as a barrier for stray inline end tags."""
        return (tag, *(() if tag == "p" or tag in INLINE else ("#block",)), *(("#barrier",) if tag in ("table", "article", "body") else ()))

    def push(self, node: Node) -> None:
        self.path.append(node)
        for kind in self._kinds(node.tag):
            self.depths.setdefault(kind, []).append(node.depth)

    def close(self, depth: int) -> None:
        """Close all elements from ``depth`` on inwards."""
        while len(self.path) > depth:
            for kind in self._kinds(self.path.pop().tag):
                self.depths[kind].pop()

    def first_paragraph(self) -> int:
        """The depth of the outermost open paragraph inside the innermost block, 0 if there is none."""
        open_p = self.depths.get("p", [])
        at = bisect_right(open_p, self.deepest("#block"))
        return open_p[at] if at < len(open_p) else 0


def _names_furniture(token: str) -> bool:
    """Whether one name of a class, id or role stands for furniture around an article."""
    words = {w.lower() for w in _WORDS.findall(token) if len(w) > 1}  # of sizes like 728x90 nothing is left
    kinds = words & BOILERPLATE_WORDS
    return bool(kinds) and words <= BOILERPLATE_WORDS | PLACE_WORDS and not (kinds == {"header"} and words & TEXT_WORDS)


def _furniture(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is never part of an article, and whether it is marked as furniture."""
    if tag in BOILERPLATE_TAGS or tag in RAW:
        return True, True
    marked = tag == "form"
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, marked
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, True
        if name in ("class", "id", "role") and any(map(_names_furniture, value.split())):
            marked = True
    return False, marked


def parse(page: str) -> Node:
    """The DOM of a page, under one root; the head and raw text elements carry no text."""
    root = Node("#root", None, False)
    opened = _Open(root)
    where = 0
    for m in iter(lambda: _TOKEN.search(page, where), None):
        at = opened.path[-1]
        if m.start() > where and not at.hard:
            at.kids.append(html.unescape(page[where : m.start()]))
        where = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            depth = opened.deepest(tag)
            if depth and not (tag in INLINE and opened.deepest("#barrier") > depth):
                opened.close(depth)
            elif tag in ("p", "br") and not at.hard:
                at.kids.append(Node("br", at, False))
            continue
        if tag in ENDS_P:
            if depth := opened.first_paragraph():
                opened.close(depth)
        elif tag in ENDS_SAME:
            depth = opened.deepest(*(("dt", "dd") if tag in ("dt", "dd") else (tag,)))
            if depth > opened.deepest(*ENDS_SAME[tag]):
                opened.close(depth)
        elif tag == "body" and at.tag == "head":
            opened.close(at.depth)
        at = opened.path[-1]
        hard, marked = (True, True) if at.hard else _furniture(tag, attrs)
        node = Node(tag, at, hard, marked)
        at.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, where)
            where = end.end() if end else len(page)
        elif tag not in VOID:
            opened.push(node)
    if where < len(page) and not opened.path[-1].hard:
        opened.path[-1].kids.append(html.unescape(page[where:]))
    return root


def _measure(root: Node) -> list[Node]:
    """Characters, tags and links of every kept node; the nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.boiler)
    for node in reversed(order):
        link = node.tag == "a"
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                node.chars += n
                node.link_chars += n if link else 0
            elif not k.boiler:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.chars if link else k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
    return order


def _measured(root: Node) -> list[Node]:
    """The nodes as measured, after marked elements that wrap the article are taken for content."""
    order, marked, stack = _measure(root), [], [root]
    while stack:
        node = stack.pop()
        if node.boiler and not node.hard:
            marked.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and not k.hard)
    while marked:
        has_article = any(n.tag in ("article", "main") and n.chars for n in order)
        best, most = None, 0
        for node in marked:
            inside = _measure(node)  # without marked elements in it
            own = node.chars - node.link_chars
            holds = not has_article and any(n.tag in ("article", "main") and n.chars for n in inside)
            if (holds or own > WRAPS * root.chars) and own > most:
                best, most = node, own
        if best is None:
            break
        while best is not None:
            best.boiler, best = False, best.up
        marked = [n for n in marked if n.boiler]
        order = _measure(root)
    return order


def _loose_runs(node: Node, on_path: set[int]) -> list[Node]:
    """Runs of text and inline elements directly in ``node``, each put into one new node; those that are mostly not links."""
    kids: list[Node | str] = []
    runs = []
    for k in node.kids:
        if not isinstance(k, str) and (k.boiler or id(k) in on_path or (k.tag not in INLINE and k.tag != "br")):
            kids.append(k)
            continue
        if not kids or kids[-1] not in runs[-1:]:
            runs.append(Node("span", node, False))
            kids.append(runs[-1])
        runs[-1].kids.append(k)
    node.kids = kids
    for run in runs:
        _measure(run)
    return [run for run in runs if run.chars > 2 * run.link_chars]


def _densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1), max(base, 1.0001)), 0.0)
    for node in reversed(order):
        own = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        node.score = own + sum(k.density for k in node.kids if isinstance(k, Node) and not k.boiler)


def _drop_link_lists(top: Node, threshold: float, on_path: set[int]) -> None:
    """Leave out blocks below ``top`` that miss the threshold and are mostly links, of which they have LINKS or more."""
    stack = [top]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str) or k.boiler or k.tag in INLINE:
                continue
            if id(k) not in on_path and k.density < threshold and k.link_tags >= LINKS and k.link_chars > LINK_SHARE * k.chars:
                k.boiler = True
            else:
                stack.append(k)


def _text(node: Node, keep: set[int] | None, out: list[str]) -> None:
    """Append the text of ``node``; with ``keep``, only of subtrees in it.

    A block starts and ends with a line feed, so that blocks never run together.
    """
    stack: list[tuple[Node | str, set[int] | None]] = [(node, keep)]
    while stack:
        x, only = stack.pop()
        if isinstance(x, str):
            if only is None:
                out.append(x)
            continue
        if x.boiler:
            out.append("\n")
            continue
        only = None if only is None or id(x) in only else only
        edge = "" if x.tag in INLINE else "\n"
        out.append(edge)
        stack.append((edge, None))
        stack.extend((k, only) for k in reversed(x.kids))


def main_text(page: str | None) -> str:
    """The article text of one page."""
    if not page:
        return ""
    root = parse(page)
    order = _measured(root)
    body = next((n for n in order if n.tag == "body"), root)
    if body is not root and body.chars < root.chars:
        body = root  # text after a body that was closed too early
    if not body.chars:
        return ""
    _densities(order, body)
    core = max((n for n in order if n.tag not in INLINE), key=lambda n: n.score)
    path = [core]
    while path[-1] is not body and path[-1].up is not None:
        path.append(path[-1].up)
    whole = [n for n in path if n.tag in ("article", "main")]
    out: list[str] = []
    if whole:
        top = whole[-1]
        threshold = min(n.density for n in path[: path.index(top) + 1])
        _drop_link_lists(top, threshold, {id(n) for n in path})
        _text(top, None, out)
    else:
        threshold = min(n.density for n in path)
        on_path = {id(n) for n in path}
        kept = {id(n) for n in order if n.density >= threshold and id(n) not in on_path} | {id(core)}
        kept |= {id(run) for n in path[1:] for run in _loose_runs(n, on_path)}
        _text(path[-1], kept, out)
    return " ".join("".join(out).split())


def extract_main_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` of every page, its main ``text`` and ``n_chars``, the text's code points.

    One row per input row; there is no shuffle.  Other columns are not read, so
    their names cannot clash.
    """
    keep = kept_columns(keep, "text", "n_chars")
    source = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(html_column).alias("of"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in strings(batch.column(len(keep)))]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"]
        )

    schema = ", ".join([*(f"{c} {t}" for c, t in source.dtypes[:-1]), "text string, n_chars long"])
    return arrow_map(source, "of", run, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})
