"""Main text of web pages by composite text density.

A page is parsed into a DOM by one forward scan, in time linear in its length
whatever the markup.  Scripts, styles, forms, navigation and elements whose tag,
role, class or id names them as menus, adverts, notices, sidebars or reader
comments weigh nothing, unless they hold an article or main element or, on pages
without one, most of the text outside links.  For every other node the composite
density is its characters per tag, adjusted by the share of link characters and
tags; the densities of a node's children are summed.  The node with the largest
sum is chosen; a single paragraph stands for the element that holds it.  The
lowest density on the path from the densest node to the body is the threshold:
in every subtree whose density reaches it, the node with the largest sum is
content too.

An article or main element weighs in, it does not decide: the choice grows to
the article that it lies in, or shrinks to the articles inside it that hold half
of its text; of other articles those with content and half as much text are
kept, and of those beside them under one parent all but lists of links, however
short.  A choice that has nothing to do with an article stands as it is, with
all other content, what lies between, and the parts with paragraphs beside it under
one parent below the body.

Defined cases: a null or empty page, or one without text, gives an empty text;
unclosed tags, a missing body and broken markup are tolerated (a quote that is
never closed is an ordinary character, a tag that the page ends in is dropped
with what follows, as browsers do); pages of any length and depth are read
whole; a null url or page_id is passed on; repeated rows give repeated results;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from llm.common import map_arrow, table

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: One attribute.  A value whose quote is never closed is read as if it had no
#: quotes; that search fails once for each kind of quote, so tags cost linear time.
ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
GAP = re.compile(r"[\s/]*+")
RAW_END = {}
SPACES = re.compile(r"\s+")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
CUT = frozenset(
    "head script style noscript template iframe nav footer aside form button select textarea input label dialog "
    "menu svg canvas object embed audio video map title".split())
#: Elements whose content is never running text.
NO_TEXT = frozenset("head script style noscript template iframe button select textarea svg canvas object embed audio video map title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes, and the elements it does not look beyond.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
PARAGRAPH = frozenset(("p", "li", "pre", "blockquote", "dt", "dd", "td", "th", "tr", "tbody", *HEADINGS))
PROSE = frozenset(("p", "pre", "blockquote", "table", *HEADINGS))
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
NOISE = re.compile(
    r"^(?:ads?|adverts?|advertisements?|advertising|adsense|sponsored|sponsor|promo(?:tion)?s?|banner|sidebar|side-bar|side|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|masthead|comments?|commentlist|respond|replies|disqus|discussion|cookies?|consent|gdpr|notices?|alert|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|widget|pagination|"
    r"pager|skip|toolbar|search|hidden|copyright|disclaimer|contentinfo|complementary|search|dialog|alertdialog|menubar|topbar|outbrain|taboola)$", re.I)
#: Parts that, beside a noise word, leave a name a noise name: "site-footer", "comment-list".
NEUTRAL = frozenset(
    "site global main primary secondary top bottom left right bar box list links link item items area wrap wrapper container inner outer "
    "section block group panel header content text form button buttons icon icons reader user comment post page js fixed sticky".split())
MODIFIERS = frozenset("page content post main text section primary".split())
NOISE_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "peak", "block", "whole")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list = []
        self.cut = self.noise = False


def _noise_name(token: str) -> bool:
    """A class token, id or role that names boilerplate as a whole."""
    if NOISE.match(token):
        return True
    parts = [w.lower() for w in NOISE_PARTS.split(token) if w]
    noise = [bool(NOISE.match(w)) for w in parts]
    # a wrapper's name ends in what it holds ("search-page"), a part's in what it is ("page-footer")
    return any(noise) and all(n or w in NEUTRAL for n, w in zip(noise, parts)) and parts[-1] not in MODIFIERS


def _attribute_is_noise(name: str, value: str) -> bool:
    if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
        return True
    return name in ("class", "id", "role") and any(map(_noise_name, value.split()))


def _raw_end(page: str, tag: str, pos: int) -> int:
    """The end of a raw element's content and end tag, or of the page."""
    if tag not in RAW_END:
        RAW_END[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.I)
    end = RAW_END[tag].search(page, pos)
    return (page.find(">", end.end()) + 1 or len(page)) if end else len(page)


class Builder:
    """Open elements as a stack; the positions of each tag's open elements make
    every decision about what a tag closes a comparison of two numbers."""

    def __init__(self):
        self.root = Node("html", None)
        self.stack = [self.root]
        self.where: dict[str, list[int]] = {}
        self.blocks, self.no_p = [0], [0]  # positions of blocks, and of those but p

    def text(self, text: str) -> None:
        self.stack[-1].children.append(html_lib.unescape(text) if "&" in text else text)

    def last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close_to(self, at: int) -> None:
        """Close the element at that position and all inside it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                if tag != "p":
                    self.no_p.pop()

    def start(self, tag: str, noise: bool, leaf: bool) -> None:
        if tag == "body":
            self.close_to(1)
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P and self.last("p") > self.no_p[-1]:
            self.close_to(self.last("p"))
        if tag in CLOSED_BY:
            same, around = CLOSED_BY[tag]
            if self.last(*same) > self.last(*around):
                self.close_to(self.last(*same))
        node = Node(tag, self.stack[-1])
        node.noise = noise and tag not in ("article", "main")
        self.stack[-1].children.append(node)
        if not leaf:
            self.where.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCK:
                self.blocks.append(len(self.stack))
                if tag != "p":
                    self.no_p.append(len(self.stack))
            self.stack.append(node)

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at and (tag in BLOCK or at > self.blocks[-1]):  # an inline end tag does not close blocks
            self.close_to(at)


def parse(page: str) -> Node:
    """The DOM below a root; text is kept as strings among the children."""
    build = Builder()
    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            build.text(page[pos:at])
        if at + 1 >= n:
            if at < n:
                build.text("<")
            break
        head = TAG.match(page, at + 1)
        if not head:
            if page[at + 1] in "!?/":
                if page.startswith("<!--", at):
                    short = page[at + 4:at + 6]
                    pos = at + 5 if short[:1] == ">" else at + 6 if short == "->" else page.find("-->", at + 4) + 3
                    pos = n if pos == 2 else pos
                else:
                    pos = page.find(">", at + 2) + 1 or n
            else:
                build.text("<")
                pos = at + 1
            continue
        tag, pos, noise = head[2].lower(), head.end(), False
        while True:
            m = ATTR.match(page, pos)
            if not m:
                break
            pos = m.end()
            noise = noise or not head[1] and _attribute_is_noise(m[1].lower(), m[2] or m[3] or m[4] or "")
        pos = GAP.match(page, pos).end()
        if pos >= n:
            break  # the page ends inside the tag
        leaf, pos = page[pos - 1] == "/", pos + 1
        if head[1]:
            build.end(tag)
        else:
            build.start(tag, noise, leaf or tag in VOID or tag in RAW)
            if tag in RAW:
                pos = _raw_end(page, tag, pos)
    return build.root


def _guarded(root: Node) -> set[Node]:
    """Nodes that no name cuts: those around an article or main element (with half
    the text of the largest one, at least), else around most of the page's text
    outside links."""
    nodes, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        nodes.append(node)
        link = link or node.tag == "a"
        node.chars = 0 if link else sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str) and not c.isspace())
        if node.tag not in NO_TEXT:
            stack.extend((c, link) for c in node.children if isinstance(c, Node))
        else:
            node.chars = 0
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
    whole = [x for x in nodes if x.tag in ("article", "main") and x.chars]
    least = max((x.chars for x in whole), default=0)
    around = set()
    for node in whole:
        up = node
        while up is not None and up not in around and 2 * node.chars >= least:
            around.add(up)
            up = up.parent
    return around or {x for x in nodes if 2 * x.chars > root.chars and x.tag not in ("nav", "footer", "aside", "menu")}


def _order(root: Node) -> list[Node]:
    """Kept nodes in document order, with the block and the outermost article or
    main element that each lies in; cut ones are marked."""
    out, stack, guarded = [], [root], None
    while stack:
        node = stack.pop()
        up = node.parent
        node.whole = up.whole if up is not None and up.whole is not None else node if node.tag in ("article", "main") else None
        node.block = node if up is None or node.tag in BLOCK else up.block
        node.cut = node.tag in CUT or node.noise or node.tag == "header" and node.whole is None
        if node.cut and node.tag not in NO_TEXT and node.children:
            if guarded is None:
                guarded = _guarded(root)
            node.cut = node not in guarded
        if node.cut:
            continue
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _spread(tops: set[Node], nodes: list[Node]) -> list:
    """The outermost of tops in order, with headings before them and what lies
    between those of one parent, but for lists of links."""
    out, stack = [], [nodes[0]]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x in tops:
            out.append(x)
            continue
        kept = [i for i, c in enumerate(x.children) if c in tops]
        below = []
        for i, c in enumerate(x.children):
            if isinstance(c, str):
                if kept and kept[0] < i < kept[-1]:
                    below.append(c)
            elif not c.cut:
                if kept and c.tag in HEADINGS and i < kept[-1] or len(kept) > 1 and kept[0] < i < kept[-1] and 2 * c.link_chars <= c.chars:
                    tops.add(c)
                below.append(c)
        stack.extend(reversed(below))
    return out


def weigh(nodes: list[Node]) -> None:
    """Characters, tags, density, sum and the largest sum below of every kept node
    (parents come before children)."""
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c) - c.count(" ") if not c.isspace() else 0
            elif not c.cut:
                chars += c.chars
                tags += c.tags + 1
                link_chars += c.link_chars
                link_tags += c.link_tags + (c.tag == "a")
        node.chars, node.tags = chars, tags
        node.link_chars = chars if node.tag == "a" else link_chars
        node.link_tags = link_tags
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.total, node.peak = 0.0, node
        for x in node.children:
            if isinstance(x, Node) and not x.cut:
                node.total += x.density
        node.total = node.total or node.density
        for x in node.children:
            if isinstance(x, Node) and not x.cut and x.peak.total > node.peak.total:
                node.peak = x.peak


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite density: characters per tag, less the more of them are links."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars * lc / max(chars - link_chars, 1) + share * chars + math.e)
    return max(0.0, chars / t * math.log(max(chars * t / (lc * lt), 1.0) + 1e-9, max(base, 1.0001)))


def _holder(node: Node) -> Node:
    """The block that node stands for: one paragraph is a part of a text, not the text."""
    node = node.block
    while node.tag in PARAGRAPH and node.parent is not None:
        node = node.parent.block
    return node


def _beside(chosen: Node, nodes: list[Node]) -> set[Node]:
    """The other children of the choice's parent, below the body, that hold paragraphs
    and more text than links: short parts of the same text."""
    around = chosen.parent
    if around is None or around.parent is None:
        return set()
    prose = set()
    for x in nodes:
        if x.tag in PROSE and x.chars and 2 * x.link_chars <= x.chars:
            while x is not None and x is not around and x not in prose:
                prose.add(x)
                x = x.parent
    return {c for c in around.children if isinstance(c, Node) and c in prose and 2 * c.link_chars <= c.chars}


def choose(root: Node) -> list:
    """The parts of the main text in order: nodes, and strings between them."""
    nodes = _order(root)
    weigh(nodes)
    body = nodes[0]
    if not body.chars:
        return []
    chosen = _holder(body.peak)
    # lowest density on the path from the densest node to the body
    up = max(nodes, key=lambda x: x.density)
    low = up.density
    while up is not None:
        low = min(low, up.density)
        up = up.parent
    tops = {x.peak.block for x in nodes if x.chars and x.density >= low}
    articles = [x for x in nodes if x.whole is x and x.chars]
    main = chosen.whole
    if main is None:
        inside = max(articles, key=lambda x: x.chars, default=None)
        main = inside if inside is not None and 2 * inside.chars >= chosen.chars else None
    if main is not None:
        content = {x.whole for x in tops} | {chosen.whole, main}
        kept = {x for x in articles if x in content and 2 * x.chars >= main.chars}
        beside = {x.parent for x in kept}
        return [x for x in articles if x in kept or x.parent in beside and 2 * x.link_chars <= x.chars]
    if chosen is body:  # menus without names: blocks of links alone
        for c in body.children:
            if isinstance(c, Node) and not c.cut and c.tag in BLOCK - PARAGRAPH and c.link_tags >= 3 and 10 * c.link_chars >= 9 * c.chars:
                c.cut = True
    return _spread(tops | _beside(chosen, nodes) | {chosen}, nodes)


def blocks(parts: list) -> list[str]:
    out, line = [], []

    def flush() -> None:
        text = SPACES.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list = list(reversed(parts))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.cut:
            if x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                flush()
                stack.append(None)
                stack.extend(reversed(x.children))
            else:
                stack.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(blocks(choose(parse(page))))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return map_arrow(
        pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"), pages[html].alias("html")), run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
