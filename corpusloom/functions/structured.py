"""Structured fields of a page by its kind, read from a parsed DOM.

Nested regions (a sidebar's links, a post's author) cannot be told apart by
regular expressions, so this is the engine's one Arrow-batched Python function.
Kinds and fields are tables: a new kind is one entry.

Defined cases: a null page or url gives null; broken markup is read as far as it
goes; a page of no kind gives null.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from html import unescape
from html.entities import html5
from urllib.parse import urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors need not have this package: its code travels with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


#: One token of markup, taken whole up to the end of the page if it is never closed; all
#: repetitions are possessive, so a page is read in linear time however broken it is.
TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>"'][^\s>]*+)?+)?+""", re.S)
#: Elements whose content is text up to their end tag, and those of them whose references count.
RAW, DECODED = frozenset("script style title textarea".split()), frozenset("title textarea".split())


def decoded(text: str) -> str:
    """text with its character references decoded; numbers of any length."""
    return unescape(re.sub("&#0*+([0-9]{8})[0-9]*+", r"&#\1", text)) if "&" in text else text


def decoded_closed(text: str) -> str:
    """The same for references that end in ``;`` alone."""
    return re.sub("&(#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z0-9]++);", lambda m: decoded(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0], text) if "&" in text else text


def decoded_value(value: str) -> str:
    """The same for an attribute, where a name without ``;`` stays before ``=``, a letter or a digit."""
    def one(m: re.Match) -> str:
        return decoded(m[0]) if m[0].endswith(";") or m[0].startswith("&#") or m[1] in html5 and value[m.end():m.end() + 1] != "=" else m[0]

    return re.sub("&(#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z0-9]++;?)", one, value) if "&" in value else value


class Dom:
    """Elements in page order; the text of each is a range of the page's text."""

    def __init__(self, html: str, closed: bool = False):
        decode = decoded_closed if closed else decoded
        self.raw, self.nodes, self.pieces, self.opened, self.open_tags = html, [], [], [], Counter()
        at = 0
        while at < len(html):
            m = TOKEN.search(html, at)
            if m is None or m.start() > at:
                self.pieces.append(decode(html[at:m.start() if m else len(html)]))
            if m is None:
                break
            at = m.end()
            if m[2] is None or not m[4]:
                continue  # a comment, or a tag that the page's end cuts off
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                content = html[at:close.start() if close else len(html)]
                self.pieces.append(decode(content) if tag in DECODED else content)
                at += len(content)

    def start(self, tag: str, inside: str) -> None:
        attributes: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(inside):
            value = m[2] or ""
            attributes.setdefault(m[1].lower(), decoded_value(value.strip(value[0]) if value[:1] in ("'", '"') else value))
        node = {"tag": tag, "at": attributes, "classes": set(attributes.get("class", "").split()), "up": self.opened[-1] if self.opened else None,
                "from": len(self.pieces), "to": None}
        self.nodes.append(node)
        if tag in VOID or inside.endswith("/") and tag not in RAW:
            node["to"] = len(self.pieces)
        else:
            self.opened.append(node)
            self.open_tags[tag] += 1

    def end(self, tag: str) -> None:
        while self.open_tags[tag]:
            node = self.opened.pop()
            self.open_tags[node["tag"]] -= 1
            node["to"] = len(self.pieces)
            if node["tag"] == tag:
                return

    def text(self, node) -> str:
        return " ".join("".join(self.pieces[node["from"]:node["to"]]).split())

    def all(self, selector: str) -> list:
        found: dict[int, None] = {}
        for chain in parse_selector(selector):
            last = len(chain) - 1
            for i, node in enumerate(self.nodes):  # parents come first
                have = node["up"]["have"] if node["up"] else 0
                if have == last and _is(node, chain[last]):
                    found[i] = None
                # how many of the ancestors asked for stand above what this one holds
                node["have"] = have + (have < last and _is(node, chain[have]))
        return [self.nodes[i] for i in sorted(found)]

    def first(self, selector: str, attribute: str | None = None) -> str | None:
        found = self.all(selector)
        if not found:
            return None
        return ((found[0]["at"].get(attribute, "").strip() if attribute else self.text(found[0])) or None)


def parse_selector(selector: str) -> list[list[tuple]]:
    """Chains of (tag, classes, attributes); a chain is ancestor first."""
    chains: list[list[tuple]] = [[]]
    for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[\],])+|,", selector):
        if word == ",":
            chains.append([])
            continue
        attrs = re.findall(r'\[([\w:-]+)(?:(\*?=)"([^"]*)")?( i)?\]', word)
        bare = re.sub(r"\[[^\]]*\]", "", word)
        chains[-1].append((bare.partition(".")[0], set(re.findall(r"\.([\w-]+)", bare)), attrs))
    return chains


def _is(node, part) -> bool:
    tag, classes, attrs = part
    if tag and node["tag"] != tag or not classes <= node["classes"]:
        return False
    for name, op, value, fold in attrs:
        have = node["at"].get(name)
        if have is None:
            return False
        if fold:
            have, value = have.lower(), value.lower()
        if op == "=" and have != value or op == "*=" and value not in have:
            return False
    return True


# ---- JSON-LD -------------------------------------------------------------------

def ld_object(dom: Dom, kind: str) -> dict:
    for node in dom.all('script[type="application/ld+json"]'):
        try:
            found = json.loads("".join(dom.pieces[node["from"]:node["to"]]))
        except (ValueError, RecursionError):
            continue
        for x in found if isinstance(found, list) else [found]:
            types = x.get("@type") if isinstance(x, dict) else None
            if any(isinstance(t, str) and t.lower() == kind for t in (types if isinstance(types, list) else [types])):
                return x
    return {}


def name_in(value) -> str | None:
    """The first non-empty string of a JSON-LD value or of its name."""
    for x in value if isinstance(value, list) else [value]:
        x = x.get("name") if isinstance(x, dict) else x
        if isinstance(x, str) and x.strip():
            return x.strip()
    return None


# ---- kinds ----------------------------------------------------------------------
# Selectors, marks and labels of the kinds, first fitting kind first.

FIELDS = {
    "framework": "string", "path_type": "string", "heading_tree": "array<string>", "versions": "array<string>", "code_blocks": "long",
    "nav_links": "long", "toc_links": "long", "links": "long", "sections": "long", "entries": "long", "words": "long", "posts": "long",
    "authors": "long", "tags": "long", "has_admonitions": "boolean", "has_version_picker": "boolean", "has_sidebar": "boolean",
    "has_source_repo": "boolean", "has_search": "boolean", "has_toc": "boolean", "has_breaking_changes": "boolean", "has_dates": "boolean",
    "headline": "string", "author": "string", "published_at": "string", "updated_at": "string", "section": "string", "name": "string",
    "price": "double", "currency": "string", "availability": "string", "thread_title": "string",
}
SCHEMA = "kind string, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items())
CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
POSTS = ".comment, .reply, [data-post-id]"

MARKS = {  # kind: (words anywhere in the page, selectors, words of the path)
    "docusaurus": (("docusaurus", "theme-doc-sidebar"), '.theme-doc-sidebar, .theme-doc-markdown, [class*="docSidebar"]', ()),
    "mkdocs": (("mkdocs", "material"), '.mkdocs, [class*="md-sidebar"], .md-content', ()),
    "github-docs": ((), ".markdown-body, .gh-docs", ("/docs/", "/wiki/")),
    "changelog": (("changelog",), '.changelog, .release-notes, [class*="changelog"]', ("changelog", "release-notes", "releases")),
    "article": ((), 'article, time, meta[property="og:type"][content="article"]', ("/blog",)),
    "docs": ((), '[role="navigation"]', ("/docs", "/guide", "/reference", "/api")),
    "product": ((), '[itemprop="price"], [property="product:price:amount"]', ()),
    "forum": ((), "", ("/forum", "/thread")),
}
COUNTS = {  # kind: field -> selector whose elements are counted
    "docusaurus": {"nav_links": ".theme-doc-sidebar nav.menu__link, .theme-doc-sidebar nav a", "code_blocks": "pre, code"},
    "mkdocs": {"nav_links": "nav.md-nav a, .md-sidebar a", "toc_links": ".md-toc a, .toc a", "code_blocks": ".highlight pre.code"},
    "github-docs": {"code_blocks": ".markdown-body pre, .gh-docs pre", "links": ".markdown-body a, .gh-docs a"},
    "changelog": {"entries": 'ul li, .changelog li, [class*="item"]'},
    "article": {"tags": 'meta[property="article:tag"]'},
    "docs": {"code_blocks": "pre code, code", "nav_links": 'nav a[href], [role="navigation"] a[href]', "sections": "main section, article section"},
    "forum": {"posts": POSTS},
}
FLAGS = {  # kind: field -> selector of which one element is enough
    "docusaurus": {"has_admonitions": '.admonition, .alert, [class*="admonition"]', "has_version_picker": '[class*="version-picker"], .theme-version-picker',
                   "has_sidebar": '.theme-doc-sidebar, [class*="sidebar"]'},
    "mkdocs": {"has_source_repo": '[class*="repo"], [class*="source"]', "has_search": '[class*="search"], .md-search'},
    "github-docs": {"has_toc": '.markdown-body .toc, .gh-docs .toc, [class*="table-of-contents"]'},
    "changelog": {"has_dates": 'time, [class*="date"]'},
    "docs": {"has_toc": '.table-of-contents, .toc, [aria-label*="table of contents" i]'},
}
TEXTS = {  # kind: field -> (selector, most elements)
    "docusaurus": {"heading_tree": ("main h1, main h2, main h3, main h4", 20)},
    "mkdocs": {"heading_tree": ("article h1, article h2, article h3", 15)},
    "github-docs": {"heading_tree": (".markdown-body h1, .markdown-body h2, .markdown-body h3, .gh-docs h1, .gh-docs h2", 15)},
    "changelog": {"versions": ('h2, h3, [class*="version"], [class*="release"]', 20)},
    "docs": {"heading_tree": ("h1, h2, h3", 16)},
}
PATHS = {  # kind: (pattern of the path, type) in order, then the type of all others
    "docusaurus": ([("/docs/", "docs"), ("/blog/", "blog")], "other"),
    "mkdocs": ([("/reference/", "reference"), ("/guide/", "guide")], "other"),
    "github-docs": ([("/wiki/", "wiki")], "docs"),
    "docs": ([("/(api|reference)(/|$)", "reference")], "guide"),
}


def kind_of(dom: Dom, host: str, path: str) -> str | None:
    page = dom.raw.lower()
    for kind, (words, selector, parts) in MARKS.items():
        hit = any(w in page for w in words) or any(p in (path.lower() if kind == "changelog" else path) for p in parts) or bool(selector and dom.all(selector))
        if kind == "github-docs":
            hit = hit and ("github" in host or "gitlab" in host)
        elif kind == "article":
            hit = hit or bool(ld_object(dom, "article"))
        elif kind == "docs":
            hit = hit or bool(dom.all("nav") and dom.all("main"))
        elif kind == "product":
            hit = hit or bool(re.search(r"\b(add to cart|buy now)\b", page))
        elif kind == "forum":
            hit = hit or len(dom.all(POSTS)) >= 2
        if hit:
            return kind
    return None


def fields(html: str, url: str, closed: bool = False) -> dict:
    dom, parts = Dom(html, closed), urlsplit(url)
    host, path = (parts.netloc.lower(), parts.path or "/")
    kind = kind_of(dom, host, path)
    out = {"kind": kind}
    if kind is None:
        return out
    out |= {f: len(dom.all(s)) for f, s in COUNTS.get(kind, {}).items()}
    out |= {f: bool(dom.all(s)) for f, s in FLAGS.get(kind, {}).items()}
    out |= {f: [t for t in map(dom.text, dom.all(s)[:most]) if t or kind != "docs"] for f, (s, most) in TEXTS.get(kind, {}).items()}
    if kind in PATHS:
        known, other = PATHS[kind]
        out["path_type"] = next((t for p, t in known if re.search(p, path)), other)

    def meta(name: str, by: str = "property") -> str | None:
        return dom.first(f'meta[{by}="{name}"]', "content")

    if kind == "docusaurus":
        out |= {"framework": kind, "updated_at": dom.first('[class*="lastUpdated"], .theme-last-updated, time')}
    elif kind == "mkdocs":
        out["framework"] = "mkdocs-material"
    elif kind == "github-docs":
        out["framework"] = "github" if "github" in host else "gitlab"
    elif kind == "changelog":
        out |= {"framework": "generic", "has_breaking_changes": "breaking" in dom.raw.lower()}
    elif kind == "article":
        ld = ld_object(dom, "article")
        out |= {
            "headline": meta("og:title") or dom.first("article h1") or dom.first("h1") or name_in(ld.get("headline")),
            "author": meta("author", "name") or dom.first('[rel="author"]') or dom.first(".author") or name_in(ld.get("author")),
            "published_at": dom.first("time", "datetime") or meta("article:published_time") or name_in(ld.get("datePublished")),
            "updated_at": meta("article:modified_time") or name_in(ld.get("dateModified")),
            "section": meta("article:section") or name_in(ld.get("articleSection"))}
    elif kind == "docs":
        body = dom.all("body")
        hidden = sum(len(dom.text(x).split()) for x in dom.all("body script, body style"))
        out["words"] = len(dom.text(body[0]).split()) - hidden if body else 0
    elif kind == "product":
        shown = dom.first('[itemprop="price"]') or dom.first('[property="product:price:amount"]', "content") or dom.first(".price, [data-price]") or ""
        m = re.search(r"([$€£¥])\s?(\d+(?:[.,]\d{1,2})?)", shown)
        out |= {
            "name": dom.first("h1") or meta("og:title"), "price": float(m[2].replace(",", ".")) if m else None,
            "currency": CURRENCY[m[1]] if m else dom.first('[property="product:price:currency"]', "content"),
            "availability": dom.first('[itemprop="availability"]') or dom.first('link[itemprop="availability"]', "href")}
    elif kind == "forum":
        who = dom.all(".comment .author, .reply .author, [data-post-id] [data-author]")
        out |= {"thread_title": dom.first("h1") or dom.first(".thread-title"),
                "authors": len({dom.text(n) or n["at"].get("data-author", "") for n in who} - {""})}
    return out


def structured(html: Column, url: Column, closed: bool = False) -> Column:
    """struct of SCHEMA; null for null input and for pages of no kind.  closed: texts
    decode only character references that end in ``;``."""

    @F.pandas_udf(SCHEMA)
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        names = ["kind", *FIELDS]
        rows = [fields(p, u, closed) if p is not None and u is not None else {} for p, u in zip(pages, urls)]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    out = run(html, url)
    return F.when(out["kind"].isNotNull(), out)


def normalised(s: Column) -> Column:
    """struct(kind, category, author, published_at, updated_at, section, path_type,
    key_points) of a structured column: the path type decides the category, then
    the family of the kind; key points are the first five headings."""
    kind = s["kind"]
    category = F.coalesce(s["path_type"], F.when(kind.isin("docs", "docusaurus", "mkdocs", "github-docs"), "docs")
                          .when(kind.isin("article", "blog", "changelog"), "article").otherwise(kind))
    points = F.slice(F.filter(s["heading_tree"], lambda x: F.trim(x) != ""), 1, 5)
    return F.when(kind.isNotNull(), F.struct(
        kind.alias("kind"), category.alias("category"), s["author"].alias("author"), s["published_at"].alias("published_at"),
        s["updated_at"].alias("updated_at"), s["section"].alias("section"), s["path_type"].alias("path_type"),
        F.when(F.size(points) > 0, points).alias("key_points")))
