"""HTML extraction: densities against a naive recursion, broken markup, odd rows."""

import math
import time

import pyarrow.parquet as pq
import pytest

from llm import html_extract as H

TEXT = "plain words of a text that goes on " * 8


def naive(node):
    """(chars, tags, link chars, link tags) by plain recursion over kept nodes."""
    chars = tags = links = link_tags = 0
    for c in node.children:
        if isinstance(c, str):
            chars += len(c.replace(" ", "")) if c.strip() else 0
        elif not c.cut:
            a, b, d, e = naive(c)
            chars, tags, links, link_tags = chars + a, tags + b + 1, links + d, link_tags + e + (c.tag == "a")
    return chars, tags, chars if node.tag == "a" else links, link_tags


def test_densities_equal_brute_force():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    for page in [*pages, f"<div>{TEXT}<a href=x>link</a><p>{TEXT}</p></div><ul><li><a>x</a><li><a>y</a></ul>"]:
        nodes = H._order(H.parse(page))
        H.weigh(nodes)
        body = naive(nodes[0])
        for x in nodes:
            c, t, lc, lt = naive(x)
            assert (x.chars, x.tags, x.link_chars, x.link_tags) == (c, t, lc, lt)
            if c:
                t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
                base = math.log(c * lc1 / max(c - lc, 1) + body[2] / max(body[0], 1) * c + math.e)
                assert x.density == pytest.approx(max(0, c / t * math.log(max(c * t / (lc1 * lt), 1) + 1e-9, max(base, 1.0001))))
            kept = [y for y in x.children if isinstance(y, H.Node) and not y.cut]
            assert x.total == pytest.approx(sum(y.density for y in kept) or x.density)
            assert x.peak.total == max([x.total, *(y.peak.total for y in kept)])


def test_density_decides_beside_a_teaser():
    body = "".join(f"<p>{i} {TEXT}</p>" for i in range(4))
    want = [f"{i} {TEXT}".strip() for i in range(4)]
    assert H.main_text(f"<body><article>teaser of another page</article><div>{body}</div>").split("\n\n") == want
    assert H.main_text(f"<body><article><p>Short.</p></article><section id=comments>{body}</section>") == "Short."
    for attrs in ('class="layout has-sidebar"', 'class="content no-comments"', 'id="search-results-page"', 'title="a hidden gem"',
                  'class="overflow-hidden"', 'data-id="search"'):
        assert H.main_text(f"<body><div {attrs}>{body}</div>").split("\n\n") == want


@pytest.mark.parametrize("piece", ["<a ", '<p title="', '<p title=">', "<p a='x", "<i></b>", "<div><i>", "<header>", "<!-- ", "<script></script ",
                                   "<b><div>", "</", "<!", "x<", "<ul><li><a href=x>l</a>"])
def test_broken_markup_takes_linear_time(piece):
    began = time.time()
    H.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 15  # quadratic code takes minutes


def test_markup():
    assert H.main_text("<p>1 < 2 &lt; 3 &eacute;&#8217;<p title='it&quot;s > that'>b<p title=\"never closed>c</p>") == "1 < 2 < 3 é’\n\nb\n\nc"
    assert H.main_text("<p>a<!-- x > <p>no --> b<!-->c<p>d<") == "a bc\n\nd<"
    assert H.main_text("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a\n\nb\n\nc"


def test_rows(spark):
    rows = [(1, "u", f"<p>{TEXT}</p>", "x"), (1, "u", f"<p>{TEXT}</p>", "x"), (None, None, None, None), (2, "", "", ""), (3, "v", "<p>" + "word " * 200_000, "y")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = sorted((r.page_id or -1, r.url, len(r.text), r.n_chars) for r in H.extract(df).collect())
    n = len(TEXT.strip())
    assert got == [(-1, None, 0, 0), (1, "u", n, n), (1, "u", n, n), (2, "", 0, 0), (3, "v", 999_999, 999_999)]
    assert H.extract(df.limit(0)).count() == 0
