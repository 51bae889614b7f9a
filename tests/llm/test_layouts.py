"""Main texts of labelled layouts: each form of a text with each kind of boilerplate around it."""

import itertools

import pytest

from llm import html_extract as H

LONG = "words of a text that goes on and on for quite a while, as running text does, before it ends. " * 3
SHORT = "A short closing remark."


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


A, B, C, D = (f"{n} {LONG}".strip() for n in ("One", "Two", "Three", "Four"))
FORMS = {  # markup, the blocks of its text
    "article": (f"<article><h1>Title</h1>{p(A, B, C)}</article>", ["Title", A, B, C]),
    "two articles, four and one paragraphs": (f"<article>{p(A, B, C, D)}</article><article>{p(LONG.strip())}</article>", [A, B, C, D, LONG.strip()]),
    "five unequal articles": ("".join(f"<article><h2>Part {i}</h2>{p(*[f'{i}.{k} {LONG}'.strip() for k in range(n)])}</article>" for i, n in enumerate((5, 1, 3, 2, 1))) + f"<article>{p(SHORT)}</article>",
                              [x for i, n in enumerate((5, 1, 3, 2, 1)) for x in [f"Part {i}", *[f"{i}.{k} {LONG}".strip() for k in range(n)]]] + [SHORT]),
    "main with sections": (f"<main><section>{p(A, B)}</section><section><h2>More</h2>{p(SHORT)}</section></main>", [A, B, "More", SHORT]),
    "short tail in a part of its own": (f"<div><div>{p(A, B, C, D)}</div><div>{p(SHORT)}</div></div>", [A, B, C, D, SHORT]),
    "short lead in a part of its own": (f"<div><div>{p(SHORT)}</div><div>{p(A, B, C, D)}</div></div>", [SHORT, A, B, C, D]),
    "nested parts": (f"<div><div><div>{p(A, B)}</div><div>{p(C)}</div><div>{p(SHORT)}</div></div></div>", [A, B, C, SHORT]),
    "plain paragraphs": (f"<h1>Title</h1>{p(A, B, C, SHORT)}", ["Title", A, B, C, SHORT]),
    "list and quote": (f"<div>{p(A, B, C)}<ul><li>{A}</li><li>{SHORT}</li></ul><blockquote>{B}</blockquote></div>", [A, B, C, A, SHORT, B]),
}
MENU = "".join(f'<li><a href="/{i}">Page {i}</a></li>' for i in range(8))
AROUND = {
    "nothing": ("", ""),
    "tags": (f"<header><h2>Site</h2></header><nav><ul>{MENU}</ul></nav>", f"<footer><p>Imprint and {LONG}</p></footer>"),
    "names": (f'<div class="menu"><ul>{MENU}</ul></div><div class="cookie-notice"><p>We use {LONG}</p></div>', f'<div id="comments"><p>{LONG}</p><p>I agree. {LONG}</p></div><div class="footer"><p>All rights reserved.</p></div>'),
    "forms and scripts": ('<script>var x = "<p>no</p>";</script><form><p>Your mail</p><input></form>', f"<aside><h3>See too</h3><p>{LONG}</p></aside><style>p {{ }}</style>"),
    "adverts": ('<div class="ad"><p>Buy this now, it is cheap and good.</p></div>', f'<ul class="related">{MENU}</ul><div role="complementary"><p>{LONG}</p></div>'),
    "links without names": (f"<div><ul>{MENU}</ul></div>", f"<div><ul>{MENU}</ul></div>"),
}


@pytest.mark.parametrize("form,around", list(itertools.product(FORMS, AROUND)))
def test_layout(form, around):
    (markup, want), (before, after) = FORMS[form], AROUND[around]
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}{markup}{after}</body></html>"
    assert H.main_text(page).split("\n\n") == want


@pytest.mark.parametrize("form", [f for f in FORMS if "article" in f])
def test_teasers_are_lists_of_links(form):
    markup, want = FORMS[form]
    teaser = '<article><h3><a href="/t">Another text of this site that one may read</a></h3></article>'
    assert H.main_text(f"<body>{markup}{teaser}{teaser}").split("\n\n") == want
