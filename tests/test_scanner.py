"""The page scanner: broken markup, its time, and an independent reader of well-formed pages."""

import html as stdlib
import random
import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import structured as S
from corpusloom.functions.documents import extract_documents

BASE = "https://e.org/x/y"


def read(spark, pages):
    df = spark.createDataFrame([(BASE, h, i) for i, h in enumerate(pages)], "url string, html string, status int")
    return {r.status: r for r in extract_documents(df).collect()}


MB = 1_000_000
BROKEN = {
    "open tags": "<a " * (MB // 3), "open body": "<body " * (MB // 6), "angles": "<" * MB, "closing angles": ">" * MB, "end tags": "</" * (MB // 2), "one quote": "<a href=\"" + "x" * MB,
    "open quotes": "<a b=\"" * (MB // 6), "odd quotes": "<a b='>" * (MB // 7), "unquoted": "<a class=" + "x" * MB, "spaces": "<a" + " " * MB, "spaces before equals": "<a b" + " " * MB + "=c>",
    "many attributes": "<a " + "b=c " * (MB // 4) + ">", "bare attributes": "<a " + "b " * (MB // 2) + "href=q>", "equals": "<a " + "=" * MB, "slashes": "<a" + "/" * MB,
    "comments": "<!--" * (MB // 4), "bogus comments": "<!" * (MB // 2), "dashes": "<!--" + "-" * MB, "scripts": "<script>" * (MB // 8), "styles": "<style " * (MB // 7), "titles": "<title>" * (MB // 7),
    "title of angles": "<title>" + "<" * MB, "noscripts": "<noscript>" * (MB // 10), "ampersands": "<body>" + "&" * MB, "unknown references": "<body>" + "&foo;" * (MB // 5), "long reference": "<body>&" + "a" * MB + ";",
    "long number": "<body>&#" + "9" * MB + ";", "numbers": "<body>" + "&#x41" * (MB // 5), "links": "<a href=/b>" * (MB // 11), "metas": "<meta name=description>" * (MB // 23), "nested": "<div><a><b>" * (MB // 11) + "</i>" * 1000,
    "ends that match nothing": "<a>" * (MB // 8) + "</b>" * (MB // 8), "heads": "</head " * (MB // 7), "nulls": "\x00<a \x00" * (MB // 5), "bodies": "<body>" * (MB // 6), "text": "a " * (MB // 2),
}


def test_a_megabyte_of_anything(spark):
    """All broken pages at once, on four cores: none may take a task beyond 15 s."""
    began = time.time()
    df = spark.createDataFrame([(BASE, h, i) for i, h in enumerate(BROKEN.values())], "url string, html string, status int").repartition(len(BROKEN))
    assert extract_documents(df).select(F.sum(F.length("text")), F.sum(F.size("links"))).first() is not None
    assert time.time() - began < 15 * len(BROKEN) / 4


def test_structured_fields_of_a_megabyte():
    for page in BROKEN.values():
        began = time.time()
        S.fields(page, BASE)
        assert time.time() - began < 15


def test_pages_that_ended_the_session(spark):
    found = read(spark, ["<body>" + "<a " * 4000, "<a class=" + "x" * 20_000, "<a class=\"" + "x" * 50_000 + "\" href=z>t</a>", None, ""])
    assert found[2].links == ["https://e.org/x/z"] and len(found) == 5
    assert found[3].text is None and found[4].text == "" and found[4].title is None


def test_what_is_markup(spark):
    found = read(spark, [
        "<title>a &lt; b</title><body>1 < 2 and 3 > 2 <b>x</b> a<b",
        "<!-- <a href=no> <body>no --><body><!----><a href=1>1</a><!--> <a href=2>2</a><script>'<a href=no>'</script ><a title='<a href=no>' href=3>3</a></body><p>no",
        "<TITLE\n>T <b>x</TITLE><a HREF = 'q' href=r><a\thref=s/><a xhref=no data-href=no><a href=\"\"><a href><abbr href=no>",
        "<body x=it's><p title=John's>it's</p><a href=/a?b=\"c\">d</a>",
        "<html lang=de><meta content='c' name=description><link href='/z?a=1&amp;b=2&copy=3&copy;' rel=canonical><body>&copy 2020 &notit; &AMP;&NotEqualTilde; &#128; &#x110000; &#0; &#65 &hellip;&zzz; &",
        "no body <b>at</b> all<title>t</title> here", "<head><title>t</title></head>after <i>head</i>", "<title>x</title><title>y</title>", "<a href=a<b>c</a><body>z</body",
    ])
    assert (found[0].title, found[0].text) == ("a < b", "1 < 2 and 3 > 2 x a")
    assert found[1].links == [f"https://e.org/x/{i}" for i in (1, 2, 3)] and found[1].text == "1 23"
    assert found[2].title == "T <b>x" and found[2].links == [f"https://e.org/x/{c}" for c in ("q", "s/")]
    assert found[3].text == "it'sd" and found[3].links == ["https://e.org/a?b=\"c\""]
    assert (found[4].lang, found[4].description, found[4].canonical) == ("de", "c", "https://e.org/z?a=1&b=2&copy=3©")
    assert found[4].text == "© 2020 ¬it; &≂̸ € � � A …&zzz; &"
    assert [found[i].text for i in (5, 6, 7)] == ["no body at all here", "after head", ""] and found[7].title == "x"
    assert found[8].links == ["https://e.org/x/a<b"] and found[8].text == "z"


class Reader(HTMLParser):
    """The same fields by the standard library's parser, for pages it reads as browsers do."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.hrefs, self.words, self.inside, self.names = [], [], False, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "body"
        if tag in ("script", "style"):
            self.names.append(tag)
        href = dict(reversed(attrs)).get("href")
        if tag == "a" and href:
            self.hrefs.append(href)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.names = []

    def handle_data(self, data):
        if self.inside and not self.names:
            self.words.append(data)


def test_random_pages_against_the_standard_parser(spark):
    r = random.Random(7)
    bits = ["<p>", "</p>", "<div class=\"a>b\">", "</div>", "text ", "&amp;", "&eacute;", "1 &lt; 2 ", "<a href=\"/p?x=1&amp;y=2\">", "<a href='q r'>", "<a class=c href=u>", "</a>", "<!-- <a href=no> -->", "<br/>", "\n",
            "<script>if (a < b) { x = '<a href=no>'; }</script>", "<style>a > b { }</style>", "<img alt='> <a href=no>'>", "<A HREF=V>", "é ", "<b", " >"]
    pages = ["<html><head><title>t</title></head><body>" + "".join(r.choice(bits[:-2]) for _ in range(r.randint(0, 60))) + "</body></html>" for _ in range(300)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    for row in df.select("i", H.hrefs(F.col("html")).alias("hrefs"), H.body_text(F.col("html")).alias("text")).collect():
        want = Reader(pages[row.i])
        assert row.hrefs == want.hrefs
        assert row.text == re.sub(r"[ \t\n\x0b\f\r]+", " ", "".join(want.words)).strip(" ")


def test_references_against_the_standard_library(spark):
    r = random.Random(11)
    names = sorted(stdlib.entities.html5)
    texts = [" ".join(f"&{r.choice(names)}{r.choice(['', ' ', 'x', '='])}" for _ in range(20)) for _ in range(150)]
    texts += ["&#38;&#x26;&#128;&#159;&#129;&#1114112;&#xD800;&#0;&#38x&#;&#x;&;&&amp;amp;", "&#99999999999999999999;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", H.unescape(F.col("t")).alias("u")).collect():
        assert row.u == stdlib.unescape(texts[row.i])
