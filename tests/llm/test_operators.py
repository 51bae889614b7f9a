"""The operators against brute force on small tables, with nulls, ties and repeats."""

import base64
import hashlib
import itertools
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from llm import decontaminate, html_extract, mixing, ngram_join, quality_rules, registry, suffix_dedup, token_counts, toxicity, url_filter, warc
from llm.common import written

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "a"), (2, "", None), (3, "a" * 300, "a"), (3, "a" * 300, "a"), (None, "ab cd " * 60, None), (5, "one two", "b"), (6, " \t\n", "b")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string")


def docs_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


def links(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    common = defaultdict(int)
    for ids in inverted.values():
        for pair in itertools.combinations(sorted(ids), 2):
            common[pair] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_ngram_join(spark, k, num):
    docs = docs_of(spark)
    base = " ".join(f"w{i}" for i in range(200)).split()
    rng = np.random.default_rng(1)
    for n in range(60):  # a family whose similarities straddle the threshold
        w = list(base)
        for j in rng.integers(0, 200, 3 + n % 6):
            w[j] = f"x{rng.integers(1000)}"
        docs.append((10_000 + n, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(df, k, num, 100).collect()}
    assert got == links(docs, k, num, 100)


@pytest.mark.parametrize("small", [0, 1000])
def test_ngram_join_missed_thresholds(spark, monkeypatch, small):
    """Groups around a hub in which most pairs miss the threshold, by tiles and by pairs; hot hubs in several keys."""
    monkeypatch.setattr(ngram_join, "TILE", 9)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "MEMBERS", 5)
    rng, docs = np.random.default_rng(5), []
    for i in range(70):
        words = [f"w{j}" for j in range(100)]
        for j in rng.choice(100, 1 + i % 9, replace=False):
            words[j] = f"x{rng.integers(25)}"
        docs.append((i + 1, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = []
    real = ngram_join.missing_links
    monkeypatch.setattr(ngram_join, "missing_links", lambda *a: asked.append(1) or real(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(df, 1, 90, 100).collect()}
    want = links(docs, 1, 90, 100)
    assert got == want and asked and len({c for _, c in want.values()}) > 3


def test_ngram_join_odd(odd):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.linked_components(odd, 3, 90, 100).collect())
    assert got == [(-1, 2, -1), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (5, 1, 5), (6, 0, 6)]
    assert ngram_join.linked_components(odd.limit(0)).count() == 0
    left = ngram_join.one_of_each(odd.withColumnRenamed("source", "component_id"))
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 5, 6] and left.columns == ["doc_id", "text", "component_id"]


def test_ngram_join_long(spark):
    """A text of 200,000 words beside a near copy and a part."""
    text = " ".join(f"w{i * 7919 % 999983}" for i in range(200_000))
    df = spark.createDataFrame([(5, text), (3, text + " end"), (4, text[:900_000])], "doc_id int, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.linked_components(df, 3, 90, 100).collect()}
    assert got == {5: 3, 3: 3, 4: 4}


def removed(docs, size=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b, last = (t or "").encode(), 0
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if b[p:p + size] in seen:
                gone[max(p, last):p + size] = True
                last = p + size
            seen.add(b[p:p + size])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    docs = docs_of(spark) + [(9_000, "é" * 400), (9_001, "abcd" * 200), (9_002, "x" + "é" * 80), (9_003, "")]
    docs.append((9_004, docs[3][1][50:400] + "!" + docs[7][1][:300]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r._row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()}
    assert got == removed(docs)


def test_suffix_dedup_odd(odd):
    got = sorted((r._row.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(odd).collect())
    assert got == [(-1, 360, 354), (1, 0, 0), (2, 0, 0), (3, 300, 299), (3, 300, 300), (5, 7, 0), (6, 3, 0)]
    assert suffix_dedup.dedup_text(odd).columns == odd.columns
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a", None), (1, "http://a", None), (None, None, ""), (4, "u\nv", "x"), (5, "é", "x"), (6, "b", "é<p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = written(warc.read_archives(warc.archive_pages(df), payloads=True), "t")
    assert sorted(bytes(r.payload) for r in records.collect() if r.record_type == "response") == [b"", b"x", "é<p>".encode()]
    got = sorted((r.key or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolved(records).collect())
    assert got == [(-1, 0, "revisit", 1), (1, 0, "response", None), (1, 0, "revisit", 1), (4, 1, "revisit", 5), (5, 1, "response", None), (6, 5, "response", None)]
    assert {r.payload_digest for r in records.collect()} == {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in rows}
    assert all(r.record_type == "response" for r in warc.resolved(warc.read_archives(warc.archive_pages(df, min_bytes=9))).collect())
    assert warc.read_archives(warc.archive_pages(df.limit(0))).count() == 0


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog and then some more words follow here to make it long enough."
    edited = item.replace("quick", "quack").replace("lazy", "lady")
    docs = [(1, "Start. " + item.upper() + " End."), (2, "x " + edited + " y"), (3, item[:50]), (4, None), (5, ""), (6, item.replace(" ", "\n ")), (7, "clean " * 50)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_matches(d, b).collect()) == [(1, 1, 0), (2, 1, 2), (6, 1, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [3, 4, 5, 7]
    assert decontaminate.find_matches(d, b.limit(0)).count() == decontaminate.find_matches(d.limit(0), b).count() == 0


def test_band_distance_is_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        item, region = rng.integers(0, 3, 12), rng.integers(0, 3, 20)
        d = np.zeros((13, 21), int)
        d[:, 0] = range(13)
        for i in range(1, 13):
            for j in range(1, 21):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (item[i - 1] != region[j - 1]))
        best = d[12].min()
        assert decontaminate.band_distance(item, region, -12, 20, 12)[0] == best


def test_url_filter(spark, odd):
    urls = ["http://x.net/a", "http://www.EXAMPLE.net/en/1", "ftp://example.com/de/?q", "https://a.org/fr/", "https://a.org", None, "nothing"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r._row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("x.net", "/a", "net/", "block") and got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][:3] == ("a.org", "", None) and got[5][:3] == got[6][:3] == ("", "", None)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_boosted_trees_learn():
    x = np.random.default_rng(0).random((2000, 10))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    p = url_filter.BoostedTrees.fit(x, y).predict(x)
    assert ((p > 0.5) == y).mean() > 0.97


def test_mixing_sources(spark, odd):
    got = mixing.with_copies(odd, mixing.word_count(odd["text"])).collect()
    assert len(got) == len(ODD) and all(0 <= r._copies <= 2 for r in got)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = mixing.with_copies(docs, mixing.word_count(docs["text"])).collect()
    total = sum(r._size for r in rows)
    targets = {r._row.source: r._target for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    assert abs(sum(r._copies * r._size for r in rows) - 1.5 * total) < 0.15 * total
    assert mixing.mix(docs).count() == sum(r._copies for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_html_extraction():
    page = ("<html><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p><b>First text<br>more</b><p>Second\n text"
            "</article><aside>side</aside><div id=comments>no</div><footer>&copy;</footer>")
    assert html_extract.main_text(page) == "T & U\n\nFirst text more\n\nSecond text"
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "<script>var a='<p>x</p>'</script>")] == ["", "", "", ""]


def test_token_counts(spark):
    c = token_counts.counter(token_counts.default_path())
    for t in ["", "a", " ", "ab " * 3000, "x" * 5000, "é a\nb  " * 900, "a" + " " * 3000 + "b"]:
        assert c.count_long(t, 500, 16) == len(c.sp.encode(t))


def test_quality_and_mixing_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    for name in ("op5_mixing", "op9_quality_rules"):
        a, b = registry.QUERIES[name](spark, DIR).toPandas(), con.sql(registry.SQL[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert a.equals(b)


def test_quality_odd(odd):
    got = sorted((r.doc_id or -1, r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.judge(odd).collect())
    assert got == [(-1, 120, 120, False), (1, 0, 0, False), (2, 0, 0, False), (3, 1, 0, False), (3, 1, 0, False), (5, 2, 0, False), (6, 0, 0, False)]
    clash = odd.withColumnRenamed("source", "n_words")
    assert quality_rules.quality_filter(clash).columns == clash.columns


def test_toxicity_learns():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    y = rng.integers(0, 2, 400).astype(float)
    texts = [" ".join(rng.choice(words, 60)) + (" vileword" if t else "") for t in y]
    m = toxicity.NBLinear.fit(texts[:300], y[:300])
    import pyarrow as pa
    from llm.kernels import text_buffer
    assert ((m.score(*text_buffer(pa.array(texts[300:]))) >= 0.5) == (y[300:] == 1)).mean() > 0.95
    assert 0 <= m.score(*text_buffer(pa.array([None, ""])))[0] <= 1


def test_toxicity_prior_at_any_size(spark, monkeypatch):
    """A text without evidence scores the share of toxic labels, whichever caps bind."""
    texts = [(i, int(i % 10 == 0), f"plain words number {i % 7}" + (" vileword" if i % 20 == 0 else "")) for i in range(1500)]
    docs = spark.createDataFrame([(i, x) for i, _, x in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in texts], "doc_id long, toxic int")

    def plain(per_class):
        monkeypatch.setattr(toxicity.training_rows, "__defaults__", (per_class,))
        import pyarrow as pa
        from llm.kernels import text_buffer
        return toxicity.fit(docs, labels).score(*text_buffer(pa.array(["plain words number 3"])))[0]

    whole, capped = plain(10_000), plain(60)
    assert whole < 0.2 and abs(whole - capped) < 0.05


def test_html_extraction_keeps_all_containers():
    def paragraphs(name, n):
        return [f"{name}{i} " + "plain words of a text that goes on " * 8 for i in range(n)]

    def section(tag, texts):
        return f"<{tag}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{tag}>"

    one, two = paragraphs("a", 5), paragraphs("b", 4)
    links = "<ul>" + "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(30)) + "</ul>"
    want = [t.strip() for t in one + two]
    for page in (f"<div id=content>{section('section', one)}{section('section', two)}</div>",
                 f"{section('div', one)}<div>{links}</div>{section('div', two)}",
                 f"{section('article', one)}{section('article', two)}"):
        assert html_extract.main_text(f"<html><body>{links}{page}{links}</body></html>").split("\n\n") == want
    page = f"<div><h1>Title</h1>{section('section', one)}<h2>More</h2>{section('section', two)}</div>"
    assert html_extract.main_text(f"<body>{links}{page}</body>").split("\n\n") == ["Title", *want[:5], "More", *want[5:]]


def test_html_extraction_cuts_only_boilerplate():
    text = "plain words of a text that goes on " * 8
    want = [text.strip()] * 3
    for attrs in ('class="content has-sidebar"', 'class="no-comments"', 'id="search-page"', 'class="sidebar"', 'data-state="hidden"', 'data-class="ad"', 'title="hidden costs"'):
        for inner in (f"<article><p>{text}<p>{text}<p>{text}</article>", f"<p>{text}<p>{text}<p>{text}"):
            assert html_extract.main_text(f"<body><div {attrs}>{inner}</div></body>").split("\n\n") == want
    page = f'<article><p>See <a href="/hidden-falls">the falls</a>. {text}<p title="hidden costs">{text}<p data-state="hidden">{text}'
    assert html_extract.main_text(page).split("\n\n") == ["See the falls. " + want[0], want[1], want[2]]
    for noise in ('class="cookie-banner"', "id=siteFooter", "hidden", 'class="x comment-list"', 'aria-hidden="true"', "role=navigation", "style='display: none'"):
        assert html_extract.main_text(f"<body><article><p>{text}<p>{text}<div {noise}>boilerplate</div><p>{text}</article><div {noise}>{text}</div>").split("\n\n") == want


def test_decontamination_clustered_edits():
    """Edits at the full budget in one part of a long item, beside a short item."""
    rng = np.random.default_rng(0)
    long, short = ("".join(rng.choice(list("abcdefghijklmnop"), n)) for n in (394, 81))
    k = decontaminate.budget(len(long))
    edited = "".join("z" if i % 9 == 4 and i < 9 * k else c for i, c in enumerate(long))
    assert edited.count("z") == k == 31
    index = decontaminate.Index(np.array([1, 2]), [decontaminate.codes(long), decontaminate.codes(short)])
    other = "".join(rng.choice(list("qrstuvwxy"), 600))
    assert [(r, i, d) for r, i, _, _, d in index.scan([other + edited + other])] == [(0, 0, k)]
