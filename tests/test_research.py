"""Structured extraction, research reports, registry and digests on small fixtures."""

from corpusloom.functions import structured as S
from corpusloom.functions import urls as U
from corpusloom.operators import ops, registry, research
from corpusloom.sources.tables import discovered_sitemap
from pyspark.sql import functions as F

GUIDE = ('<html><head><title>T</title></head><body><nav><a href="/docs">D</a><a href="/docs/api">A</a></nav><div class="table-of-contents"><a href="#i">I</a></div>'
         "<main><section><h1>First  steps</h1><h2>Install</h2><pre><code>run me</code></pre></section></main></body></html>")
STORY = ('<head><meta property="og:type" content="article"><meta name="author" content="Ada"><meta property="article:modified_time" content="2026-03-12">'
         '<meta property="article:tag" content="x"><script type="application/ld+json">[{"@type":["article"],"articleSection":"News","author":{"name":"Bo"}}]</script>'
         '<script type="application/ld+json">{broken</script></head><article><h1>My story</h1><time datetime="2026-03-11">March</time></article>')


def test_structured_kinds():
    g = S.fields(GUIDE, "https://h.org/docs")
    assert (g["kind"], g["heading_tree"], g["code_blocks"], g["nav_links"], g["sections"], g["has_toc"], g["path_type"]) == (
        "docs", ["First steps", "Install"], 1, 2, 1, True, "guide")
    a = S.fields(STORY, "https://h.org/x")
    assert (a["kind"], a["headline"], a["author"], a["published_at"], a["updated_at"], a["section"], a["tags"]) == (
        "article", "My story", "Ada", "2026-03-11", "2026-03-12", "News", 1)
    p = S.fields('<h1>Cup</h1><span itemprop="price">€ 12,50</span><link itemprop="availability" href="InStock">', "https://h.org/cup")
    assert (p["kind"], p["name"], p["price"], p["currency"], p["availability"]) == ("product", "Cup", 12.5, "EUR", "InStock")
    f = S.fields('<h1>Q</h1><div class="comment"><b class="author">A</b></div><div class="comment"><b class=author>A</b></div>', "https://h.org/q")
    assert (f["kind"], f["posts"], f["authors"], f["thread_title"]) == ("forum", 2, 1, "Q")
    c = S.fields("<h2>1.1</h2><ul><li>a breaking change<li>b</ul><h2>1.0</h2>", "https://h.org/releases")
    assert (c["kind"], c["versions"], c["entries"], c["has_breaking_changes"], c["has_dates"]) == ("changelog", ["1.1", "1.0"], 2, True, False)
    d = S.fields('<p>docusaurus</p><div class="theme-doc-sidebar"><nav><a>x</a></nav></div><main><h1>H</h1></main>', "https://h.org/docs/x")
    assert (d["kind"], d["nav_links"], d["has_sidebar"], d["path_type"], d["heading_tree"]) == ("docusaurus", 1, True, "docs", ["H"])
    m = S.fields('<div class="md-content"><div class="highlight"><pre class="code">x</pre></div><article><h2>M</h2></article></div>', "https://h.org/guide/x")
    assert (m["kind"], m["code_blocks"], m["heading_tree"], m["path_type"]) == ("mkdocs", 1, ["M"], "guide")
    assert S.fields('<div class="markdown-body"><h2>G</h2><a>x</a></div>', "https://github.com/a")["links"] == 1
    assert S.fields("<p>nothing</p><div", "https://h.org/") == {"kind": None}


def test_structured_column(spark):
    df = spark.createDataFrame([(1, GUIDE, "https://h.org/docs"), (2, None, "https://h.org/"), (3, "<p>x", "https://h.org/")], "id int, html string, url string")
    # blocks are joined without a space: "DAIFirst stepsInstallrun me"
    got = {r.id: r for r in df.select("id", S.structured(F.col("html"), F.col("url")).alias("s")).select("id", "s", S.normalised(F.col("s")).alias("n")).collect()}
    assert got[1].s.words == 3 and got[1].n.category == "guide" and got[1].n.key_points == ["First steps", "Install"]
    assert got[2].s is got[3].s is got[2].n is None


def test_dot_segments(spark):
    want = {"../c?x=../y": "http://h/a/c?x=../y", "./d": "http://h/a/b/d", "/../../e/.": "http://h/e/", "f/../..": "http://h/a/", "g": "http://h/a/b/g"}
    df = spark.createDataFrame([(k,) for k in want], "href string")
    got = {r.href: r.u for r in df.select("href", U.resolve(F.col("href"), F.lit("http://h/a/b/p")).alias("u")).collect()}
    assert got == want


def test_plan_and_caps():
    p = research.plan("CRM", "compare", "en", region="TW")
    assert p["queries"][0] == "CRM TW 比較" and len(p["queries"]) == 8 and p["queries"][-1] == "CRM comparison"
    assert research.per_query_limit(20, 8) == 3 and research.document_cap(30, 50) == 12 and research.document_cap(2, 50) == 2


DOCS = [
    (1, "https://example.com/pricing", "example.com", "CRM Pricing Free Trial", "CRM pricing plan comparison for Taiwan with free trial and official announcement.", 0.75, 0.80, 0.80),
    (2, "https://another.com/docs", "another.com", "CRM Docs Paid Plans",
     "Documentation and guide for CRM setup, paid subscription only and some negative complaint signals.", 0.74, 0.78, 0.76),
    (3, "https://third.com/review", "third.com", "CRM Best Review", "Best recommended CRM with positive sentiment and official release coverage.", 0.73, 0.77, 0.74),
]


def test_report(spark):
    docs = spark.createDataFrame(DOCS, "ord int, url string, domain string, title string, text string, confidence double, quality double, evidence double")
    docs = docs.withColumns({"label": research.content_label(F.lit(None).cast("string"), F.col("title"), F.col("url")), "structured": F.lit(False), "author": F.lit(None).cast("string")})
    found = research.clusters(docs)
    assert [(r.cluster_id, len(r.urls)) for r in found.orderBy("n").collect()] == [("cluster_1_pricing", 2), ("cluster_2_reviews", 1)]
    assert {r.ord: r.cluster_id for r in research.with_clusters(docs, found).collect()}[2] == "cluster_1_pricing"
    bullets = research.report(docs, "CRM", 1)
    n = {s: sum(r.section == s for r in bullets.collect()) for s in research.SECTIONS}
    assert n == {"Coverage": 1, "Key Insights": 3, "Trend Signals": 3, "Agreements": 1, "Contradictions": 2, "Uncertainties": 2}
    text = research.markdown(bullets, "CRM", research.executive_summary("CRM", 3, 1))
    assert text.startswith("# Research Report: CRM\n\nResearch report for") and "sources are present (example.com, third.com)." in text
    rows = {r.label: r["values"] for r in research.comparison(docs).collect()}
    assert len(rows) == 6 and rows["quality_score"]["another.com"] == "0.78" and rows["author_or_owner"]["third.com"] == "n/a"
    empty = research.report(docs.limit(0), "CRM", 0).collect()
    assert {r.section for r in empty} == {"Coverage", "Key Insights", "Uncertainties"}


def test_findings_and_sources(spark):
    s = spark.createDataFrame([(1, "a.com", 0.9, 0.6), (2, "b.com", 0.2, 0.85), (3, "b.com", 0.8, 0.85)], "ord int, domain string, evidence double, quality double")
    got = {r.label: r.detail for r in research.findings(s, 2, "t").collect()}
    assert got["top_domains"].endswith("b.com, a.com.") and got["high_signal_sources"].startswith("2 ") and "3 candidate sources and 2" in got["coverage"]
    assert research.confidence_notes(s, 0).count() == 4 and len(research.findings(s.limit(0), 0, "t").collect()) == 2
    seeds = spark.createDataFrame([("https://a.com/x", "a.com", "A", "s", "q", i) for i in (1, 2)], "url string, domain string, title string, snippet string, source_query string, ord int")
    more = spark.createDataFrame([("https://a.com/docs/set-up", "a.com", 1), ("https://a.com/none", "a.com", 2), ("https://a.com/x", "a.com", 3)], "url string, domain string, ord int")
    assert [(r.rank, r.title) for r in research.discover(seeds, more, 9).orderBy("rank").collect()] == [(1, "A"), (2, "a.com docs set up")]


def test_registry(spark):
    e = spark.createDataFrame([("t1", "research_topic", "crm", "running", ["t2"], 1), ("t1", "research_topic", None, "completed", ["t2", "t9"], 5), ("t2", "monitor_topic", "crm", "active", None, 3)],
                              "task_id string, task_type string, topic string, status string, related array<string>, at int")
    tasks = registry.registered(e)
    got = {r.task_id: r for r in tasks.collect()}
    assert got["t1"][1:] == ("research_topic", "crm", "completed", ["t2", "t9"], 1, 5) and got["t2"].related == []
    assert [(r.of, r.task_id) for r in registry.related(tasks).collect()] == [("t1", "t2")]
    det = spark.createDataFrame([("t1", None, list("abcde"), list("xyz")), ("t2", "s", list("ab"), list("wxyz"))], "task_id string, summary string, insights array<string>, second array<string>")
    b = {r.task_id: r for r in registry.task_briefings(tasks, det).collect()}
    assert b["t1"].summary == "Research task t1 is completed." and b["t1"].highlights == list("abcdxy") and b["t1"].related_tasks == ["t2"]
    assert b["t2"].highlights == list("abwxy")
    d = spark.createDataFrame([("crm", f"t{i}", i, "watch" if i % 2 else "info", f"s{i}", [f"b{i}1", f"b{i}2"], f"n{i}") for i in range(1, 8)],
                              "topic string, task_id string, delivered_at int, severity string, summary string, bullets array<string>, title string")
    r = registry.topic_briefings(tasks, d).first()
    assert r.latest_tasks == ["t1", "t2"] and r.latest_titles == ["n7", "n6", "n5", "n4", "n3"]
    assert (r.deliveries, r.severities, r.latest_summary, r.highlights[:2], len(r.highlights)) == (5, ["watch", "info"], "s7", ["b71", "b72"], 8)
    assert registry.kept_deliveries(d, 3).count() == 3


def test_digest(spark):
    runs = spark.createDataFrame([("x", 1, ["a", "b", "c"], [], [], []), ("x", 2, [], ["a"], ["b"], ["p"]), ("x", 3, [], ["a"], [], ["p"])],
                                 "topic string, run int, new array<string>, persistent array<string>, dropped array<string>, changed array<string>")
    got = registry.digest(runs).orderBy("run").collect()
    assert [r.severity for r in got] == ["critical", "watch", "info"]
    assert got[0].summary.startswith('Initial digest for "x": 3 active') and got[1].bullets[-1] == "Top persistent signal: a" and len(got[0].bullets) == 4


def test_outcomes_and_workers(spark):
    df = spark.createDataFrame([("dom_shell_detected", None), ("low_confidence", False), (None, True), (None, None)], "reason string, auto boolean")
    got = [tuple(r.c) for r in df.select(ops.classified(F.col("reason"), F.col("auto")).alias("c")).collect()]
    assert [x[:3] for x in got] == [(1, True, True), (1, True, False), (1, True, False), (0, False, False)] and got[1][3] == "Low extraction confidence score"
    w = spark.createDataFrame([("w-ap", "ap", ["n"], 0, 2), ("w-us", "us", ["n", "m"], 0, 1)], "worker_id string, region string, namespaces array<string>, active int, capacity int")
    j = spark.createDataFrame([("1", "n", "us", 1), ("2", "n", "us", 2), ("3", "m", None, 3), ("4", "n", None, 4)], "job_id string, namespace string, preferred_region string, ord int")
    assert {r.job_id: r.worker_id for r in ops.assign_workers(j, w).collect()} == {"1": "w-us", "2": "w-ap", "3": None, "4": "w-ap"}


def test_sitemap_discovery(spark):
    cand = spark.createDataFrame([("o", 0, "o/none.xml"), ("o", 1, "o/index.xml"), ("o", 2, "o/late.xml")], "origin string, ordinal int, url string")
    docs = spark.createDataFrame([
        ("o/none.xml", "<urlset></urlset>"), ("o/index.xml", "<sitemapindex><sitemap><loc>o/a.xml</loc></sitemap><sitemap><loc>o/gone.xml</loc></sitemap></sitemapindex>"),
        ("o/a.xml", "<urlset><url><loc>o/1</loc><priority>0.8</priority></url></urlset>"), ("o/late.xml", "<urlset><url><loc>o/2</loc></url></urlset>")], "url string, xml string")
    assert [tuple(r) for r in discovered_sitemap(cand, docs).collect()] == [("o", "o/1", None, None, 0.8, "o/index.xml")]


def test_ewma_and_first_seen(spark):
    from corpusloom.operators import corpus
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, None), ("a", 4, 0.0), (None, 5, 1.0), (None, 6, 2.0)], "k string, o int, v double")
    got = {r.k: r.state for r in ops.ewma(df, "k", "o", F.col("v")).collect()}
    assert abs(got["a"] - 0.9 * (0.9 * 10 + 0.1 * 20)) < 1e-12 and abs(got[None] - 1.1) < 1e-12
    assert sorted(r.o for r in corpus.first_seen(df, "k", "o").collect()) == [1, 5]
