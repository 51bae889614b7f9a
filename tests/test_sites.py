"""Crawls, robots, extraction and research on the small cases of the domain."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crawl, monitor, ops, research
from corpusloom.functions.documents import extract

ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /public"


def site(spark):
    pages = [("https://a.com/", "<title>A</title><a href='/public'>x</a><a href='/private'>y</a><a href='https://b.org/'>z</a>", 200),
             ("https://a.com/public", "<title>P</title><body>text <a href='/'>home</a><a href='/gone'>g</a>", 200)]
    robots = [("https://a.com", 200, ROBOTS)]
    return spark.createDataFrame(pages, "url string, html string, status int"), spark.createDataFrame(robots, "origin string, status int, body string")


def test_crawl_skips_what_robots_close(spark):
    documents, summary = crawl.crawl_site(*site(spark), "https://a.com/", 10)
    assert [(r.url, r.depth, r.discovered_from) for r in documents.orderBy("ord").collect()] == [("https://a.com/", 0, None), ("https://a.com/public", 1, "https://a.com/")]
    s = summary.first()
    assert (s.visited, s.discovered, s.excluded, s.errors, s.stopped_reason) == (3, 2, 1, 1, "scope_exhausted")
    assert crawl.crawl_site(*site(spark), "https://a.com/", 1)[1].first().stopped_reason == "limit_reached"


def test_seed_gate_and_modes(spark):
    pages, robots = site(spark)
    with pytest.raises(crawl.RobotsDenied):
        crawl.map_site(pages, robots, "https://a.com/private", 5)
    down = robots.withColumn("status", F.lit(500))
    with pytest.raises(crawl.RobotsDenied):
        crawl.map_site(pages, down, "https://a.com/", 5, mode="strict")
    urls = spark.createDataFrame([("https://a.com", "/public/page"), ("https://a.com", "/private/page")], "origin string, path string")
    got = {r.path: (r.allowed, r.reason) for r in crawl.robots_decisions(urls, robots).collect()}
    assert got == {"/public/page": (True, "allowed"), "/private/page": (False, "disallowed")}


def test_extract_rejects_domains(spark):
    pages, _ = site(spark)
    documents, rejected = extract(pages.unionByName(pages.withColumn("url", F.lit("https://x.bad.net/"))), deny=["bad.net"])
    assert documents.count() == 2 and {r.host for r in rejected.collect()} == {"x.bad.net"}


def test_research_topic(spark):
    sources = spark.createDataFrame([(f"https://d{i}.com/p", f"d{i}.com", "CRM pricing", "free CRM", "q", i) for i in range(3)],
                                    "url string, domain string, title string, snippet string, source_query string, ord int")
    text = "CRM pricing plan comparison with free trial and official announcement"
    rows = [("https://d0.com/p", "d0.com", "Pricing", text, .8, .9, None, False, None), ("https://d1.com/p", "d1.com", "Docs", text, .8, .9, None, False, None)]
    got = spark.createDataFrame(rows, "url string, domain string, title string, text string, confidence double, quality double, author string, structured boolean, category string")
    out = research.research_topic(sources, got, "CRM pricing")
    s = out["stats"].first()
    assert (s.source_count, s.document_count, s.unique_domain_count, s.duplicate_ratio) == (3, 2, 3, 0.0)
    assert {r.completed for r in research.checkpoints(sources, out["documents"]).collect()} == {True, False}
    tasks = spark.createDataFrame([("a", "completed", True), ("b", "extracting", False)], "task_id string, status string, has_result boolean")
    assert [research.resume(tasks, t) for t in ("a", "b", "c")] == ["report", "research", None]


def test_topic_runs(spark):
    rows = [("t", 1, 0, "news", False, False), ("t", 1, 1, "forum", True, True), ("t", 2, 0, "news", True, True), ("t", 2, 1, "forum", True, False)]
    checks = spark.createDataFrame(rows, "task_id string, run int, pos int, target string, checked boolean, changed boolean").withColumn("alerts", F.array().cast("array<string>"))
    tasks = spark.createDataFrame([("t", "crm")], "task_id string, topic string")
    got = {r.run: (r.changed, r.new, r.persistent, r.dropped, r.refresh) for r in monitor.topic_runs(checks, tasks).collect()}
    assert got == {1: (["forum"], ["forum"], [], [], True), 2: (["news"], ["news"], [], ["forum"], True)}


def test_worker_pick_and_complete(spark):
    jobs = spark.createDataFrame([("j1", "web", "ap-sg", 1, None), ("j2", "web", "ap-sg", 2, None), (None, None, None, 3, "j1"), ("j3", "web", "ap-sg", 4, None)],
                                 "job_id string, namespace string, preferred_region string, ord int, completes string")
    workers = spark.createDataFrame([("w-us", "us-east", ["web"], 0, 5), ("w-ap", "ap-sg", ["web"], 0, 1)], "worker_id string, region string, namespaces array<string>, active int, capacity int")
    assert [(r.job_id, r.worker_id) for r in ops.assign_workers(jobs, workers).collect()] == [("j1", "w-ap"), ("j2", "w-us"), ("j3", "w-ap")]
