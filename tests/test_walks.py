"""Crawls of many seeds in one loop against a crawl of each."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crawl, scans

ROBOTS = "User-agent: *\nDisallow: /p3"


def web(spark, hosts=3, pages=11, seed=5):
    """Sites that link to pages of their own and of others; some pages are missing or closed."""
    pick = random.Random(seed)
    urls = [f"https://s{h}.org/p{i}" if i else f"https://s{h}.org/" for h in range(hosts) for i in range(pages)]
    rows = [(u, "<title>t</title><body>words of a page " + " ".join(f"<a href='{pick.choice(urls)}'>x</a>" for _ in range(9)), 404 if pick.random() < .15 and not u.endswith("/") else 200) for u in urls]
    robots = [(f"https://s{h}.org", 200 if h else 404, ROBOTS) for h in range(hosts)]
    return spark.createDataFrame(rows, "url string, html string, status int").cache(), spark.createDataFrame(robots, "origin string, status int, body string").cache()


SEEDS = [("https://s0.org/", None), ("https://s1.org/", 4), ("https://s2.org/", 7), ("https://s2.org/p9", None)]


@pytest.mark.parametrize("extracting, hot", [(False, 10**6), (True, 2)])
def test_many_seeds_equal_each_alone(spark, monkeypatch, extracting, hot):
    monkeypatch.setattr(scans, "HOT", hot)
    pages, robots = web(spark)
    options = dict(extracting=extracting, exclude_paths=["/p2"], max_depth=3)
    found = crawl.walks(pages, robots, spark.createDataFrame(SEEDS, "seed string, limit int"), **options)
    urls, summary = found.urls.collect(), {r.seed: r for r in found.summary.collect()}
    assert len(summary) == len(SEEDS)
    monkeypatch.setattr(scans, "HOT", 10**6)
    for seed, limit in SEEDS:
        alone = crawl.walk(pages, robots, seed, limit, **options)
        mine = sorted((r for r in urls if r.seed == seed), key=lambda r: r.ord)
        assert [tuple(r)[1:] for r in mine] == [tuple(r) for r in alone.urls.orderBy("ord").collect()] and mine
        assert tuple(summary[seed])[1:] == tuple(alone.summary.first())
    assert summary["https://s1.org/"].stopped_reason == "limit_reached"


def test_found_in_the_order_of_a_queue(spark):
    """Against a breadth-first search by hand, with a limit for each seed."""
    pages, robots = web(spark, seed=8)
    links = {r.url: [] for r in pages.collect()}
    for r in crawl.link_edges(pages).orderBy("src", "pos").collect():
        links[r.src].append(r.dst)
    ok = {r.url for r in pages.filter("status = 200").collect()}
    for limit in (3, 6, None):
        rows = crawl.map_sites(pages, robots, spark.createDataFrame([(s, limit) for s, _ in SEEDS], "seed string, limit int"), max_depth=2).urls.orderBy("seed", "ord").collect()
        for seed, _ in SEEDS:
            host, want, queue = seed.split("/")[2], [(seed, 0)], [(seed, 0)]
            while queue:
                at, depth = queue.pop(0)
                for to in links[at] if at in ok and depth < 2 else []:
                    shut = host != "s0.org" and "/p3" in to
                    if to.split("/")[2] == host and not shut and to not in {u for u, _ in want}:
                        want.append((to, depth + 1))
                        queue.append((to, depth + 1))
            assert [(r.url, r.depth) for r in rows if r.seed == seed] == want[:limit]


def test_odd_seeds(spark):
    pages, robots = web(spark)
    seeds = [("https://s1.org/p3", 5), (None, 1), ("no url", None), ("https://s0.org/", 2), ("https://s0.org/", None), ("https://empty.net/", 9)]
    found = crawl.map_sites(pages, robots, spark.createDataFrame(seeds, "seed string, limit int"))
    got = {r.seed: (r.stopped_reason, r.discovered) for r in found.summary.collect()}
    alone = crawl.walk(pages, robots, "https://s0.org/", None).urls.count()
    assert got == {"https://s1.org/p3": ("robots_denied", 0), None: ("invalid_seed", 0), "no url": ("invalid_seed", 0), "https://s0.org/": ("scope_exhausted", alone), "https://empty.net/": ("scope_exhausted", 1)}
    none = crawl.map_sites(pages, robots, spark.createDataFrame([], "seed string, limit int"))
    assert none.urls.count() == 0 and none.summary.count() == 0


def test_site_maps_of_some_seeds(spark):
    pages, robots = web(spark)
    entries = [("https://s1.org/", f"https://s1.org/p{i % 6}", i) for i in range(9)] + [("https://s2.org/", "https://else.net/", 1), ("https://s2.org/p9", "/p1", 4)]
    listed = spark.createDataFrame(entries, "seed string, loc string, pos int")
    found = crawl.walks(pages, robots, spark.createDataFrame(SEEDS, "seed string, limit int"), sitemap=listed)
    by = {(r.seed, r.discovered_by): r.n for r in found.urls.groupBy("seed", "discovered_by").agg(F.count("*").alias("n")).collect()}
    assert by["https://s1.org/", "sitemap"] == 3 and ("https://s1.org/", "bfs") not in by and ("https://s2.org/", "sitemap") not in by and by["https://s2.org/p9", "sitemap"] == 1
    alone = crawl.walk(pages, robots, "https://s1.org/", 4, sitemap=listed.filter("seed = 'https://s1.org/'").select("loc", "pos")).summary.first()
    assert tuple(alone) == tuple(found.summary.filter("seed = 'https://s1.org/'").first())[1:] and (alone.visited, alone.robots_blocked) == (4, 1)


def test_rounds_do_not_grow_with_seeds(spark, monkeypatch):
    pages, robots = web(spark)
    made, cut = [], crawl.cut
    monkeypatch.setattr(crawl, "cut", lambda df: made.append(1) or cut(df))
    crawl.map_sites(pages, robots, spark.createDataFrame([("https://s0.org/", 50)], "seed string, limit int"))
    one = len(made)
    crawl.map_sites(pages, robots, pages.select(F.col("url").alias("seed"), F.lit(50).alias("limit")))
    assert len(made) == 2 * one


def test_domains(spark):
    pages, robots = web(spark)
    pages = pages.withColumn("html", F.replace("html", F.lit("/p1'"), F.lit("/docs/p1'"))).withColumn("url", F.regexp_replace("url", "/$", ""))
    got = crawl.crawl_domains(pages, robots, spark.createDataFrame([(f"s{h}.org/about", None) for h in range(3)], "domain string, limit int"))
    for h in range(3):
        alone, seed = crawl.crawl_domain(pages, robots, f"s{h}.org", None), f"https://s{h}.org"
        for name in ("by_category", "recommended"):
            mine = got[name].filter(F.col("seed") == seed).drop("seed")
            assert sorted(map(repr, mine.select(sorted(mine.columns)).collect())) == sorted(map(repr, alone[name].select(sorted(mine.columns)).collect()))
