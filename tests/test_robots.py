"""Robots rules as a prefix join against a loop over rules."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crawl


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_against_a_loop(no_broadcast):
    spark, r = no_broadcast, random.Random(2)
    paths = ["/" + "".join(r.choice("ab/é") for _ in range(r.randint(0, 6))) for _ in range(60)]
    rules = {(f"o{r.randrange(4)}", r.choice(paths)[:r.randint(1, 5)], r.random() < 0.5) for _ in range(40)}
    urls = [(f"o{i % 6}", p, i) for i, p in enumerate(paths * 3)] + [("o1", None, 1000), (None, "/a", 1001), ("o2", "", 1002)]
    got = crawl.robots_allowed(spark.createDataFrame(urls, "origin string, path string, n int"), spark.createDataFrame(sorted(rules), "origin string, pattern string, allow boolean"))
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    found = {x.n: x.allowed for x in got.collect()}
    for origin, path, n in urls:
        fit = [(len(p), ok) for o, p, ok in rules if o == origin and path is not None and path.startswith(p)]
        assert found[n] == (max(fit)[1] if fit else True)


def test_modes_and_repeated_urls(no_broadcast):
    spark = no_broadcast
    robots = spark.createDataFrame([("a", 200, "user-agent: *\ndisallow: /x\nallow: /x/y\ndisallow: /x/y"), ("b", 404, None), ("c", 500, "user-agent: *\ndisallow: /"), ("d", 200, None)], "origin string, status int, body string")
    urls = spark.createDataFrame([(o, p, i) for i, (o, p) in enumerate([(o, p) for o in "abcde" for p in ("/x", "/x/y/z", "/q")] * 2)], "origin string, path string, state int")
    for mode in ("balanced", "strict"):
        df = crawl.robots_decisions(urls, robots, mode)
        assert df.columns == ["origin", "path", "state", "allowed", "reason"] and "BroadcastExchange" not in df._jdf.queryExecution().toString()
        rows = df.collect()
        assert len(rows) == 30
        for x in rows:
            gone = x.origin in "ce"
            shut = x.origin == "a" and x.path == "/x"
            assert (x.allowed, x.reason) == ((mode == "balanced", "unavailable") if gone else (not shut, "disallowed" if shut else "allowed"))


@pytest.mark.parametrize("line,agent,denied", [("loombot/1.0", "loombot", True), ("Mozilla (LoomBot)", "loombot", True), ("loom", "loombot", False), ("*", "loombot", True), ("otherbot", "loombot", False), ("loombot", "*", False)])
def test_agents_inside_longer_names(spark, line, agent, denied):
    rules = crawl.robots_rules(spark.createDataFrame([("o", f"User-agent: {line}\nDisallow: /")], "origin string, body string"), agent)
    assert bool(rules.collect()) == denied


def test_many_origins_are_a_hash_join(no_broadcast):
    spark = no_broadcast
    n = 200_000
    robots = spark.range(n).select(F.col("id").cast("string").alias("origin"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /a/b\nAllow: /a/b/c").alias("body"))
    urls = spark.range(n).select(F.col("id").cast("string").alias("origin"), F.element_at(F.array(F.lit("/a/b/x"), F.lit("/a/b/c/d"), F.lit("/z")), (F.col("id") % 3 + 1).cast("int")).alias("path"))
    df = crawl.robots_decisions(urls, robots)
    assert df.filter("not allowed").count() == (n + 2) // 3
