"""Saved state and site-map files."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.sitemaps import read_sitemaps
from corpusloom.sources.stores import Store, last_given, registry_rows

FIELDS = "id long, name string, n int, at long"
MERGE = last_given("id", "at", ["name", "n"])


def held(store, *version):
    return {r.id: (r.name, r.n, r.at) for r in store.rows(*version).collect()}


def test_saves_merge_and_touch_only_their_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], FIELDS).schema
    store = Store(spark, f"file://{tmp_path}/s", "id", schema).create(8)
    assert held(store) == {}
    assert store.save(spark.range(100).select("id", F.lit("a").alias("name"), F.lit(1).alias("n"), F.lit(1).cast("long").alias("at"), F.lit("x").alias("extra")), MERGE) == 1
    before = store.folders()[1]
    changes = spark.createDataFrame([(7, None, 5, 2), (7, "b", None, 3), (1000, None, None, 2), (None, "z", 1, 2)], FIELDS)
    assert store.save(changes, MERGE) == 2
    got, want = held(store), {i: ("a", 1, 1) for i in range(100)}
    assert got == want | {7: ("b", 5, 3), 1000: (None, None, 2), None: ("z", 1, 2)}
    after = store.folders()[1]
    moved = {b for b in after if after[b] != before[b]}
    assert 0 < len(moved) <= 3 and len(after) == 8
    new = {after[b] for b in moved}.pop()
    assert {int(os.path.basename(p).split("=")[1]) for p in glob.glob(new.removeprefix("file://") + "/_bucket=*")} == moved
    assert held(store, 1) == want
    assert store.save(changes.limit(0), MERGE) == 2
    assert {r.id: r.name for r in store.get([7, None, 55, 4444]).collect()} == {7: "b", None: "z", 55: "a"}


def test_a_failed_save_leaves_the_version_before(spark, tmp_path):
    schema = spark.createDataFrame([], FIELDS).schema
    store = Store(spark, f"file://{tmp_path}/s", "id", schema).create(4)
    rows = spark.range(20).select("id", F.lit("a").alias("name"), F.lit(1).alias("n"), F.lit(1).cast("long").alias("at"))
    store.save(rows, MERGE)
    store.save(rows.withColumns({"n": F.lit(2), "at": F.lit(2).cast("long")}), MERGE)
    kept = held(store)
    with pytest.raises(Exception, match="no such thing"):
        store.save(rows.withColumn("n", F.when(F.col("id") == 13, F.raise_error(F.lit("no such thing"))).otherwise(3).cast("int")), MERGE)
    assert held(store) == kept and store.folders()[0] == 2
    with pytest.raises(Exception):  # the second of two saves of one version
        store._publish(2, [(b, None) for b in range(4)])
    with pytest.raises(Exception):
        store.create(4)
    assert held(store) == kept
    assert store.save(rows.withColumns({"n": F.lit(3), "at": F.lit(3).cast("long")}), MERGE) == 3 and held(store)[13] == ("a", 3, 3)


def test_registry_in_parts_equals_all_at_once(spark, tmp_path):
    fields = "task_id string, task_type string, topic string, status string, related array<string>, created_at long, updated_at long"
    rows = [("a", "r", "t", "queued", ["x"], 1, 1), ("b", "m", None, "queued", None, 1, 1), ("a", "r", None, "done", ["y", "x"], 2, 2), ("b", "m", "u", "failed", ["q"], 5, 5), ("a", "r", None, "done", ["x", "z"], 7, 7)]
    events = spark.createDataFrame(rows, fields)
    store = Store(spark, f"file://{tmp_path}/s", "task_id", events.schema).create(3)
    for low, high in ((0, 1), (1, 2), (2, 9)):
        store.save(events.filter(f"updated_at > {low} and updated_at <= {high}"), registry_rows)
    got = {r.task_id: tuple(r)[1:] for r in store.rows().collect()}
    assert got == {"a": ("r", "t", "done", ["x", "y", "z"], 1, 7), "b": ("m", "u", "failed", ["q"], 1, 5)}
    assert got == {r.task_id: tuple(r)[1:] for r in registry_rows(events).select(*events.columns).collect()}


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://s.org/0.9"><url><loc> https://a.com/1?x=1&amp;y=2 </loc><lastmod>2024-01-01</lastmod><priority>0.5</priority></url>\n'
                                    "<url><loc>https://a.com/2</loc><priority>high</priority></url><url><loc/></url><url><priority>1</priority></url></urlset>")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(b'<s:urlset xmlns:s="http://x"><s:url><s:loc>https://b.com/1</s:loc></s:url><s:url><s:loc>https://b.com/2</s:loc><s:changefreq>daily</s:changefreq></s:url></s:urlset>'))
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>https://a.com/a.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "cut.xml").write_text("<urlset><url><loc>https://c.com/1</loc></url><url><loc>https://c.com/2")
    (tmp_path / "empty.xml").write_text("")
    got = read_sitemaps(spark, f"file://{tmp_path}", F.regexp_extract("file", "([^/]+)$", 1)).orderBy("sitemap", "block", "pos").collect()
    assert [tuple(r)[:6] for r in got] == [
        ("a.xml", "https://a.com/1?x=1&y=2", "2024-01-01", None, .5, False), ("a.xml", "https://a.com/2", None, None, None, False),
        ("b.xml.gz", "https://b.com/1", None, None, None, False), ("b.xml.gz", "https://b.com/2", None, "daily", None, False),
        ("cut.xml", "https://c.com/1", None, None, None, False), ("index.xml", "https://a.com/a.xml", None, None, None, True)]
