"""URL filter: features and trees against plain Python, honest suffix statistics, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import url_filter as U


def test_features_equal_plain_python(spark):
    urls = ["http://a-b.example.com/x/y2?p=1&q=22#f", "", None, "no scheme", "ftp://H", "http://é.org/%20?a", "http://x.net/" + "d/" * 20_000 + "?k"]
    df = U.parsed_urls(spark.createDataFrame([(u,) for u in urls], "url string"), "url")
    cols = U.lexical(F.col("_url"), F.col("host"))
    for r in df.select("_url", "host", "path", *[c.alias(n) for n, c in cols.items()]).collect():
        u = r._url or ""
        rest = re.sub(r"(?s)^.*?://[^/?#]*", "", u)
        sub = ".".join(r.host.split(".")[:-2]) + ("." if r.host.count(".") > 1 else "")
        path = re.match(r"[^?#]*", rest)[0]
        query = rest[len(path) + 1:].partition("#")[0] if rest[len(path):len(path) + 1] == "?" else ""
        bare = sub + rest
        n, c = len(bare), Counter(bare)
        want = {"length": n, "host_length": len(sub), "path_length": len(path), "depth": path.count("/"), "dots": sub.count("."),
                "hyphens": bare.count("-"), "digit_ratio": sum(x in "0123456789" for x in bare) / n if n else 0,
                "entropy": -sum(k / n * math.log2(k / n) for k in c.values()) if n else 0,
                "parameters": query.count("&") + 1 if query else 0, "parameter_length": len(query)}
        for k, v in want.items():
            assert r[k] == pytest.approx(v, abs=1e-9), (u[:40], k)


def test_tree_equals_brute_force():
    """The first split is the one of largest gain over all cuts of all features."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, (400, 3)).astype(float), rng.integers(0, 2, 400).astype(float)
    y[x[:, 1] > 7] = 1
    model = U.BoostedTrees.fit(x, y, trees=1)
    g, h = y - y.mean(), np.full(len(y), y.mean() * (1 - y.mean()))
    best = max((g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1), -j, -c)
               for j in range(3) for c in range(11) for m in [x[:, j] <= c] if min(m.sum(), (~m).sum()) >= U.MIN_LEAF)
    feature, cut, _ = model.trees[0]
    left = x[:, feature[0]] <= cut[0]
    assert feature[0] == -best[1] and (left == (x[:, feature[0]] <= -best[2])).all()


def test_auc():
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 9, 60).astype(float)
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert U.auc(y, s) == pytest.approx(np.mean(pairs))


def urls_of(spark, rows):
    return spark.createDataFrame(rows, "page_id int, url string, verdict string, host string")


def test_no_verdict_follows_from_a_suffix_alone(spark):
    """Labels that only restate three suffixes are no evidence; lexical labels are."""
    rules = (("block", "bad.com", "/"), ("allow", "good.org", "/"))
    rows = [(i, f"http://h{i % 40}.{('bad.com', 'good.org', 'new.net')[i % 3]}/p{i * 7919 % 1000}", None, "x") for i in range(900)]
    got = U.filter_urls(urls_of(spark, rows), rules=rules)
    assert {r.verdict for r in got.filter("rule is null").collect()} == {"allow"}
    labelled = spark.createDataFrame([(f"http://h{i % 50}.s{i % 60}.com/" + ("a/" * 6 if i % 2 else "a"), i % 2) for i in range(1200)], "url string, blocked int")
    asked = urls_of(spark, [(1, "http://q.new.net/b/b/b/b/b/b/", "v", "h"), (2, "http://q.new.net/b", "v", "h"), (2, "http://q.new.net/b", "v", "h"), (3, None, None, None)])
    got = sorted((r._row.page_id, r._row.host, r.rule, r.verdict) for r in U.filter_urls(asked, rules=(), labelled=labelled).collect())
    assert got == [(1, "h", None, "block"), (2, "h", None, "allow"), (2, "h", None, "allow"), (3, None, None, "allow")]


def test_rates_are_out_of_fold_over_all_labels(spark):
    known = spark.createDataFrame([(f"http://h.s{i % 3}.com/{i}", f"s{i % 3}.com", int(i % 5 == 0)) for i in range(300)], "url string, suffix string, blocked long")
    rows = known.withColumn("fold", U.fold_of(F.col("url"))).collect()
    counts = U.suffix_counts(known)
    for r in U.with_suffix_features(known, counts, 0.2, True, U.fold_of(F.col("url"))).collect():
        fold = next(x.fold for x in rows if x.url == r.url)
        others = [x.blocked for x in rows if x.suffix == r.suffix and x.fold != fold]
        assert r.suffix_rate == pytest.approx((sum(others) + 2) / (len(others) + 10))
        assert r.suffix_count == pytest.approx(math.log2(len(others) + 1))


def test_suffix_statistics_need_many_suffixes():
    rng = np.random.default_rng(2)
    few, many = np.repeat(np.arange(10), 100), np.repeat(np.arange(100), 10)
    for group, used in ((few, False), (many, True)):
        rate = rng.random(group.max() + 1)
        y = (rate > 0.5)[group].astype(float)
        x = np.stack([rng.random(1000), rate[group]], 1)
        trees = U.BoostedTrees.fit(x, y, None, group, (1,)).trees
        assert any((f == 1).any() for f, _, _ in trees) == used


def test_sample_is_bounded(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(U.UrlModel, "fit", classmethod(lambda cls, x, y, *a: seen.setdefault("n", len(y)) and cls(U.BoostedTrees(0.0))))
    rows = [(f"http://h.s.com/{i}", "h.s.com", "s.com", i % 2) for i in range(2000)]
    U.train(spark.createDataFrame(rows, "url string, host string, suffix string, blocked long"),
            U.suffix_counts(spark.createDataFrame([r[:1] + r[2:] for r in rows], "url string, suffix string, blocked long")), 2000, 0.5, 200)
    assert 120 < seen["n"] <= 200


def test_one_label_or_none(spark):
    df = urls_of(spark, [(1, "http://a.net/x", None, None), (2, "http://a.org/", None, None)])
    for rules in ((), (("block", "net", "/"),)):
        got = {r._row.page_id: r.verdict for r in U.filter_urls(df, rules=rules).collect()}
        assert got == {1: "block" if rules else "allow", 2: "allow"}
    assert U.filter_urls(df.limit(0)).count() == 0
