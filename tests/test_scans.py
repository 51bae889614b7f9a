"""Scans in chunks of a key against plain loops and windows."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import monitor, ops, scans


def rows_of(seed, n=400):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(r.choice(keys), i, r.choice([None, 1, 2, 3]), r.random() < 0.6) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("hot", [0, 7, 10**6])
def test_running_previous_and_tail(spark, hot):
    rows = rows_of(hot)
    df = spark.createDataFrame(rows, "k string, o long, v long, s boolean")
    scan = scans.Ordered(df, "k", "o", hot).running(n=F.lit(1), x=F.coalesce(F.col("v"), F.lit(0))).previous("p", "v", "o").tail("t", "v", 4)
    assert scan.chunks == (hot < 400)
    groups = defaultdict(list)
    for x in sorted(rows, key=lambda x: x[1]):
        groups[x[0]].append(x)
    got = {(x.k, x.o): x for x in scan.done().collect()}
    assert len(got) == len(rows)
    for k, part in groups.items():
        for i, (_, o, v, _) in enumerate(part):
            x = got[k, o]
            assert (x.n, x.n_total) == (i + 1, len(part))
            assert (x.x, x.x_total) == (sum(y[2] or 0 for y in part[:i + 1]), sum(y[2] or 0 for y in part))
            assert (tuple(x.p) if x.p else None) == ((part[i - 1][2], part[i - 1][1]) if i else None)
            assert x.t == [y[2] for y in part[max(0, i - 3):i + 1] if y[2] is not None]


def test_a_hot_key_lies_in_many_chunks(spark):
    scan = scans.Ordered(spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("o")), "k", "o", 500)
    sizes = [x["count"] for x in scan.rows.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500


@pytest.mark.parametrize("hot", [0, 10**6])
def test_operators_by_chunks_are_those_by_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(scans, "HOT", hot)
    events = [(x[0], x[1], "success_retry" if x[3] else "error", x[2] == 1, x[3], float(x[1] % 97)) for x in rows_of(3)]
    df = spark.createDataFrame(events, "host string, ord long, outcome string, shell boolean, success boolean, latency_ms double")
    policy = {x.host: x for x in ops.host_policy(df).collect()}
    health = {x.host: x for x in ops.proxy_health(df, "host").collect()}
    mean = {x.host: x.state for x in ops.ewma(df, "host", "ord", F.col("latency_ms")).collect()}
    for host in {x[0] for x in events}:
        mine = sorted((x for x in events if x[0] == host), key=lambda x: x[1])
        rate = state = latency = 0.0
        good, was, back, ok = True, True, 0, 0
        for n, x in enumerate(mine, 1):
            rate = (rate * (n - 1) + 1) / n if x[3] else rate
            state = x[5] if n == 1 else 0.9 * state + 0.1 * x[5]
            latency = 0.9 * latency + 0.1 * x[5] if x[4] else latency
            ok += x[4]
            good = n <= 10 or ok / n >= 0.3
            back, was = back + (good and not was), good
        assert policy[host].shell_rate == pytest.approx(rate) and policy[host].attempts == len(mine)
        assert mean[host] == pytest.approx(state)
        assert (health[host].latency, health[host].recovered, health[host].healthy) == (pytest.approx(latency), back, good)
    diff = {(x.host, x.ord): x.changed for x in monitor.changes(df, "host", "ord", ["outcome", "shell"]).collect()}
    last = {}
    for x in sorted(events, key=lambda x: x[1]):
        before = last.get(x[0])
        want = ["initial_snapshot"] if before is None else [f for f, a, b in (("outcome", before[2], x[2]), ("shell", before[3], x[3])) if a != b]
        assert diff[x[0], x[1]] == want
        last[x[0]] = x
    assert {len(x.history) for x in monitor.history(df, "host", "ord", "outcome", 10).collect()} == set(range(1, 11))


def test_ranks_of_a_whole_table(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.lit("y").alias("rank_of"))
    got = scans.ranked(df, [-F.col("x")]).collect()
    assert {r.x: r["rank"] for r in got} == {x: 1000 - x for x in range(1000)}
    assert scans.ranked(df.limit(0), [F.col("x")]).collect() == []


def test_picking_proxies_of_a_pool(spark):
    requests = spark.range(20).select(F.col("id").alias("ord"))
    pool = spark.createDataFrame([("p2", 2, 5, True), ("p1", 1, 9, True), ("p3", 0, 0, False), ("p4", 9, 5, True)], "proxy string, ord long, successes long, healthy boolean")
    got = {r.ord: r.proxy for r in ops.pick_proxies(requests, pool).collect()}
    assert got == {i: ["p1", "p2", "p4"][i % 3] for i in range(20)}
    assert {r.proxy for r in ops.pick_proxies(requests, pool, "least-used").collect()} == {"p2"}
    assert {r.proxy for r in ops.pick_proxies(requests, pool.filter("not healthy")).collect()} == {None}
    assert {r.proxy for r in ops.pick_proxies(requests, pool.filter("not healthy"), "least-used").collect()} == {None}
    assert len({r.proxy for r in ops.pick_proxies(requests, pool, "random").collect()}) == 3


@pytest.mark.parametrize("hot", [0, 9, 10**6])
def test_as_of_joins(spark, hot):
    r = random.Random(hot + 5)
    left = [(r.choice(["h", "h", "h", "a", "z", None]), r.choice([None, *range(60)]), i) for i in range(200)]
    right = [(r.choice(["h", "h", "a", "b", None]), r.choice([None, *range(60)]), i) for i in range(120)]
    got = scans.as_of(spark.createDataFrame(left, "k string, at int, n long"), spark.createDataFrame(right, "k string, at int, m long"), "k", "at", "m", hot=hot).collect()
    assert len(got) == len(left)
    for x in got:
        fit = [(at, m) for k, at, m in right if k is not None and k == x.k and at is not None and x.at is not None and at <= x.at]
        assert (x.found and (x.found.at, x.found.m)) == (max(fit) if fit else None)


def test_starts_of_a_busy_host_take_linear_time(spark):
    """100,000 requests of one host and some of others, null ones included, against a plain loop."""
    r = random.Random(5)
    requests = [("hot", i, i * r.choice((1, 1000)), r.choice((None, 0, 700, 2500))) for i in range(100_000)]
    requests += [(k, 200_000 + i, r.choice((None, r.randrange(9000))), r.choice((None, r.randrange(5000)))) for k in (None, "a", "b") for i in range(40)]
    df = spark.createDataFrame(requests, "host string, ord long, ms long, took long")
    began = time.time()
    got = {x.ord: (x.host, x.start_ms) for x in ops.limited_starts(df.repartition(3)).collect()}
    assert time.time() - began < 60
    want, by = {}, defaultdict(list)
    for k, i, at, took in requests:
        by[k].append((at is not None, at, i, took))
    for k, rows in by.items():
        last, ends = None, []
        for _, at, i, took in sorted(rows, key=lambda x: (x[0], x[1] or 0, x[2])):
            full = len(ends) == 3
            known = [e for e in ends if e is not None]
            last = max([x for x in (at, last + 1000 if last is not None else None, min(known) if full and known else None) if x is not None], default=None)
            if full:
                ends.remove(min(known) if known else None)
            ends.append(None if last is None or took is None else last + took)
            want[i] = (k, last)
    assert got == want
