"""WARC round trips against brute force."""

import base64
import hashlib

import numpy as np

from llm import warc
from llm.common import written


def expected(rows, min_bytes=0):
    """(page_id, bytes, digest, type, refers_to) by a loop over the rows (keys are distinct here)."""
    best = {}
    for k, _, h, *_ in rows:
        p = (h or "").encode()
        if len(p) >= min_bytes:
            best[p] = max(best.get(p, k), k)
    out = []
    for k, _, h, *_ in rows:
        p = (h or "").encode()
        top = best.get(p, k)
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if top == k else "revisit", None if top == k else top))
    return sorted(out)


def test_table_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_RECORDS", 7)
    rng = np.random.default_rng(3)
    texts = ["", None, "é" * 9, "x" * 300_000, *("page %d" % i for i in range(12))]
    rows = [(int(i), f"http://h/{i}" if i % 5 else None if i % 2 else "", texts[rng.integers(len(texts))], "clash", int(i)) for i in rng.permutation(150)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, digest string, ordinal long").repartition(5)
    for least in (0, 10):
        archives = warc.archive_pages(df, min_bytes=least)
        dealt = warc.one_to_a_task(archives)
        sizes = dealt.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert len(sizes) == archives.count() > 5 and max(sizes) <= 2 and sum(map(bool, sizes)) > 0.7 * len(sizes)
        records = written(warc.read_archives(dealt, payloads=True), "t")
        got = sorted((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(records).collect())
        assert got == expected(rows, least)
        assert {(r.key, r.uri) for r in records.collect()} == {(k, u) for k, u, *_ in rows}
        wanted = {k: (h or "").encode() for k, _, h, *_ in rows}
        assert all(bytes(r.payload) == wanted[r.key] for r in records.collect() if r.record_type == "response")
