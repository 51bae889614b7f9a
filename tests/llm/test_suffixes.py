"""Suffix deduplication: its sort, and buckets of a few entries, whose windows meet across boundaries."""

import numpy as np

from llm import suffix_dedup as S
from test_operators import removed


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for values, n in ((2, 500), (256, 300), (1, 40)):
        rows = rng.integers(0, values, (n, 24)).astype(np.uint8)
        rows = np.concatenate([rows, rows[: n // 2]])
        order = S.multikey_quicksort(S.words_of(rows))
        assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows) and sorted(order) == list(range(len(rows)))
    assert len(S.multikey_quicksort(np.zeros((0, 3), np.uint64))) == 0


def test_boundaries(spark, monkeypatch):
    """Nearly every entry is a bucket of its own: equal windows are found across boundaries only."""
    monkeypatch.setattr(S, "FRAGMENTS", 150)
    monkeypatch.setattr(S, "SAMPLE", 1)
    rng = np.random.default_rng(1)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    line, passage = noise(130), noise(420)
    docs = [(i, noise(rng.integers(0, 60)) + line + noise(rng.integers(0, 90)) + (passage[rng.integers(0, 200):] if i % 3 else "") + noise(30)) for i in range(60)]
    docs += [(100, passage), (101, passage[5:] + "x"), (102, "ab" * 300), (103, line[:99]), (104, line[:100])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r._row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(df).collect()}
    assert got == removed(docs)


def test_repeats_equal_brute_force():
    """The local step alone, split at a key: what both sides leave open is what they share."""
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (300, S.RIGHT + S.LEFT)).astype(np.uint8)
    rows[:, 20:] = rows[rng.integers(0, 12, 300), 20:]
    rows[:, :20] = rows[rng.integers(0, 3, 300), :20]
    low, high = rng.integers(0, 30, 300), rng.integers(30, 69, 300)
    first, last, at, i = S.repeats(rows, low, high, [])
    seen, want = set(), []
    for r, a, b in zip(rows, low, high):
        hits = []
        for k in range(a, b + 1):
            w = (k, bytes(r[:S.LENGTH - k]), bytes(r[S.RIGHT:S.RIGHT + k]))
            hits += [k] if w in seen else []
            seen.add(w)
        want.append((min(hits, default=S.LENGTH), max(hits, default=-1)))
    assert list(zip(first, last)) == want and not len(at)
