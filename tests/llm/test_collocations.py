"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import collocations
from llm.collocations import collocations as mine
from llm.collocations import states

LOWER = {c: c + 32 for c in range(65, 91)}


def plainly(rows, least=30, subsumed=80, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[("und" if lang is None else lang), tuple(words[i:i + k])] += 1
    out = []
    frequent = {(g, p): a for (g, p), a in counts.items() if len(p) > 1 and a >= least}
    for g in total:
        ranked = []
        for (lang, p), a in frequent.items():
            if lang != g:
                continue
            if any(h == g and len(q) > len(p) and 100 * b >= subsumed * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (h, q), b in frequent.items()):
                continue
            cuts = [(2_000_000 * a // (counts[g, p[:k]] + counts[g, p[k:]]), k, counts[g, p[:k]], counts[g, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), a, l, r, score))
        for i, x in enumerate(sorted(ranked)[:top]):
            out.append((g, i + 1, *x[3:7], total[g], x[7]))
    return sorted(map(repr, out))


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("x") for c in ("phrase", "n", "k", "words", "least")}).repartition(3)
    got = mine(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plainly(rows, **options)


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["The", "the", "of", "and", "é", "É", "x\x00y", "naïve", "日本", "a-b", "ß"]
    return [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", ", "\x0b"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und", ""])) for _ in range(n)]


def test_against_counting(spark):
    check(spark, [*texts(150), (None, "en"), ("", None), (" \t", "de"), ("...", "fr"), ("one", "it")], least=5)


def test_long_texts_ties_and_the_top(spark):
    check(spark, [("a b c d e " * 4000, "en"), ("a b c d e. " * 40, "de"), ("x y. y x. " * 35, "de")], top=3)


def test_repeated_rows_and_subsumption(spark):
    check(spark, [("new york city hall", "en")] * 40 + [("new york", "en")] * 9 + [("york city", "en")] * 11 + [("old new york city", "en")] * 12)


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("change", [("SHARD_WORDS", 7), ("PAIR_BITS", 15), ("WORD_BITS", 15)])
def test_blocks_and_crowded_bitmaps(spark, monkeypatch, change):
    monkeypatch.setattr(collocations, *change)
    rows = texts(60, 2)
    docs = spark.createDataFrame(rows, "text string, lang string")
    # the functions run in this process: workers import their own module
    if change[0] == "SHARD_WORDS":
        from llm.kernels import span_hash, text_buffer
        import pyarrow as pa
        for low, depth in ((1, 1), (2, 2), (3, 4)):
            found = Counter()
            buf, off = text_buffer(pa.array([t for t, _ in rows], pa.large_string()))
            s, e, _, joined = collocations._words(buf, off)
            _, name = collocations._named(buf, s, e, span_hash(buf, s, e))
            for a in range(0, len(s), 7):
                to = min(len(s), a + 7 + depth - 1)
                ok = [np.arange(to - a) < 7]
                for k in range(2, depth + 1):
                    more = np.zeros(to - a, bool)
                    n = max(0, to - a - (k - 1))
                    more[:n] = ok[-1][:n] & joined[a:to][k - 2:k - 2 + n]
                    ok.append(more)
                for k, place, count, least in states(name[a:to], ok, low):
                    for p, c, m in zip(place, count, least):
                        for size in range(m, k + 1):
                            found[tuple(name[a + p + k - size:a + p + k])] += int(c)
            want = Counter()
            for i in range(len(s)):
                for k in range(low, depth + 1):
                    if i + k <= len(s) and all(joined[i:i + k - 1]):
                        want[tuple(name[i:i + k])] += 1
            assert found == want
    else:
        assert sorted(repr(tuple(r)) for r in mine(docs, least=5).collect()) == plainly(rows, least=5)


def test_states_are_classes_of_end_positions():
    r = np.random.default_rng(4)
    name = r.integers(0, 4, 400)
    ok = [np.arange(400) <= 400 - k for k in range(1, 5)]
    seen = {}
    for k, place, count, least in states(name, ok, 1):
        for p, c, m in zip(place, count, least):
            for size in range(m, k + 1):
                x = tuple(name[p + k - size:p + k])
                assert x not in seen
                seen[x] = int(c)
    assert seen == Counter(tuple(name[i:i + k]) for k in range(1, 5) for i in range(400 - k + 1))


def test_words_with_one_hash_stay_apart():
    buf = np.frombuffer(b"a b c a b", np.uint8)
    s = np.array([0, 2, 4, 6, 8])
    first, name = collocations._named(buf, s, s + 1, np.zeros(5, np.uint64))
    assert name.tolist() == [0, 1, 2, 0, 1] and first.tolist() == [0, 1, 2]


def test_sums_beyond_64_bits(spark):
    big = 9 * 10**18
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long")
    score = row.select(F.expr(f"cast({collocations.SCALE} * cast(a as decimal(28,0)) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0))) as long)")).first()[0]
    assert score == 1_000_000
