"""Near duplicates by stars: crowds of copies, and the greedy choice one document at a time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus


def one_by_one(spark, rows):
    """{id: kept} by comparing each document with all that were kept before."""
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    head = F.substring("text", 1, 600)
    facts = df.select("doc_id", "source", F.array_distinct(T.tokens(head)).alias("s"), corpus.signature(F.col("source"), F.lit(""), F.col("text")).alias("g"), T.is_thin(F.col("text")).alias("thin")).collect()
    kept, out = [], {}
    for r in sorted(facts, key=lambda r: r.doc_id):
        s = set(r.s)
        alike = any(k.g == r.g or k.source == r.source and s and k.s and len(s & set(k.s)) / len(s | set(k.s)) >= corpus.SIMILAR for k in kept)
        out[r.doc_id] = not r.thin and not alike
        kept += [r] if out[r.doc_id] else []
    return out


def family(r, n, words, changed, start):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(words), r.randint(0, changed)):
            w[k] = f"x{r.randrange(50)}"
        out.append((start + i, r.choice(["s", "s", "t"]), " ".join(w)))
    return out


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_against_one_by_one(spark, monkeypatch, crowd):
    monkeypatch.setattr(corpus, "CROWD", crowd)
    r = random.Random(crowd)
    rows = [(-1, "s", None), (-2, "s", ""), (-3, None, "one two three four five six"), (-4, None, "one two three four five six"), (-5, "s", "short")]
    for f in range(6):
        rows += family(r, 25, r.choice([12, 40]), r.choice([1, 3, 6]), 100 * f)
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"id": F.lit(1), "g": F.lit("x"), "kept": F.lit("y"), "n": F.lit(2)})
    want = one_by_one(spark, [x for x in rows if x[1] is not None])
    got = {x.id: x.kept for x in corpus.greedy_dedup(docs).collect()}
    assert {k: v for k, v in got.items() if k not in (-3, -4)} == want
    stars = {x.id: x.representative for x in corpus.star_links(docs).collect()}
    assert len(stars) == len(rows)
    for i, by in stars.items():
        assert (by == i) == got[i] and (by is None or got[by] and by <= i)


def test_a_crowd_of_near_copies(spark):
    """20,000 documents that differ in one word: pairs would be 200 million rows."""
    base = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(" "), base).alias("text"))
    began = time.time()
    got = corpus.star_links(docs).groupBy("representative").count().collect()
    assert [(r.representative, r["count"]) for r in got] == [(0, 20_000)]
    assert time.time() - began < 120


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert corpus.greedy_dedup(docs).collect() == [] and corpus.star_links(docs).collect() == []


def test_deduplication_frees_its_disk(spark):
    """Shuffle files go with the table they made, and of the tables only those that the result reads stay."""
    import glob
    import os

    from corpusloom.sources import tables

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in dirs for f in glob.glob(os.path.join(d, "*", "shuffle_*.data"))}
    made, before = lambda: set(glob.glob(f"{tables.shared_dir(spark).removeprefix('file:')}/*")), shuffles()
    left_bytes = lambda: sum(os.path.getsize(f) for f in shuffles() - before if os.path.exists(f))
    old = made()
    rows = [(i, "s", " ".join(f"w{j}" for j in range(60)) + f" x{i}") for i in range(200)] + [(500 + i, None, " ".join(f"w{j}" for j in range(60))) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    judged = corpus.greedy_dedup(df)
    end = time.time() + 20
    while left_bytes() >= 20_000 and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert left_bytes() < 20_000
    kept = made() - old
    got = {r.id: r.kept for r in judged.collect()}
    assert got[0] and not any(got[i] for i in range(1, 200)) and got[500] and not got[501]
    assert all("stored-" in x for x in kept), kept


def test_candidates_are_compared_in_waves(spark, monkeypatch):
    """Tokens are sent for about as many candidates at once as there are documents."""
    monkeypatch.setattr(corpus, "WAVE_PAIRS", 1)
    sent, real = [], corpus.verified
    monkeypatch.setattr(corpus, "verified", lambda pairs, *a: sent.append(pairs.count()) or real(pairs, *a))
    r, rows = random.Random(7), []
    for f in range(3):
        rows += family(r, 20, 30, 3, 100 * f)
    got = {x.id: x.kept for x in corpus.greedy_dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == one_by_one(spark, rows)
    assert len(sent) > 1 and max(sent) < sum(sent) and max(sent) <= 3 * len(rows)
