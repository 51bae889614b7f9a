"""What operators leave on disk: shuffle files, and the tokens of copies."""

import glob
import os
import time

import numpy as np
from pyspark.sql import functions as F

from llm import common, ngram_join
from tests.llm.test_operators import links


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(os.path.join(d, "*", "shuffle_*.data"))}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = common.written(spark.range(2000).repartition(7).groupBy(F.col("id") % 5).count(), "t")
    end = time.time() + 20  # files go in the background
    while not shuffle_files(spark) <= before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert out.count() == 5
    assert spark.conf.get(common.FREE_SHUFFLES) == "false"


def test_tokens_of_copies_are_not_kept(spark, monkeypatch):
    kept = {}
    old = ngram_join.written

    def written(df, what):
        kept[what] = out = old(df, what)
        kept[f"{what} rows"], kept[f"{what} columns"] = out.count(), out.columns
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, text if i < 50 else text + f" x{i % 2}") for i in range(60)] + [(60, "w1 w2")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs, k=3, num=90).collect()}
    assert got == {i: (298 + (i >= 50), 0) for i in range(60)} | {60: (1, 60)}
    assert "tokens" not in kept["sets columns"] and kept["nodes rows"] == 3


def test_rows_that_share_a_doc_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, "other words are here"), (2, a), (1, a), (3, b), (4, b), (None, a)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs, k=3, num=90).collect()}
    assert got == {(1, 98, 1), (1, 2, 1), (2, 98, 1), (3, 98, 3), (4, 98, 3), (None, 98, None)}


def test_groups_that_share_a_signature_are_not_all_compared(spark, monkeypatch):
    """400 texts of common blocks: signatures chain them, but few pairs share as many as a link needs."""
    rng, pairs = np.random.default_rng(3), {}
    blocks = [[f"b{b}x{i}" for i in range(40)] for b in range(60)]
    docs = [(n, " ".join(sum((blocks[b] for b in rng.choice(60, 2, replace=False)), []))) for n in range(400)]
    docs += [(1000 + n, " ".join(docs[n // 5][1].split()[:-1 - n % 5] + [f"y{n}"] * (n % 2))) for n in range(60)]
    old = ngram_join.written

    def written(df, what):
        out = old(df, what)
        pairs[what] = max(pairs.get(what, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(spark.createDataFrame(docs, "doc_id long, text string"), 1, 80, 100).collect()}
    assert got == links(docs, 1, 80, 100)
    assert pairs["open"] > 1000 and "tiles" not in pairs and pairs["pairs"] < 2000


def test_waves(spark, monkeypatch):
    """Signatures, pairs and tiles in several waves give the links of one."""
    monkeypatch.setattr(ngram_join, "waves", lambda nodes, sent: 2 if sent else 0)
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    monkeypatch.setattr(ngram_join, "TILE", 9)
    made, old = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, what: made.append(what) or old(df, what))
    rng, docs = np.random.default_rng(5), []
    for i in range(70):
        words = [f"w{j}" for j in range(100)]
        for j in rng.choice(100, 1 + i % 9, replace=False):
            words[j] = f"x{rng.integers(25)}"
        docs.append((i + 1, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(spark.createDataFrame(docs, "doc_id long, text string"), 1, 90, 100).collect()}
    assert got == links(docs, 1, 90, 100)
    assert made.count("candidates") > 1 and made.count("linked-pairs") > 1 and made.count("linked-tiles") > 1
