"""Search by the index against the scan of all documents."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index, research


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    rows = [(i * 3 + 1, " ".join(r.choice(words) for _ in range(r.randint(0, 12))), r.choice(["a.org", "b.org", None])) for i in range(500)]
    rows += [(10_000, None, "a.org"), (10_001, "", "b.org"), (10_002, "x y", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


@pytest.fixture(scope="module")
def at(corpus, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    index.build_index(corpus, path, block=16, buckets=8)
    return path


@pytest.mark.parametrize("query", ["w1", "w1 w2 w3 the", "the", "absent words", "", "the w5 absent", "w1 w1 W2", " ".join(f"w{i}" for i in range(12))])
@pytest.mark.parametrize("options", [{}, {"exclude": ["a."]}, {"include": ["B.org"]}])
def test_the_same_ranks_as_the_scan(spark, corpus, at, query, options):
    for limit in (1, 7, 40):
        want = [(r.doc_id, round(r.score, 9), r["rank"]) for r in research.search(corpus, query, limit, **options).orderBy("rank").collect()]
        got = index.search(spark, at, query, limit, buckets=8, **options).orderBy("rank").collect()
        assert [(r.doc_id, round(r.score, 9), r["rank"]) for r in got] == want
        if limit == 7 and options:
            break


def test_a_query_reads_its_words_partitions_alone(spark, at):
    plan = index.postings(spark, at, ["w1"], 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    files = index.postings(spark, at, ["w1"], 8).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("bucket=" in r.f for r in files) and len({r.f.split("bucket=")[1].split("/")[0] for r in files}) == 1


def test_rows_hold_a_block_at_most(spark, at):
    assert spark.read.parquet(at).select(F.max(F.size("docs"))).first()[0] <= 16
