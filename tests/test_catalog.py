"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corpusloom.operators import corpus, ops
from corpusloom.plans import catalog, sites  # noqa: F401 - sites adds its queries

DIR = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


def test_greedy_dedup_is_not_transitive(spark):
    words = [f"w{i:02d}" for i in range(60)]
    a = " ".join(words)
    b = " ".join(words[3:] + ["x1", "x2", "x3"])
    c = " ".join(words[6:] + ["x1", "x2", "x3", "y1", "y2", "y3"])
    df = spark.createDataFrame([(1, "s", a), (2, "s", b), (3, "s", c), (4, "t", a), (5, "s", a), (6, "s", "short")], "doc_id long, source string, text string")
    got = {r.id: r.kept for r in corpus.greedy_dedup(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_token_bucket(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 0, 0, 0, 0, 0, 500)], "k string, ms long")
    assert [tuple(r) for r in ops.token_bucket(df, "k", "ms").collect()] == [("a", 6, 1, 0)]
    rows = [("a", 0, "request"), ("a", 100, "backoff"), ("a", 20_000, "request"), ("a", 31_000, "request")]
    df = spark.createDataFrame(rows, "k string, ms long, kind string")
    assert [tuple(r) for r in ops.token_bucket(df, "k", "ms", kind="kind").collect()] == [("a", 2, 0, 1)]


def test_stream_windows_equal_batch(spark, tmp_path):
    from corpusloom.streaming.windows import event_time, windowed_counts
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = (windowed_counts(stream, "1 hour", late="40 days").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("win").collect()}
    assert got == {(r.start, r.event_type): r.n for r in windowed_counts(event_time(events), "1 hour").collect()}
