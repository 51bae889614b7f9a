"""The pipeline's stages against brute force, and on odd tables."""

import duckdb
import pytest

import corpus_pipeline as P
from llm import mixing, registry
from test_operators import DIR, links, removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_brute_force(spark):
    """Each stage is judged on its own input, which is the brute-force result of the one before."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]

    def stage(i, rows):
        df = spark.createDataFrame(rows, SCHEMA)
        out = P.STAGES[i][1](spark, df, DIR)
        assert out.columns == df.columns
        return sorted(tuple(r) for r in out.collect())

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({registry.SQL['op9_quality_rules']}) where kept").fetchall()}
    want = sorted(d for d in docs if d[0] in kept)
    assert stage(0, docs) == want
    group = links([d[:2] for d in want], 5, 80, 100)
    alone = [d for d in want if group[d[0]][1] == d[0]]
    assert stage(1, want) == alone and len(alone) < len(want)
    cut = removed([d[:2] for d in alone])
    left = stage(2, alone)
    assert {d[0] for d in left} == {i for i, (n, gone, *_) in cut.items() if gone < n or not gone}
    for i, text, _, _, n in left:
        total, gone = cut[i][:2]
        assert n == len(text) and 0 <= total - gone - len(text.encode()) < 4 * (cut[i][2] * 2 + 1)
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = stage(3, left)
    leaked = {d[0] for d in left if any(x and " ".join(x.lower().split()) in " ".join(d[1].lower().split()) for x in items)}
    assert leaked <= {d[0] for d in left} - {d[0] for d in clean} and len(clean) > 0.9 * (len(left) - len(leaked))
    last = spark.createDataFrame(clean, SCHEMA)
    copies = {r._row.doc_id: r._copies for r in mixing.with_copies(last, mixing.word_count(last["text"])).collect()}
    assert stage(4, clean) == sorted(d for d in clean for _ in range(copies[d[0]]))


ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "word " * 40, "en", "a", 200), (3, "word " * 40, "en", "a", 200), (None, "ab cd " * 60, "x", "b", 360),
       (4, "long text " * 60_000, "en", "a", 600_000)]


@pytest.mark.parametrize("i", range(5))
def test_stages_on_odd_tables(spark, i):
    """Nulls, repeated and very long rows, names that clash, no rows: defined results, the same columns."""
    df = spark.createDataFrame(ODD, SCHEMA).withColumnsRenamed({"lang": "n_words", "n_chars": "component_id"})
    stage = P.STAGES[i][1]
    out = stage(spark, df, DIR)
    assert out.columns == df.columns
    got = sorted((r.doc_id or -1) for r in out.collect())
    assert got == [[], [-1, 1, 2, 3, 4], [-1, 1, 2, 3, 4], [-1, 1, 2, 3, 3, 4], got][i]
    assert stage(spark, df.limit(0), DIR).count() == 0


def test_run_from_end_to_end(spark):
    """The whole pipeline on the smallest tables: what each stage promises holds for its result, and reruns agree."""
    import re
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = P.run(spark, at)
    rows = out.collect()
    assert rows and set(out.columns) >= {"doc_id", "text"}
    known = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} <= set(known)
    texts = {r.doc_id: r.text for r in rows}
    assert len(set(texts.values())) == len(texts) and all(texts.values())
    for i, t in texts.items():  # passages that occurred earlier may be gone, nothing else
        assert len(t) <= len(known[i]) and len(re.findall(r"[^\x20\x09-\x0D]+", known[i])) >= 50
    passages = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect() if r.text]
    assert not [i for i, t in texts.items() for p in passages if p in t]
    again = P.run(spark, at).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
