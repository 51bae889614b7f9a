"""Token counts and toxicity scores over whole frames: odd rows, and the library's own counts."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

from llm import token_counts, toxicity

SP = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())
TEXTS = [None, "", " \t\n", "plain words", "plain words", "é ü 日本 𝒳 <s> ﬁ", "word " * 40_000, "x" * 120_000, "a b c　d " * 9_000]


@pytest.mark.parametrize("kind", ["int", "long"])
def test_token_counts(spark, kind):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (3, "plain words")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit(1), "over_limit": F.lit(None)})
    got = sorted(map(repr, (tuple(r) for r in token_counts.count_tokens(docs).collect())))
    want = [(i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 4096) for i, t in rows]
    assert got == sorted(map(repr, want))
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def labelled(spark, n=400, long=1):
    rows = [(i, ("vile awful slur " if i % 4 == 0 else "kind gentle word ") * (3 + i % 5) * long + f"number {i}", int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_scores_of_odd_rows(spark):
    model = toxicity.fit(*labelled(spark))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "vile awful slur"), (50, "vile awful slur"), (51, "vile awful slur " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(1), "label": F.lit(None)})
    got = {(r.doc_id, i): r.score for i, r in enumerate(toxicity.score_texts(docs, model).collect())}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    by = {}
    for (doc_id, _), s in got.items():
        by.setdefault(doc_id, []).append(s)
    assert by[0] == by[1] and by[3] == by[4] and by[None] == by[50] and by[50][0] > 0.5 > by[3][0] and by[51][0] > 0.5
    assert toxicity.score_texts(docs.limit(0), model).collect() == []


def test_rows_weigh_what_they_stand_for(spark):
    docs, labels = labelled(spark)
    rows = toxicity.training_rows(docs, labels, per_class=60)
    for y in (0, 1):
        mine = [r for r in rows if r[1] == y]
        total = labels.filter((F.col("toxic") == y) & ~toxicity.held_out(F.col("doc_id"))).count()
        assert 0 < len(mine) <= max(60, total if total <= 60 else 60) and sum(r[2] for r in mine) == pytest.approx(total)


def test_bytes_of_the_sample_are_bounded_by_whole_texts(spark):
    docs, labels = labelled(spark, long=20)
    whole = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.training_rows(docs, labels, most_bytes=20_000)
    for y in (0, 1):
        mine = [r for r in rows if r[1] == y]
        assert mine and sum(len(r[3]) for r in mine) <= 20_000 and all(whole[r[0]] == r[3] for r in mine)
    assert {r[1] for r in toxicity.training_rows(docs, labels, most_bytes=1)} == {0, 1}


def test_repeated_ids_and_labels_without_documents(spark):
    docs, labels = labelled(spark)
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "vile"), (1, None)], "doc_id long, text string"))
    more = labels.unionByName(spark.createDataFrame([(10**6, 1), (None, 1), (2, None), (3, 1)], "doc_id long, toxic int"))
    rows = toxicity.training_rows(twice, more)
    assert len({r[0] for r in rows}) == len(rows) and {r[0]: r[1] for r in rows}.get(3, 1) == 1


def test_without_labels_of_both_kinds(spark):
    docs, labels = labelled(spark)
    none = toxicity.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score_texts(docs, none).collect()} == {0.0}
    ones = toxicity.fit(docs, labels.withColumn("toxic", F.lit(1)))
    assert {round(r.score, 6) for r in toxicity.score_texts(docs, ones).collect()} == {1.0}
