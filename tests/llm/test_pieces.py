"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import pieces
from llm.kernels import text_buffer

SP = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
ODD = ["", "a", " ", "  ", " a", "a ", " x     y ", "\n\n\tfoo", "▁▁a ▁b ▁", "the the the", "日本語 のテキスト", "𝒳 \U0001F600", "é é", "\x00\x01", "<s></s><unk><0x41>",
       " " * 3000, "a" * 5000, "ab" * 3000 + " the " * 100, "aiouan leeauxque " * 2000, "  ﻿", "ﬁ ² Ａ"]


def check(texts):
    v = pieces.vocabulary(pieces.default_path())
    ids, off = v.encode(*text_buffer(pa.array(texts, pa.string())))
    want = SP.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    assert [t.decode() for t in v.decode(ids.astype(np.int64), off)] == [SP.decode(w) for w in want]


def test_odd_texts():
    check(ODD)
    check([None, *ODD[::-1], None])
    check([])


@pytest.mark.parametrize("alphabet", ["abt he▁", "abcdefghijklmnopqrstuvwxyz     \n\téüß漢字かな▁𝒳AB01.,", "0123456789abcdef", "▁ "])
def test_random_texts(alphabet):
    r = random.Random(alphabet)
    check(["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)])


def test_words_whose_merges_have_an_order():
    r = random.Random(5)
    parts = [p.replace("▁", " ") for p in (SP.id_to_piece(i) for i in range(300, 1500))]
    check(["".join(r.choice(parts) for _ in range(r.randint(0, 8))) * r.randint(1, 3) for _ in range(8000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    check(texts)


def test_long_words_merge_from_a_heap(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("etaoinshr") for _ in range(3000)), "na" * 2000, "x" * 2500, "ing" * 900]
    check(texts)
    monkeypatch.setattr(pieces, "LONG", 3)
    check(texts + ODD)


def test_slices_are_spliced(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 40)
    check(ODD)


def test_equal_digests_of_different_words(monkeypatch):
    monkeypatch.setattr(pieces, "mix", lambda x: x * pieces.U64(0))
    check(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=30))
def test_any_ids_decode_as_the_library_has_it(ids):
    v = pieces.vocabulary(pieces.default_path())
    got = v.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()
    assert got == SP.decode(ids)


def test_ids_outside_the_vocabulary():
    with pytest.raises(ValueError):
        pieces.vocabulary(pieces.default_path()).decode(np.array([32000]), np.array([0, 1]))


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, None), (3, None), (3, "  "), (3, "  ")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("x")})
    made = pieces.decode(pieces.encode(docs)).collect()
    want = sorted((repr(i), ids := [1, *SP.encode(t or ""), 2], SP.decode(ids)) for i, t in rows)
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in made) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in made)
    bare = pieces.encode(docs, ends=False).collect()
    assert sorted(r.n_tokens for r in bare) == sorted(len(x[1]) - 2 for x in want)
    assert pieces.decode(pieces.encode(docs.limit(0))).collect() == []
    no_ids = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert pieces.decode(no_ids).first().text == ""


def test_query(spark):
    at = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in pieces.op11_sentencepiece(spark, at).collect()}
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = [1, *SP.encode(d.text or ""), 2]
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
