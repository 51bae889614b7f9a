"""Decontamination against brute force, many items of one template, odd rows."""

import time

import numpy as np

from llm import decontaminate as D


def best_distance(item, text):
    """Edit distance of the whole item to its best region of text."""
    row = np.zeros(len(text) + 1, int)
    for i, a in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, b in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b))
        row = new
    return row.min()


def test_equal_to_brute_force():
    rng = np.random.default_rng(4)
    word = ["".join(rng.choice(list("abcdef"), rng.integers(2, 7))) for _ in range(60)]
    items = [" ".join(rng.choice(word, n)) for n in (12, 15, 20, 25, 12)]
    texts = []
    for t in range(40):
        base = list(items[t % 5])
        for _ in range(rng.integers(0, D.budget(len(base)) + 4)):
            p = rng.integers(len(base))
            base[p:p + 1] = [[], ["z"], [base[p], "y"]][rng.integers(3)]
        texts.append(" ".join(rng.choice(word, 8)) + " " + "".join(base) + " " + " ".join(rng.choice(word, 8)))
    index = D.Index(list(range(5)), [D.normalise(D.codes(x))[0] for x in items])
    got = {(r, i): d for r, i, _, _, d in index.scan(texts)}
    for r, t in enumerate(texts):
        for i, x in enumerate(items):
            want = best_distance(x, t)
            assert got.get((r, i)) == (want if want <= D.budget(len(x)) else None), (r, i)


def test_chunks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(5)
    items = ["".join(rng.choice(list("abcd "), 90)) for _ in range(20)]
    text = "x".join(items) + "yy" + items[3] + items[4][:60]
    index = D.Index(list(range(20)), [D.normalise(D.codes(x.strip()))[0] for x in items])
    whole = list(index.scan([text, text[500:]]))
    monkeypatch.setattr(D, "EXPAND", 7)
    monkeypatch.setattr(D, "ALIGN", 3)
    assert list(index.scan([text, text[500:]])) == whole and len(whole) >= 20


def test_template_of_thousands_of_items():
    template = "Which of the following statements about the subject below is right: "
    items = [template + f"{i * 7919 % 100003:06d} {i:05d}" for i in range(3000)]
    index = D.Index(list(range(3000)), [D.normalise(D.codes(x))[0] for x in items])
    began = time.time()
    found = list(index.scan([(template + "nothing of the kind. ") * 14 + items[77]]))
    assert time.time() - began < 20 and (0, 77, 0) in [(r, i, d) for r, i, _, _, d in found]


def test_rows(spark):
    item = "The quick brown fox jumps over the lazy dog and then some more words follow here."
    docs = spark.createDataFrame([(1, item, "a"), (1, item, "a"), (None, item, None), (2, None, "b"), (3, "w " * 300_000 + item, "c")], "doc_id int, text string, item_id string")
    bench = spark.createDataFrame([(None, item, 1), (7, item, 2), (7, item, 2)], "item_id long, text string, doc_id long")
    got = sorted(((r.doc_id or -1, r.item_id or -1, r.distance) for r in D.find_matches(docs, bench).collect()))
    assert got == sorted((d, i, 0) for d in (1, 1, -1, 3) for i in (-1, 7, 7))
    left = D.clean(docs, bench)
    assert [tuple(r) for r in left.collect()] == [(2, None, "b")] and left.columns == docs.columns
