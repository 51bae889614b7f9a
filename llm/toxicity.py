"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes.

Each n-gram's presence is scaled by its log-count ratio between toxic and other
labelled texts; a logistic regression is fitted on the scaled presences.  It is
trained on a bounded sample of the labelled rows that are not held out
(``TRAIN_PER_CLASS`` of each label at most, those below a hash that is computed
from the label's count, and whole texts of ``TRAIN_BYTES`` bytes in all of each
label, in the order of another hash).  Each sampled row weighs the labelled rows of
its label that it stands for: all of them by those in the sample, so that the model
learns their balance at any size.

Defined cases: a null or empty text has no n-grams and scores the intercept; a
null doc_id is held out (the CRC of the empty string is 0) and never trains;
labels of one doc_id that differ count as the larger, and of its texts the larger
trains; repeated rows score alike, and so do texts that differ in nothing but their
keys; extra columns are ignored, whatever their names; an empty table gives no rows;
without labels of both kinds every score is the rate of label 1 (0 without labels);
texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import map_arrow, table
from llm.kernels import U64, lower_ascii, mix, text_buffer

#: Most training texts of each label.
TRAIN_PER_CLASS = 2_500
#: Most bytes of the training texts of each label; the first one counts at any length.
TRAIN_BYTES = 32 << 20
GRAMS = (4, 5, 6)
BITS = 20
SLICE_BYTES = 1 << 20
#: Least chi-square between an n-gram and the label, texts it occurs in, log ratio, and the L2 penalty.
EVIDENCE, LEAST_TEXTS, LEAST_RATIO, PENALTY = 15.0, 8, 1.0, 3e-3


def gram_ids(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed n-gram, document) arrays, one pair per n; white space is one byte."""
    text = lower_ascii(buf).astype(U64)
    n = len(buf)
    doc_end = np.repeat(off[1:], np.diff(off))
    at = np.arange(n)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for g in GRAMS:
        if n < g:
            continue
        h = np.zeros(n - g + 1, U64)
        for j in range(g):
            h = (h << U64(8)) | text[j: n - g + 1 + j]
        ok = at[: n - g + 1] + g <= doc_end[: n - g + 1]
        yield (mix(h + U64(g * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - BITS)).astype(np.int32)[ok], doc[: n - g + 1][ok]


def presences(buf: np.ndarray, off: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) pairs, of n-grams flagged in known only if given."""
    keys = []
    for ids, doc in gram_ids(buf, off):
        if known is not None:
            m = known[ids]
            ids, doc = ids[m], doc[m]
        keys.append((doc.astype(np.int64) << BITS) | ids)
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


class NBLinear:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.known = weights != 0

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, weight: np.ndarray | None = None) -> NBLinear:
        """weight: labelled rows that each text stands for (one if not given)."""
        weight = np.ones(len(y)) if weight is None else weight / max(weight.mean() if len(y) else 1.0, 1e-9)
        rate = float(np.average(y, weights=weight)) if len(y) else 0.0
        if not 0 < rate < 1:
            return cls(np.zeros(1 << BITS), 40.0 if rate == 1 else -40.0)
        size, step = 1 << BITS, 50
        pos, neg = np.zeros(size, np.int32), np.zeros(size, np.int32)
        parts = [(i, *text_buffer(pa.array(texts[i:i + step], pa.string()))) for i in range(0, len(texts), step)]
        for i, buf, off in parts:  # counts first, so that only n-grams with evidence are kept
            d, g = presences(buf, off)
            toxic = y[d + i] == 1
            pos += np.bincount(g[toxic], minlength=size).astype(np.int32)
            neg += np.bincount(g[~toxic], minlength=size).astype(np.int32)
        # presence rates per class, smoothed; n-grams that chance explains carry no evidence
        ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
        total = pos + neg
        weighted = pos * weight[y == 1][0]  # rows of a label weigh the same
        expected = (weighted + neg * weight[y != 1][0]) * rate
        chi = (weighted - expected) ** 2 / np.maximum(expected * (1 - rate), 1e-9)
        ratio[(total < LEAST_TEXTS) | (chi < EVIDENCE) | (np.abs(ratio) < LEAST_RATIO)] = 0
        if not ratio.any():
            return cls(np.zeros(size), np.log(rate / (1 - rate)))
        found = [(d + i, g) for i, (d, g) in ((i, presences(buf, off, ratio != 0)) for i, buf, off in parts)]
        doc, gram = (np.concatenate(c) for c in zip(*found))
        x = ratio[gram]
        norm = np.sqrt(np.maximum(np.bincount(doc, x * x, len(y)), 1.0))
        used, at = np.unique(gram, return_inverse=True)  # n-grams of the sample alone take part
        w, b = np.zeros(len(used)), 0.0
        m1, m2, mb1, mb2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
        xs = x / norm[doc] * 3.0
        for t in range(1, 81):  # Adam on the full sample, L2 penalty
            z = np.bincount(doc, w[at] * xs, len(y)) + b
            e = weight * (1 / (1 + np.exp(-z)) - y)
            g = np.bincount(at, e[doc] * xs, len(used)) / len(y) + PENALTY * w
            gb = e.mean()
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.99 * m2 + 0.01 * g * g
            mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
            w -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            b -= 0.05 * (mb1 / (1 - 0.9**t)) / (np.sqrt(mb2 / (1 - 0.99**t)) + 1e-8)
        weights = np.zeros(size)
        weights[used] = w * ratio[used] * 3.0
        model = cls(weights, b)
        model.ratio2 = (ratio * ratio).astype(np.float32)
        return model

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not hasattr(self, "ratio2"):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        doc, gram = presences(buf, off, self.known)
        norm = np.sqrt(np.maximum(np.bincount(doc, self.ratio2[gram], n), 1.0))
        z = np.bincount(doc, self.weights[gram], n) / norm + self.bias
        return 1 / (1 + np.exp(-z))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, *, most_bytes: int = TRAIN_BYTES) -> list[tuple]:
    """(doc_id, label, weight, text) of the bounded sample; the labels are counted
    and sampled before the join, so its broadcast side has at most 2 * per_class rows,
    and sizes decide before texts are collected."""
    lab = (labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").alias("y")))
    count = {r.y: r.n for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        n = count.get(y, 0)
        share = min(1.0, 0.95 * per_class / max(n, 1))  # a threshold on the hash: nothing is sorted
        part = lab.filter(F.col("y") == y)
        if n > per_class:
            part = part.filter(F.xxhash64("doc_id") < F.lit(int(-2**63 + share * (2**64 - 1)))).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sizes = found.groupBy("doc_id").agg(F.max("y").alias("y"), F.max(F.octet_length("text")).alias("size")).withColumn("h", F.xxhash64("doc_id", F.lit(1))).collect()
    taken: dict = {}
    for y in (0, 1):
        total = 0
        for r in sorted((r for r in sizes if r.y == y), key=lambda r: (r.h, r.doc_id)):
            total += r.size or 0
            if total > most_bytes and y in taken.values():
                break
            taken[r.doc_id] = y
    ids = docs.sparkSession.createDataFrame([(i,) for i in taken], docs.select("doc_id").schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")).collect()
    weight = {y: count.get(y, 0) / max(sum(v == y for v in taken.values()), 1) for y in (0, 1)}
    return [(r.doc_id, taken[r.doc_id], weight[taken[r.doc_id]], r.text or "") for r in texts]


def fit(docs: DataFrame, labels: DataFrame) -> NBLinear:
    rows = sorted(training_rows(docs, labels))
    return NBLinear.fit([r[3] for r in rows], np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float))


def score_texts(docs: DataFrame, model: NBLinear, key: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            scores = np.zeros(batch.num_rows)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, side="right")) - 1)
                scores[a:b] = m.score(buf[off[a]:off[b]], off[a:b + 1] - off[a])
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return map_arrow(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
