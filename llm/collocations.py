"""Phrase collocations: bounded-depth suffix automata per shard, counts reduced globally.

A shard's generalised suffix automaton of bounded depth is built by naming: each
phrase of k words is named by its first k - 1 words and its last one, so a sort per
length gives all distinct phrases with their endpos counts.  The suffix link of a
phrase drops its first word; where a phrase and its link have equal counts they end at
the same places and are one state.  A shard sends one row per state - its longest
phrase, the least length and the count - and Spark spells the suffixes that it stands
for and sums them per (lang, phrase).

Three passes read the texts: words, pairs of frequent words, and the longer phrases all
of whose pairs are frequent.  A phrase has at most the count of its parts, so nothing
that can reach the least count is left out.  Frequent words and pairs are handed to the
next pass as bitmaps of hashes, of fixed size whatever the input; where two share a bit,
a few more phrases are counted for nothing.

A candidate is subsumed by a longer one that holds it.  The count of a phrase does not
rise as it grows, so the phrases one word longer decide: each sends its count along its
suffix link, and to its prefix.

Defined cases: a null text is empty; a null lang is ``und``, also beside such a lang;
repeated rows count each; other columns are ignored, whatever their names; an empty
table gives no rows; ties go by the phrase's bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import map_arrow, table, written
from llm.kernels import U64, lower_ascii, mix, span_hash, text_buffer

LEAST, DEPTH, SUBSUMED, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Bytes of texts and words of a shard; bits of the bitmaps of words and of pairs.
SHARD_BYTES, SHARD_WORDS = 4 << 20, 1 << 21
#: Words and phrases whose bytes are looked at together.
CHUNK = 1 << 16
WORD_BITS, PAIR_BITS = 24, 26
#: Shares that a lang's phrases are ranked in first.
SHARES = 16
BUCKET = 32768  # bits of one of Spark's bitmaps

_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def _join(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mix(h * U64(0x9E3779B97F4A7C15) + nxt)


class Bitmap:
    """Hashes that may be in a set of fixed size; none that is in it is missed."""

    def __init__(self, bits: int, rows: list):
        self.bits = bits
        data = np.zeros((1 << bits) // 8, np.uint8)
        for bucket, part in rows:
            data[(bucket - 1) * BUCKET // 8:][:BUCKET // 8] = np.frombuffer(part, np.uint8)
        self.packed = zlib.compress(data.tobytes(), 1)

    def opened(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed), np.uint8)

    @staticmethod
    def slots(h: np.ndarray, bits: int) -> np.ndarray:
        return (h >> U64(64 - bits)).astype(np.int64)

    def holds(self, data: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = self.slots(h, self.bits)
        return (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of words, a chunk of bytes at a time."""
    out = np.zeros(len(s), U64)
    for a in range(0, len(s), CHUNK):
        b = min(len(s), a + CHUNK)
        base = s[a]
        out[a:b] = span_hash(buf[base:e[b - 1]], s[a:b] - base, e[a:b] - base)
    return out


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word, and whether the next one is in the same piece."""
    brk = _BREAK[buf]
    inside = ~(brk | _SPACE[buf])
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]]))
    end = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:-1], [True]])) + 1
    text = np.searchsorted(off, start, side="right") - 1
    piece = np.cumsum(brk, dtype=np.int32)[start]
    joined = np.zeros(len(start), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return start, end, text, joined


def _named(buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word like it, name) of words with hashes h; equal bytes and
    no others have equal names.  The hashes of words of different langs differ."""
    _, first, name = np.unique(h, return_index=True, return_inverse=True)
    length = e - s
    same = length[first][name] == length
    alike = same.all()
    for a in range(0, len(s) if alike else 0, CHUNK):
        n, start = length[a:a + CHUNK], s[a:a + CHUNK]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - n), n)
        alike = alike and np.array_equal(buf[at], buf[at + np.repeat(s[first][name[a:a + CHUNK]] - start, n)])
    if not alike:  # one hash for different words
        names: dict[tuple, int] = {}
        name = np.array([names.setdefault((int(k), buf[a:b].tobytes()), len(names)) for k, a, b in zip(h, s, e)])
        first = np.unique(name, return_index=True)[1]
    return first, name


def _spelled(buf: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, k: np.ndarray) -> pa.Array:
    """The k[i] words from word at[i], joined by spaces."""
    start = np.cumsum(k) - k
    word = np.arange(k.sum()) + np.repeat(at - start, k)
    size = e[word] - s[word] + 1
    ends = np.cumsum(size)
    out = buf[np.minimum(np.arange(ends[-1]) + np.repeat(s[word] - (ends - size), size), len(buf) - 1)]
    out[ends - 1] = 0x20
    keep = np.ones(len(out), bool)
    last = ends[start + k - 1]
    keep[last - 1] = False
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], last - np.arange(1, len(at) + 1)]).astype(np.int64)), pa.py_buffer(out[keep])])


def states(name: np.ndarray, ok: list[np.ndarray], low: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, first place, count, least length) of the states of an automaton over
    words ``name``: phrases of ``low`` to ``len(ok)`` words; ok[k - 1] tells where one of
    k words may begin."""
    depth, width = len(ok), int(name.max()) + 1 if len(name) else 1
    of, below, out = name.astype(np.int64), None, []
    for k in range(1, depth + 1):
        at = np.flatnonzero(ok[max(k, low) - 1])
        if k == 1 and low > 1:
            continue
        _, first, inverse, count = np.unique(of[at] if k == 1 else of[at] * width + name[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
        place, least = at[first], np.full(len(first), k, np.int64)
        if below is not None:
            link = of[place + 1]  # absent where the suffix belongs to the next block
            one = np.flatnonzero((link >= 0) & (below[1][link] == count))
            least[one] = below[2][link[one]]
            longest = np.ones(len(below[0]), bool)
            longest[link[one]] = False
            out.append((k - 1, *(x[longest] for x in below)))
        of = np.full(len(name), -1, np.int64)
        of[at] = inverse
        below = (place, count, least) if k >= low else None
    return [*out, (depth, *below)]


SHARDED = "lang string, phrase string, least int, words int, n long"


def _shards(docs: DataFrame, low: int, depth: int, words: Bitmap | None = None, pairs: Bitmap | None = None) -> DataFrame:
    """The states of the automata of docs (text, lang); with low 1 also one row per
    lang with an empty phrase and the number of words."""
    spark = docs.sparkSession
    maps = spark.sparkContext.broadcast((words, pairs))

    def block(buf, s, e, code, joined, langs, frequent, paired, fresh) -> Iterator[pa.RecordBatch]:
        """Phrases that begin at the first ``fresh`` words."""
        base = int(s[0])
        part = buf[base:e[-1]]
        s, e = s - base, e - base
        bare = _hashes(part, s, e)
        h = _join(langs[1][code], bare)
        first, name = _named(part, s, e, h)
        good = joined.copy()  # the next word goes on with it
        if frequent is not None:
            often = words.holds(frequent, h[first])[name]
            good[:-1] &= often[:-1] & often[1:]
            good[-1] = False
        if paired is not None:
            at = np.flatnonzero(good[:-1])
            good[at] &= pairs.holds(paired, _join(h[at], bare[at + 1]))
        ok = [np.arange(len(s)) < fresh]
        for k in range(2, depth + 1):
            more = np.zeros(len(s), bool)
            n = max(0, len(s) - (k - 1))
            more[:n] = ok[-1][:n] & good[k - 2:k - 2 + n]
            ok.append(more)
        for k, place, count, least in states(name, ok, low):
            for a in range(0, len(place), CHUNK):
                at, c = place[a:a + CHUNK], count[a:a + CHUNK]
                yield pa.RecordBatch.from_arrays(
                    [langs[0].take(pa.array(code[at])), _spelled(part, s, e, at, np.full(len(at), k)).cast(pa.string()), pa.array(least[a:a + CHUNK], pa.int32()),
                     pa.array(np.full(len(at), k), pa.int32()), pa.array(c, pa.int64())], names=["lang", "phrase", "least", "words", "n"])

    def shard(texts: list, langs: list, opened: tuple) -> Iterator[pa.RecordBatch]:
        buf, off = text_buffer(pa.chunked_array(texts).cast(pa.large_string()))
        coded = pa.chunked_array(langs).combine_chunks().fill_null("und").dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang_buf, lang_off = text_buffer(names)
        hashes = span_hash(lang_buf, lang_off[:-1], lang_off[1:]) if len(lang_buf) else mix(lang_off[:-1].astype(U64))
        buf = lower_ascii(buf)
        s, e, text, joined = _words(buf, off)
        code = code[text]
        if low == 1 and len(s):
            n = np.bincount(code, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array([""] * len(names)), pa.array(np.zeros(len(names)), pa.int32()), pa.array(np.zeros(len(names)), pa.int32()),
                                              pa.array(n, pa.int64())], names=["lang", "phrase", "least", "words", "n"])
        for a in range(0, len(s), SHARD_WORDS):
            b = min(len(s), a + SHARD_WORDS)
            to = min(len(s), b + depth - 1)
            yield from block(buf, s[a:to], e[a:to], code[a:to], joined[a:to], (names.cast(pa.string()), hashes), *opened, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = tuple(m.opened() if m else None for m in maps.value)
        texts, langs, size = [], [], 0
        for batch in batches:
            texts.append(batch.column(0))
            langs.append(batch.column(1))
            size += batch.column(0).nbytes
            if size >= SHARD_BYTES:
                yield from shard(texts, langs, opened)
                texts, langs, size = [], [], 0
        if texts:
            yield from shard(texts, langs, opened)

    return map_arrow(docs.select(docs["text"], docs["lang"]), run, SHARDED)


def _cut(n: Column) -> Column:
    """The first n words of the phrase, or the last -n."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)


def _summed(found: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases that reach the least count, and the totals."""
    spelled = found.select("lang", "words", "n", "phrase", F.explode(F.sequence("least", "words")).alias("k"))
    phrase = F.when(F.col("k") == F.col("words"), F.col("phrase")).otherwise(_cut(-F.col("k")))
    return spelled.select("lang", phrase.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == ""))


def _bitmap(counts: DataFrame, words: int, bits: int) -> Bitmap:
    """The hashes of phrases of that many words; at most 2**bits bits come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (lang, lang_off), (buf, off) = text_buffer(batch.column(0)), text_buffer(batch.column(1))
            h = span_hash(lang, lang_off[:-1], lang_off[1:]) if len(lang) else mix(lang_off[:-1].astype(U64))
            first, last, _, _ = _words(buf, off)
            each = _hashes(buf, first, last).reshape(-1, words) if len(buf) else np.zeros((0, words), U64)
            for i in range(words):
                h = _join(h, each[:, i])
            yield pa.RecordBatch.from_arrays([pa.array(Bitmap.slots(h, bits) + 1)], names=["slot"])

    slots = map_arrow(counts.filter("phrase <> ''").select("lang", "phrase"), run, "slot long")
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    return Bitmap(bits, [(r.bucket, bytes(r.bits)) for r in rows.collect()])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of 2 to 4
    words of each lang that occur ``least`` times or more."""
    docs = docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    ones = written(_summed(_shards(docs, 1, 1), least), "words")
    frequent = _bitmap(ones, 1, WORD_BITS)
    twos = written(_summed(_shards(docs, 2, 2, frequent), least), "pairs")
    more = written(_summed(_shards(docs, 3, DEPTH, frequent, _bitmap(twos, 2, PAIR_BITS)), least), "phrases")
    counts = ones.filter("phrase <> ''").unionByName(twos).unionByName(more).withColumn("k", F.size(F.split("phrase", " ")))

    candidates = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    parts = candidates.filter("k >= 3").select("lang", "a", F.explode(F.array(_cut(1 - F.col("k")), _cut(F.col("k") - 1))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = [F.col(c).cast("decimal(28,0)") for c in ("longer", "a")]
    inside = F.coalesce(wide[0] * 100 >= wide[1] * subsumed, F.lit(False))
    stay = candidates.join(longer, ["lang", "phrase"], "left").filter(~inside).drop("longer")

    # The parts of a frequent phrase are frequent, so the inner joins lose none.
    cut = stay.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumns({"first": _cut(F.col("cut")), "rest": _cut(F.col("cut") - F.col("k"))})
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} * cast(a as decimal(28,0)) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0))) as long)")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first ones of each share of a lang's phrases, then those of the lang: no task ranks what every other one found
    best = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "share")
    place = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    total = ones.filter("phrase = ''").select("lang", "n")
    return best.withColumn("rank", place).filter(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?
-
]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ 	]+') as ws from pieces),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase
      from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest([1, 2, 3, 4]) as k))),
f as (select lang, k, phrase, count(*) as a from g group by lang, k, phrase),
c as (select * from f where k >= 2 and a >= 30),
p as (select lang, k, a, unnest(range(1, k)) as size, string_split(phrase, ' ') as ws from c where k >= 3),
q as (select lang, a, size, ws, unnest(range(1, k - size + 2)) as i from p where size >= 2),
longer as (select lang, array_to_string(ws[i:i + size - 1], ' ') as phrase, max(a) as longer from q group by 1, 2),
kept as (select c.* from c left join longer using (lang, phrase) where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
cuts as (select lang, phrase, a, string_split(phrase, ' ') as ws, k, unnest(range(1, k)) as cut from kept),
s as (select cuts.lang, cuts.phrase, cuts.a, cut, x.a as l, y.a as r, ((2000000 * cuts.a::hugeint) // (x.a::hugeint + y.a::hugeint))::bigint as score from cuts
      join f x on x.lang = cuts.lang and x.phrase = array_to_string(ws[1:cut], ' ') join f y on y.lang = cuts.lang and y.phrase = array_to_string(ws[cut + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
t as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from b),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang)
select t.lang, rank, phrase, a, l, r, n, score from t join n using (lang) where rank <= 2000"""
