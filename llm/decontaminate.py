"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document is contaminated by a benchmark item if some region of it is within
the item's edit budget.  By the q-gram lemma such a region shares at least
``n + 1 - q - k q`` character q-grams with the item of n characters, all on
diagonals that lie within k of each other.

1. Positions whose q-gram occurs in any item are marked in one vectorised pass.
2. A region can only lie within its length of a sliding window that holds enough marks.
3. There, hits are counted per item in overlapping bands of 2(k+1) diagonals and
   bands below the lemma's bound are dropped.
4. What remains is verified by alignment in a band around its diagonals.

Texts are compared as code points with A-Z lowered and each run of ASCII white
space as one space; whole texts are read.  The benchmark is taken in blocks of
at most ``BLOCK_CHARS`` characters, each a bounded broadcast.

Hits are expanded to the items that hold their q-gram in chunks of bounded size,
in order of position, and bands that no later position can reach are settled; all
candidates of a slice are aligned together, so a template shared by thousands of
items costs array operations, not a loop over them.

Defined cases: null and empty texts and items match nothing; items shorter than
q characters after normalisation match nothing; an item with a null id counts
like any other and its matches have a null item_id; repeated documents and items
are judged one by one; of regions at equal distance the first is reported; texts
of any length are read whole; extra columns are ignored (``clean`` keeps them),
whatever their names; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import map_arrow, table
from llm.kernels import U64, mix

Q = 8
#: Edits allowed per character of an item (never more than the lemma can filter).
EDIT_RATE = 0.08
#: Characters of benchmark items that one pass over the documents compares with.
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 1 << 19
BITS = 23
#: Entries that hits are expanded to at once, and candidates that are aligned together.
EXPAND, ALIGN = 2_000_000, 20_000

MATCHES = "doc_id long, item_id long, start long, n_chars long, distance int"


def budget(n: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item of n characters; the lemma's bound stays positive."""
    return max(0, min(int(rate * n), (n - q) // q))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalise(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered code points with single spaces, and the position each came from."""
    space = (c == 32) | ((c >= 9) & (c <= 13))
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = np.where(space, np.uint32(32), c + (((c >= 65) & (c <= 90)).astype(np.uint32) << 5))
    at = np.flatnonzero(keep)
    return c[at], at


def qgrams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of the q-grams by doubling; empty if c is shorter."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, h, width = 0x9E3779B97F4A7C15, c.astype(U64), 1
    done, out = 0, np.zeros(n, U64)
    while True:
        if q & width:
            out = out * U64(pow(base, width, 1 << 64)) + h[done: done + n]
            done += width
        if 2 * width > q:
            return mix(out)
        h = h[:-width] * U64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2


def align(items: list[np.ndarray], text: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end in the region) of the best match of each whole item inside its
    region text[start:end] whose path stays on ``width`` diagonals from low on (region
    position minus item position); the distance is k + 1 if none is within k.

    All items move one character a step; those that cannot match any more leave."""
    n, size = np.array([len(x) for x in items]), end - start
    chars = np.zeros((len(items), int(n.max(initial=0))), np.uint32)
    for r, x in enumerate(items):
        chars[r, :len(x)] = x
    big, step = k + 1, np.arange(width)
    best, at = np.full(len(items), big), np.zeros(len(items), np.int64)
    live = np.arange(len(items))
    j = step + low[:, None]
    row = np.where((j >= 0) & (j <= size[:, None]), 0, big).astype(np.int32)  # the match may start anywhere
    for i in range(chars.shape[1]):
        j = step + low[live][:, None] + i  # region position consumed on each diagonal
        inside = (j >= 0) & (j < size[live][:, None])
        same = inside & (text[np.minimum(start[live][:, None] + np.maximum(j, 0), len(text) - 1)] == chars[live, i][:, None])
        sub = np.where(inside, row + ~same, big)
        cur = np.minimum(sub[:, :-1], row[:, 1:] + 1)  # or an item character without partner
        cur = np.concatenate([cur, np.minimum(sub[:, -1:], big)], 1)
        cur = np.minimum.accumulate(cur - step, 1) + step  # region characters without partner
        cur[(j + 1 < 0) | (j + 1 > size[live][:, None])] = big
        row = np.minimum(cur, big).astype(np.int32)
        least = row.min(1)
        done = n[live] == i + 1
        if done.any():
            where = row[done].argmin(1)
            best[live[done]], at[live[done]] = least[done], where + low[live[done]] + n[live[done]]
        stay = ~done & (least <= k)
        if not stay.all():
            live, row = live[stay], row[stay]
            if not len(live):
                break
    return best, at


def band_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, k: int) -> tuple[int, int]:
    """align of one item inside a whole region on diagonals low..high."""
    dist, end = align([item], region, np.array([0]), np.array([len(region)]), np.array([low]), high - low + 1, k)
    return int(dist[0]), int(end[0])


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list
    items: list[np.ndarray]

    def __post_init__(self):
        grams = [qgrams(c) for c in self.items]
        n = np.array([len(c) for c in self.items], np.int64)
        self.k = np.array([budget(int(x)) for x in n], np.int64)
        self.least = n + 1 - Q - self.k * Q
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        gram = np.concatenate(grams) if grams else np.zeros(0, U64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.pos = gram[order], owner[order], pos[order]
        self.mark = np.zeros(1 << BITS, bool)
        self.mark[(gram >> U64(64 - BITS)).astype(np.int64)] = True
        # a region of L marks-positions with `least` hits has a window of `window` positions with `dense` hits
        spans = n + self.k - Q + 1
        self.window = int(spans.min()) if len(spans) else 1
        self.span = int(spans.max()) if len(spans) else 1  # the rest of that region is as far from it at most
        tiles = -(-spans // self.window)
        self.dense = int((-(-self.least // tiles)).min()) if len(spans) else 1

    def candidates(self, c: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of (item, lowest, highest diagonal) of bands that meet the lemma's bound.
        bounds: the ends of the documents laid side by side in c."""
        g = qgrams(c)
        if not len(g) or not len(self.gram):
            return
        hit = self.mark[(g >> U64(64 - BITS)).astype(np.int64)]
        total = np.concatenate([[0], np.cumsum(hit)])
        w = min(self.window, len(g))
        dense = total[w:] - total[:-w] >= self.dense
        if not dense.any():
            return
        edge = np.zeros(len(g) + 1, np.int64)
        starts = np.flatnonzero(dense)
        np.add.at(edge, np.maximum(starts - self.span, 0), 1)
        np.add.at(edge, np.minimum(starts + w + self.span, len(g)), -1)
        at = np.flatnonzero(hit & (np.cumsum(edge[:-1]) > 0))
        gat = g[at]
        lo, hi = np.searchsorted(self.gram, gat, "left"), np.searchsorted(self.gram, gat, "right")
        count = hi - lo
        at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
        if not len(at):
            return
        reach = int(max(map(len, self.items)))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(count)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EXPAND, "right")))
            many = count[a:b]
            entry = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            item, diagonal = self.owner[entry], np.repeat(at[a:b], many) - self.pos[entry]
            band = np.floor_divide(diagonal, self.k[item] + 1)
            new, n = np.unique(np.concatenate([item * (1 << 40) + band + (1 << 30), item * (1 << 40) + band - 1 + (1 << 30)]), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n])).astype(np.int64)
            a = b
            who, first = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 30)
            s = self.k[who] + 1
            # a band is settled once every later hit lies on higher diagonals
            over = np.ones(len(keys), bool) if a == len(at) else (first + 2) * s - 1 < at[a] - reach
            ok = over & (counts >= self.least[who])
            if ok.any():
                yield who[ok], first[ok] * s[ok], (first[ok] + 2) * s[ok] - 1
            keys, counts = keys[~over], counts[~over]

    def matches(self, c: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> (distance, start, end) of the best verified region."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        lengths = np.array([len(x) for x in self.items], np.int64)
        for item, low, high in self.candidates(c, bounds):
            k, n = self.k[item], lengths[item]
            # a band may straddle two documents: it is judged in each that it touches
            d0 = np.maximum(np.searchsorted(bounds, np.maximum(low - k, 0), "right") - 1, 0)
            d1 = np.minimum(np.searchsorted(bounds, np.maximum(high + n + k, 1), "left") - 1, len(bounds) - 2)
            many = np.maximum(d1 - d0 + 1, 0)
            x = np.repeat(np.arange(len(item)), many)
            doc = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + d0[x]
            a, b = np.maximum(bounds[doc], (low - k)[x]), np.minimum(bounds[doc + 1], (high + n + k)[x])
            fits = b - a >= (n - k)[x]
            x, doc, a, b = x[fits], doc[fits], a[fits], b[fits]
            order = np.lexsort((n[x], k[x]))  # items of one budget, of like length
            for part in np.split(order, np.flatnonzero(np.diff(k[x][order])) + 1):
                for p in range(0, len(part), ALIGN):
                    y = part[p:p + ALIGN]
                    budget_ = int(k[x[y[0]]]) if len(y) else 0
                    if not len(y):
                        continue
                    dist, end = align([self.items[i] for i in item[x[y]]], c, a[y], b[y], (low - k)[x[y]] - a[y], 2 * (budget_ + 1) + 2 * budget_, budget_)
                    for r in np.flatnonzero(dist <= budget_):
                        d, i, e = int(doc[y[r]]), int(item[x[y[r]]]), int(a[y[r]] + end[r])
                        new = (int(dist[r]), max(int(bounds[d]), e - int(lengths[i])), e)
                        if (d, i) not in found or new < found[d, i]:
                            found[d, i] = new
        return found

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, n_chars, distance) of all matches; start in code points of the text."""
        a = 0
        while a < len(texts):
            part, size, b = [], 0, a
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= SLICE_CHARS):
                part.append(texts[b] or "")
                size += len(part[-1])
                b += 1
            ends = np.cumsum([len(t) + 1 for t in part])
            # documents are kept apart by a character that no item holds
            c, at = normalise(codes("\x00".join(part) + "\x00"))
            bounds = np.concatenate([[0], np.searchsorted(at, ends)])
            for (d, i), (dist, s, e) in sorted(self.matches(c, bounds).items()):
                first = int(at[s]) - (int(ends[d - 1]) if d else 0)
                last = int(at[min(e, len(at)) - 1]) + 1 - (int(ends[d - 1]) if d else 0)
                yield a + d, i, first, last - first, dist
            a = b


def blocks(benchmark: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The items in blocks of bounded size (by hash of the key)."""
    total = benchmark.select(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        rows = (benchmark.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == b).select(key, text)
                .orderBy(key, text).collect())
        items = [(r[0], normalise(codes(r[1].strip()))[0]) for r in rows if r[1]]
        items = [(i, c) for i, c in items if len(c) >= Q]
        if items:
            yield Index([i for i, _ in items], [c for _, c in items])


def find_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """MATCHES: one row per document and item that contaminates it, with the best region."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for index in blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast((index.ids, index.items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[r], index.ids[i], s, n, d) for r, i, s, n, d in index.scan(batch.column(1).to_pylist())]
                cols = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32())],
                    names=["doc_id", "item_id", "start", "n_chars", "distance"])

        out = out.unionByName(map_arrow(rows, run, MATCHES))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    for index in blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast((index.ids, index.items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in index.scan(batch.column(batch.num_columns - 1).to_pylist())]] = False
                yield batch.filter(pa.array(keep)).select(list(range(batch.num_columns - 1)))

        names = [f"c{i}" for i in range(len(docs.columns))]
        schema = docs.toDF(*names).schema
        with_text = docs.toDF(*names).withColumn("_text", F.col(names[docs.columns.index(text)]))
        docs = map_arrow(with_text, run, schema).toDF(*docs.columns)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
