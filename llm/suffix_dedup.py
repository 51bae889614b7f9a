"""Exact removal of byte strings that occur earlier, by a sparse suffix array.

Every LENGTH-byte string that also starts earlier (smaller doc_id, or same
document and earlier start) is removed, overlaps included; matches never cross
documents and are judged on the input.

A full suffix array of the corpus would shuffle every byte position.  Only
suffixes at anchors are sorted: each LENGTH-byte window has one anchor, the
smallest of the hashed GRAM-byte strings inside it, so equal windows have equal
anchors at equal offsets and no match is missed.

1. Anchors whose gram occurs once in the corpus are dropped (each fragment of
   the hash order counts its grams; one entry per gram and slice).
2. An entry is the suffix at an anchor, as far as its windows reach, with the
   bytes before it that they reach: real bytes, no hashes.  Splitters sampled in
   step 1 range-partition the entries by their leading bytes; where a leading
   token is hot, splitters differ further on, in the suffix or before it.
3. Buckets sort their suffixes by multikey quicksort.  Windows at one offset from
   the anchor are equal if their suffixes share a long enough prefix with all
   between them and the bytes before are equal; all but the first are marked.
4. Compare across boundaries: a window whose part of the suffix is also the
   beginning of the bucket's first or last splitter may have equals in other
   buckets.  Those that are the first of their bucket are compared by their bytes.
5. Marks go back to the documents.

Entries repeated within one slice of documents are settled there (only the first
is sent), so copies cost one entry per slice.

Defined cases: a null text is empty; a null doc_id comes before all others; rows
that share a doc_id are documents of their own, in the order of their text's
hash; equal rows count as copies in an order of their own, all but one removed;
texts shorter than LENGTH lose nothing; texts of any length are read whole; extra
columns are kept in ``_row``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import by_key, data_parts, discard, map_arrow, partitions, table, written
from llm.kernels import BASE, BASE_INV, U64, byte_table, mix, powers, text_buffer

LENGTH, GRAM = 100, 32
#: Bytes of an entry's suffix and of what is before it, filled up to whole words.
RIGHT, LEFT = 104, 72
#: Bytes of text whose windows are in memory at once.
SLICE_BYTES = 1 << 20
FRAGMENTS = 2
#: One anchor in SAMPLE, or as few as give half of SPLITTERS, is a candidate for a splitter.
SAMPLE, SPLITTERS = 1024, 20_000
NULL_ID = np.iinfo(np.int64).min
PARTS = "fragment int, batch long, kind int, a binary, b binary, c binary"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), *(pa.array(x, pa.binary()) for x in c[3:])],
        names=["fragment", "batch", "kind", "a", "b", "c"])


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed concatenation: text bytes and positions shrink to a third."""
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Rolling:
    """Hashes of all windows of a buffer."""

    def __init__(self, buf: np.ndarray, seed: int):
        n = len(buf)
        self.p = np.zeros(n + 1, U64)
        np.cumsum(byte_table(seed)[buf] * powers(BASE, n), out=self.p[1:])
        self.inv = powers(BASE_INV, n + 1)

    def order(self, k: int) -> np.ndarray:
        """A 32-bit rank of every window of k bytes, a function of its bytes."""
        x = self.p[k:] - self.p[:-k]
        x *= self.inv[: len(x)]
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        return (x >> U64(32)).astype(np.uint32)

    def at(self, s: np.ndarray, k: int) -> np.ndarray:
        return mix((self.p[s + k] - self.p[s]) * self.inv[s])


def window_best(x: np.ndarray, w: int, best) -> np.ndarray:
    """Minimum or maximum of every w neighbours, by doubling."""
    m, width = x, 1
    while width * 2 <= w:
        m = best(m[:-width], m[width:])
        width *= 2
    r = w - width
    return best(m[:-r], m[r:]) if r else m


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first and last window start) of every anchor.

    The anchor of a window is the leftmost of its grams of smallest rank, so it
    depends on the window's bytes only."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return np.zeros(0, U64), none, none, none
    roll = Rolling(buf, 3)
    g = roll.order(GRAM)
    w = LENGTH - GRAM + 1
    low = window_best(g, w, np.minimum)
    # grams that are the smallest of some window: their rank is the largest minimum around them
    pad = np.zeros(w - 1, np.uint32)
    small = window_best(np.concatenate([pad, low, pad]), w, np.maximum) == g
    hit = np.flatnonzero(small)
    next_hit = np.cumsum(small, dtype=np.int32)[: len(low)] - small[: len(low)]
    inside = np.ones(len(low), bool)
    for end in off[1:]:
        inside[max(int(end) - LENGTH + 1, 0): int(end)] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return np.zeros(0, U64), none, none, none
    low, nxt = low[starts], next_hit[starts]
    wrong = np.flatnonzero(g[hit[nxt]] != low)
    while len(wrong):  # skip anchors of other windows that lie between
        nxt[wrong] += 1
        wrong = wrong[g[hit[nxt[wrong]]] != low[wrong]]
    new = np.ones(len(starts), bool)
    new[1:] = (nxt[1:] != nxt[:-1]) | (starts[1:] != starts[:-1] + 1)
    h = np.flatnonzero(new)
    a = hit[nxt[h]]
    return roll.at(a, GRAM), a, starts[h], starts[np.append(h[1:], len(starts)) - 1]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, first row, last row, bytes, offsets) of at most SLICE_BYTES or one longer text."""
    for batch in batches:
        buf, off = text_buffer(batch.column(2))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, side="right")) - 1)
            yield batch, a, b, buf[off[a]:off[b]], off[a:b + 1] - off[a]
            a = b


def entry_bytes(buf: np.ndarray, at: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """RIGHT bytes from each position on, then LEFT bytes before it, nearest first;
    zero beyond n_right and n_left."""
    out = np.zeros((len(at), RIGHT + LEFT), np.uint8)
    j = np.arange(RIGHT, dtype=np.int32)
    out[:, :RIGHT] = np.where(j < n_right[:, None], buf[np.minimum(at[:, None] + j, max(len(buf) - 1, 0))], 0) if len(at) else 0
    j = np.arange(LEFT, dtype=np.int32)
    out[:, RIGHT:] = np.where(j < n_left[:, None], buf[np.maximum(at[:, None] - 1 - j, 0)], 0) if len(at) else 0
    return out


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian words."""
    return np.ascontiguousarray(rows).view(">u8").astype(U64)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of words, first word first.

    A segment of rows that agree so far is split in three by the word at its depth:
    the rows below the pivot's word, those equal to it, which go on with the next
    word, and those above.  All segments are split at once."""
    order = np.arange(len(words))
    lo, hi, depth = np.zeros(1, np.int64), np.full(1, len(words), np.int64), np.zeros(1, np.int64)
    while True:
        todo = (hi - lo > 1) & (depth < words.shape[1])
        lo, hi, depth = lo[todo], hi[todo], depth[todo]
        if not len(lo):
            return order
        size = hi - lo
        seg = np.repeat(np.arange(len(lo)), size)
        pos = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + lo[seg]
        rows = order[pos]
        key, pivot = words[rows, depth[seg]], words[order[(lo + hi) // 2], depth][seg]
        side = 3 * seg + (key > pivot) + (key >= pivot)
        order[pos] = rows[np.argsort(side, kind="stable")]
        n = np.bincount(side, minlength=3 * len(lo)).reshape(-1, 3)
        one, two = lo + n[:, 0], lo + n[:, 0] + n[:, 1]
        lo, hi, depth = np.concatenate([lo, one, two]), np.concatenate([one, two, hi]), np.concatenate([depth, depth + 1, depth])


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of bytes."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row in sorted order, common prefix of each sorted row with the one before)."""
    order = multikey_quicksort(words_of(rows))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    prefix = np.zeros(len(rows), np.int64)
    prefix[1:] = common_prefix(rows[order[1:]], rows[order[:-1]])
    return rank, prefix


def repeats(rows: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in document order, with windows that begin low..high bytes before
    the anchor: the least and largest offset of a window that occurs in an earlier
    entry (LENGTH and -1: none), and (entry, offset) of windows without an earlier
    one that may have equals beyond the bounds, the keys at the bucket's ends."""
    n = len(rows)
    first, last = np.full(n, LENGTH), np.full(n, -1)
    reach = np.zeros(n, np.int64)
    for key in bounds:
        reach = np.maximum(reach, common_prefix(rows[:, :RIGHT], np.broadcast_to(key[:RIGHT], (n, RIGHT))))
    right, right_prefix = classes(rows[:, :RIGHT])
    left, left_prefix = classes(rows[:, RIGHT:])
    open_at, open_i = [], []
    for i in range(int(low.min(initial=LENGTH)), int(high.max(initial=-1)) + 1):
        who = np.flatnonzero((low <= i) & (i <= high))
        a = np.cumsum(right_prefix < LENGTH - i)[right[who]]
        b = np.cumsum(left_prefix < i)[left[who]]
        key = a * (n + 1) + b
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(who), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        x = who[again]
        first[x], last[x] = np.minimum(first[x], i), i
        y = who[~again]
        y = y[reach[y] >= LENGTH - i]
        open_at.append(y)
        open_i.append(np.full(len(y), i))
    none = np.zeros(0, np.int64)
    return first, last, np.concatenate([none, *open_at]), np.concatenate([none, *open_i])


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(int(NULL_ID))).alias("id"), F.xxhash64(t).alias("h"), t.alias("text"))


def shared_anchors(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(id, h, at): the positions of each document's repeated anchors; and the
    splitters, rows of entry bytes in order."""
    spark = rows.sparkSession
    parts = partitions(spark)
    n_frag = data_parts(rows, FRAGMENTS * parts)
    # about one anchor in 35 bytes of text; the estimate of bytes may be of compressed files
    rate = U64(max(SAMPLE, n_frag * (64 << 20) // 10 // (SPLITTERS // 2)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch, lo, hi, buf, off in _slices(batches):
            g, a, s, e = anchors(buf, off)
            if not len(g):
                continue
            doc = np.searchsorted(off, a, side="right") - 1
            order = np.argsort(g, kind="stable")
            gs = g[order]
            same = np.zeros(len(g), bool)
            same[1:] = gs[1:] == gs[:-1]
            multi = same.copy()
            multi[:-1] |= same[1:]
            key = (part << 32) | seq
            seq += 1
            ids, hs = np.asarray(batch.column(0))[lo:hi], np.asarray(batch.column(1))[lo:hi]
            known = np.zeros(len(g), np.uint8)
            known[order] = multi
            used = np.unique(doc)
            rows = [(key % n_frag, key, 1,
                     pack(ids[used], hs[used], np.bincount(doc, minlength=len(off) - 1)[used].astype(np.int64)),
                     pack((a - off[doc]).astype(np.int32)), known.tobytes())]
            pick = np.flatnonzero(mix(g + ids[doc].view(U64) * U64(31) + a.astype(U64)) % rate == 0)
            if len(pick):
                x = a[pick]
                rows.append((key % n_frag, key, 3, entry_bytes(buf, x, x - s[pick], e[pick] + LENGTH - x).tobytes(), b"", b""))
            frag = ((gs >> U64(32)) * U64(n_frag)) >> U64(32)
            sent = np.flatnonzero(~same)
            sent = sent[np.argsort(frag[sent], kind="stable")]
            cut = np.flatnonzero(np.concatenate([[True], frag[sent][1:] != frag[sent][:-1]]))
            low, where = gs.astype(np.uint32), order.astype(np.int32)
            for i, j in zip(cut, np.append(cut[1:], len(sent))):
                x = sent[i:j]
                rows.append((int(frag[x[0]]), key, 0, low[x].tobytes(), where[x].tobytes(), b""))
            yield _parts(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, rows in by_key(batches):  # one fragment at a time
            out = [(f, key, kind, a, b, c) for key, kind, a, b, c in rows if kind]
            rows = [(key, np.frombuffer(a, np.uint32), np.frombuffer(b, np.int32)) for key, kind, a, b, _ in rows if not kind]
            toks = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.uint32)
            order = np.argsort(toks, kind="stable")
            same = np.zeros(len(toks), bool)
            same[1:] = toks[order][1:] == toks[order][:-1]
            same[:-1] |= same[1:]
            shared = np.zeros(len(toks), bool)
            shared[order] = same
            at = 0
            for key, tok, where in rows:
                hit = where[shared[at: at + len(tok)]]
                at += len(tok)
                if len(hit):
                    out.append((f, key, 2, hit.tobytes(), b"", b""))
            if out:
                yield _parts(out)

    schema = "id long, h long, at binary"

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):  # one slice of documents at a time
            a, b, c = next(r[2:] for r in rows if r[1] == 1)
            ids, hs, n = np.frombuffer(unpack(a), np.int64).reshape(3, -1)
            pos, known = np.frombuffer(unpack(b), np.int32), np.frombuffer(c, np.uint8).astype(bool)
            for _, kind, x, *_ in rows:
                if kind == 2:
                    known[np.frombuffer(x, np.int32)] = True
            end = np.cumsum(n)
            any_ = np.add.reduceat(known, end - n) > 0 if len(n) else np.zeros(0, bool)
            out = [pos[e - k: e][known[e - k: e]].tobytes() for e, k in zip(end[any_], n[any_])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[any_]), pa.array(hs[any_]), pa.array(out, pa.binary())], names=["id", "h", "at"])

    def sorted_by(df: DataFrame, column: str) -> DataFrame:
        return df.repartition(parts, column).sortWithinPartitions(column)

    replies = written(map_arrow(sorted_by(map_arrow(rows, split, PARTS), "fragment"), count, PARTS), "anchors")
    sample = b"".join(bytes(r.a) for r in replies.filter("kind = 3").select("a").limit(SPLITTERS).collect())
    full = np.sort(np.frombuffer(sample, f"S{RIGHT + LEFT}"))
    take = np.unique(full[np.linspace(0, len(full) - 1, n_frag + 1).astype(int)[1:-1]]) if len(full) else full
    at = map_arrow(sorted_by(replies.filter("kind <> 3"), "batch"), total, schema)
    out = written(at, "shared-anchors")
    discard(replies)
    return out, take


def suffix_entries(buf: np.ndarray, off: np.ndarray, wanted: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(position, document, least and largest offset of its windows) of the wanted anchors."""
    g, a, s, e = anchors(buf, off)
    doc = np.searchsorted(off, a, side="right") - 1
    want = np.concatenate([off[i] + w.astype(np.int64) for i, w in enumerate(wanted)]) if wanted else np.zeros(0, np.int64)
    keep = np.isin(a, want) if len(a) else np.zeros(0, bool)
    return a[keep], doc[keep], (a - e)[keep], (a - s)[keep]


def removed_windows(rows: DataFrame, at: DataFrame, splitters: np.ndarray) -> DataFrame:
    """(id, h, q, n): start and length of the removed stretches of each document."""
    spark = rows.sparkSession
    parts = partitions(spark)
    n_bucket = len(splitters) + 1
    ends = np.frombuffer(splitters.tobytes(), np.uint8).reshape(-1, RIGHT + LEFT)
    joined = rows.dropDuplicates(["id", "h"]).join(at.dropDuplicates(["id", "h"]), ["id", "h"])

    def marks(ids, hs, q, n) -> Iterator[tuple]:
        """One row per partition of documents: removed stretches, sorted by document."""
        home = mix(ids.view(U64) ^ hs.view(U64)) % U64(parts)
        order = np.lexsort((q, hs, ids, home))
        home, ids, hs, q, n = home[order], ids[order], hs[order], q[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(q) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(q))):
            yield 0, int(home[a]), 1, pack(ids[a:b], hs[a:b]), pack(q[a:b].astype(np.int32)), n[a:b].astype(np.uint8).tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries to their buckets (kind 0); a row's fragment is where it goes next."""
        for batch, lo, hi, *_ in _slices(batches):
            piece = batch.slice(lo, hi - lo)
            piece = piece.take(pa.array(np.lexsort((np.asarray(piece.column(1)), np.asarray(piece.column(0))))))
            buf, off = text_buffer(piece.column(2))
            ids, hs = np.asarray(piece.column(0)), np.asarray(piece.column(1))
            a, d, low, high = suffix_entries(buf, off, [np.frombuffer(x, np.int32) for x in piece.column(3).to_pylist()])
            if not len(a):
                continue
            key = entry_bytes(buf, a, high, LENGTH - low)
            # entries repeated within the slice are settled here
            fp = mix(words_of(key) * powers(BASE, key.shape[1] // 8)).sum(1, dtype=U64) + low.astype(U64) * U64(131) + high.astype(U64)
            order = np.argsort(fp, kind="stable")
            x, y = order[1:], order[:-1]
            same = np.zeros(len(a), bool)
            same[x] = (fp[x] == fp[y]) & (low[x] == low[y]) & (high[x] == high[y]) & (key[x] == key[y]).all(1)
            rows = []
            if same.any():
                x = np.flatnonzero(same)
                where = a[x] - high[x] - off[d[x]]
                rows += [(home % n_bucket, home, kind, u, v, w) for _, home, kind, u, v, w in marks(ids[d[x]], hs[d[x]], where, high[x] - low[x] + LENGTH)]
            x = np.flatnonzero(~same)
            bucket = np.searchsorted(splitters, np.ascontiguousarray(key[x]).view(splitters.dtype).ravel(), "right")
            x = x[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for i, j in zip(cut, np.append(cut[1:], len(x))):
                y = x[i:j]
                used, n = np.unique(d[y], return_counts=True)
                n_left, n_right = high[y], LENGTH - low[y]
                size = n_left + n_right
                byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a[y] - n_left, size)
                y_at = (a[y] - off[d[y]]).astype(np.int32)
                rows.append((int(bucket[i]), 0, 0, pack(ids[used], hs[used], n.astype(np.int64)), pack(y_at),
                             pack(low[y].astype(np.uint8), high[y].astype(np.uint8), buf[byte])))
            yield _parts(rows)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks (kind 1) and windows to compare across boundaries (kind 2)."""
        for f, rows in by_key(batches):
            out = [(home % n_bucket, home, 1, a, b, c) for home, kind, a, b, c in rows if kind]
            cols = [[] for _ in range(6)]
            for _, kind, a, b, c in rows:
                if kind:
                    continue
                ids, hs, n = np.frombuffer(unpack(a), np.int64).reshape(3, -1)
                m, c = int(n.sum()), np.frombuffer(unpack(c), np.uint8)
                low, high = c[:m].astype(np.int64), c[m:2 * m].astype(np.int64)
                size = high + LENGTH - low
                key = entry_bytes(c[2 * m:], np.cumsum(size) - size + high, high, LENGTH - low)
                for col, x in zip(cols, (np.repeat(ids, n), np.repeat(hs, n), np.frombuffer(unpack(b), np.int32).astype(np.int64), low, high, key)):
                    col.append(x)
            if cols[0]:
                ids, hs, q, low, high, key = (np.concatenate(x) for x in cols)
                x = np.lexsort((q, hs, ids))
                ids, hs, q, low, high, key = (c[x] for c in (ids, hs, q, low, high, key))
                first, last, at, i = repeats(key, low, high, [*ends[max(f - 1, 0):f], *ends[f:f + 1]])
                x = np.flatnonzero(last >= 0)
                out += [(home % n_bucket, home, k, u, v, w) for _, home, k, u, v, w in marks(ids[x], hs[x], q[x] - last[x], last[x] - first[x] + LENGTH)]
                for lo in range(0, len(at), 100_000):
                    out += list(across(ids, hs, q, key, at[lo:lo + 100_000], i[lo:lo + 100_000]))
            if out:
                yield _parts(out)

    def across(ids, hs, q, key, at, i) -> Iterator[tuple]:
        """The bytes of open windows, dealt by their hash."""
        j = np.arange(LENGTH)
        side = np.where(j < i[:, None], RIGHT + i[:, None] - 1 - j, j - i[:, None])  # left bytes are stored backwards
        text = key[at[:, None], side]
        goal = mix((text.astype(U64) * powers(BASE, LENGTH)).sum(1, dtype=U64)) % U64(n_bucket)
        order = np.argsort(goal, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], goal[order][1:] != goal[order][:-1]]))
        for a, b in zip(cut, np.append(cut[1:], len(order))):
            x = order[a:b]
            yield int(goal[x[0]]), 0, 2, pack(ids[at[x]], hs[at[x]]), pack((q[at[x]] - i[x]).astype(np.int32)), pack(text[x])

    def boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal windows of different buckets: all but the first are marked."""
        for _, rows in by_key(batches):
            out = [(home, 0, 1, a, b, c) for home, kind, a, b, c in rows if kind == 1]
            got = [(np.frombuffer(unpack(a), np.int64).reshape(2, -1), np.frombuffer(unpack(b), np.int32), np.frombuffer(unpack(c), f"V{LENGTH}"))
                   for _, kind, a, b, c in rows if kind == 2]
            if got:
                ids, hs = np.concatenate([g[0] for g in got], 1)
                q, text = np.concatenate([g[1] for g in got]).astype(np.int64), np.concatenate([g[2] for g in got])
                filled = np.zeros((len(q), RIGHT), np.uint8)
                filled[:, :LENGTH] = text.view(np.uint8).reshape(-1, LENGTH)
                rank, prefix = classes(filled)
                group = np.cumsum(prefix < LENGTH)[rank]
                order = np.lexsort((q, hs, ids, group))
                x = order[1:][group[order][1:] == group[order][:-1]]
                out += [(home, 0, 1, a, b, c) for _, home, _, a, b, c in marks(ids[x], hs[x], q[x], np.full(len(x), LENGTH))]
            if out:
                yield _parts(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            ids, hs = np.concatenate([np.frombuffer(unpack(r[2]), np.int64).reshape(2, -1) for r in rows], 1)
            q, n = np.concatenate([np.frombuffer(unpack(r[3]), np.int32) for r in rows]), np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows])
            order = np.lexsort((hs, ids))
            ids, hs, q, n = ids[order], hs[order], q[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1])]))
            end = np.append(cut[1:], len(q))
            for i in range(0, len(cut), 2000):
                part = list(zip(cut[i:i + 2000], end[i:i + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[cut[i:i + 2000]]), pa.array(hs[cut[i:i + 2000]]), pa.array([q[a:b].tobytes() for a, b in part], pa.binary()),
                     pa.array([n[a:b].tobytes() for a, b in part], pa.binary())], names=["id", "h", "q", "n"])

    def step(df: DataFrame, run, schema: str = PARTS) -> DataFrame:
        return map_arrow(df.repartition(parts, "fragment").sortWithinPartitions("fragment"), run, schema)

    sent = map_arrow(joined.select("id", "h", "text", "at"), split, PARTS)
    return step(step(step(sent, bucket), boundary), gather, "id long, h long, q binary, n binary")


def covered(n: int, q: bytes | None, size: bytes | None) -> np.ndarray:
    """Removed bytes of a document of n bytes."""
    if not q:
        return np.zeros(n, bool)
    q, size = np.frombuffer(q, np.int32).astype(np.int64), np.frombuffer(size, np.uint8).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, q, 1)
    np.add.at(edge, q + size, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, n_bytes, n_removed, n_spans, kept_sha256, kept): kept are the remaining bytes."""
    rows = keyed(docs, key, text)
    at, splitters = shared_anchors(rows)
    gone = written(removed_windows(rows, at, splitters), "removed-windows")
    discard(at)
    full = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
                       F.coalesce(docs[key].cast("long"), F.lit(int(NULL_ID))).alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"))
    full = full.join(gone, ["id", "h"], "left")
    # equal rows: all but one lose everything that a window covers
    equal = written(keyed(docs, key, text).groupBy("id", "h").count().filter("count > 1").select("id", "h"), "equal-rows")
    if equal.limit(1).count():
        from pyspark.sql import Window as W
        twin = full.join(equal, ["id", "h"], "left_semi").withColumn("_nth", F.row_number().over(W.partitionBy("id", "h").orderBy("id")))
        full = full.join(equal, ["id", "h"], "left_anti").withColumn("_nth", F.lit(1)).unionByName(twin)
    else:
        full = full.withColumn("_nth", F.lit(1))
    row_type = full.schema["_row"].dataType
    names = [f"c{i}" for i in range(len(docs.columns))]
    at_text = docs.columns.index(text)
    flat = full.select(*[F.col("_row").getField(c).alias(n) for c, n in zip(docs.columns, names)], "q", "n", "_nth")
    from pyspark.sql import types as T
    out_schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, row_type.fields)] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                buf, off = text_buffer(part.column(at_text))
                stat, kept = [], []
                for i, (q, m, nth) in enumerate(zip(*(part.column(j).to_pylist() for j in (k, k + 1, k + 2)))):
                    data = buf[off[i]:off[i + 1]]
                    if nth > 1 and len(data) >= LENGTH:
                        gone = np.ones(len(data), bool)
                    elif q:
                        gone = covered(len(data), q, m)
                    else:
                        raw = data.tobytes()
                        stat.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                        kept.append(raw)
                        continue
                    raw = data[~gone].tobytes()
                    stat.append((len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(raw).hexdigest()))
                    kept.append(raw)
                c = list(zip(*stat))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j) for j in range(k)), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), pa.array(kept, pa.binary())],
                    names=out_schema.names)

    out = map_arrow(flat, run, out_schema)
    return out.select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)]).alias("_row"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup_text(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with the remaining text; rows that lose all of a text go, others stay.

    A character of which some bytes are removed goes whole.  n_chars, if it is a
    column, counts the characters left."""

    @F.pandas_udf("string")
    def decode(kept):
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    out = dedup(docs, key, text).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    changed = F.when(F.col("n_removed") == 0, F.col("_row").getField(text)).otherwise(decode("kept"))
    out = out.withColumn("_new", changed)
    cols = []
    for c, kind in docs.dtypes:
        value = F.col("_row").getField(c)
        if c == text:
            value = F.col("_new")
        elif c == n_chars:
            value = F.when(F.col("n_removed") == 0, value).otherwise(F.length("_new").cast(kind))
        cols.append(value.alias(c))
    return out.select(*cols)
