"""Vectorised byte kernels shared by the text operators.

An Arrow string column is one contiguous byte buffer plus offsets, so words,
shingles and rolling windows of a whole batch of documents are computed by a
few NumPy passes without a Python loop over characters or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the polynomial hash modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

_pow_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (the longest array is kept per base)."""
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        seq = np.full(max(n, 1024), base, dtype=U64)
        seq[0] = 1
        have = np.cumprod(seq, dtype=U64)
        _pow_cache[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection, so it never adds collisions."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A fixed random 64-bit value for each byte value."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return buf[off[0]:off[-1]], off - off[0]


#: ASCII white space: the complement of the word class [^\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; words never cross documents."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    doc = np.searchsorted(off, s, side="right") - 1
    return s, e, doc


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e); spans may overlap."""
    n = len(buf)
    p = np.zeros(n + 1, dtype=U64)
    np.cumsum(byte_table(seed)[buf] * powers(BASE, n), out=p[1:])
    inv = powers(BASE_INV, n + 1)
    return mix((p[e] - p[s]) * inv[s] + (e - s).astype(U64))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes, those of multi-byte characters included, stay."""
    up = (buf >= 65) & (buf <= 90)
    return buf + (up.view(np.uint8) << 5)


def shingles(buf: np.ndarray, off: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle; a shorter text with words has
    one shingle, the whole sequence."""
    s, e, doc = words(buf, off)
    h = span_hash(buf, s, e, seed)
    nd = len(off) - 1
    count = np.bincount(doc, minlength=nd) if len(doc) else np.zeros(nd, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    m = len(h)
    out_h, out_d = [], []
    if m >= k:
        acc = h[: m - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc * U64(0x9E3779B97F4A7C15) + h[j: m - k + 1 + j])
        ok = doc[: m - k + 1] == doc[k - 1:]
        out_h.append(acc[ok])
        out_d.append(doc[: m - k + 1][ok])
    for n in range(1, k):
        at = first[:-1][count == n]
        if len(at):
            acc = h[at].copy()
            for j in range(1, n):
                acc = mix(acc * U64(0x9E3779B97F4A7C15) + h[at + j])
            out_h.append(mix(acc ^ U64(n)))
            out_d.append(doc[at])
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)


def distinct_sets(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, concatenated, and offsets."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int64)
