"""SentencePiece encoding and decoding by vectorised merge rounds.

The symbols of a slice of texts lie in flat NumPy arrays.  A text is cut into words
wherever two neighbouring characters stand together in no piece: no merge can cross
such a place.  Each distinct word of a slice is encoded once, all words at the same
time: a round finds the smallest pair rank of every word (segmented minimum), merges
all occurrences of that pair from the left, and closes the gaps, until no pair is
left.

The library merges one pair at a time.  Merging all occurrences at once gives the
same, unless a symbol just made forms a pair that would go before the occurrences
still open (ranks of a trained vocabulary do not rise along every path, and runs of
spaces share one rank).  Every round checks for that; such words are encoded again
with one merge a round.  Words of more than ``LONG`` symbols (characters without any
place to cut) merge pair by pair from a heap, as their rounds would be as many as
their distinct pairs.

Encoding and decoding happen within rows, without a shuffle.  Defined cases: a null
text counts as empty, and an empty text has the begin and end ids alone; a null key is
passed on; repeated rows count alike; other columns are ignored, whatever their names;
an empty table gives no rows.  Null ids decode to the empty text.  Bytes that form no
character become U+FFFD each, as the library has it.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import map_arrow, table
from llm.kernels import BASE, BASE_INV, U64, mix, powers, text_buffer

MODEL = "piece_bpe_32k.model"
#: Symbols that are encoded together, and those of a word that is merged pair by pair.
SLICE, LONG = 1 << 20, 1024
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
NONE = np.int32(1 << 30)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i:i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    """A BPE model with byte fallback whose normalizer leaves texts as they are."""

    def __init__(self, path: str):
        model = list(_fields(open(path, "rb").read()))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        trainer = {k: v for n, m in model if n == 2 for k, v in _fields(m)}
        normalizer = {k: v for n, m in model if n == 3 for k, v in _fields(m)}
        self.text = [p[1].decode() for p in pieces]
        kinds = np.array([p.get(3, NORMAL) for p in pieces])
        scores = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces])
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or trainer.get(24):
            raise ValueError(f"{path}: only BPE with byte fallback, a space in front and no normalization")
        if not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.size, self.kinds = len(pieces), kinds
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_id[int(self.text[i], 16) if self.text[i].startswith("0x") else int(self.text[i][1:-1], 16)] = i
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.rank = np.append(rank, NONE)  # at -1: no piece

        known = {t: i for i, t in enumerate(self.text) if kinds[i] == NORMAL}
        chars = {c for t in known for c in t}
        if not chars <= known.keys():
            raise ValueError(f"{path}: characters of pieces that are no pieces")
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.of_char[ord(c)] = known[c]
        self.of_char[0x20] = known[SPACE]
        pairs = [(known[t[:k]], known[t[k:]], i) for t, i in known.items() for k in range(1, len(t)) if t[:k] in known and t[k:] in known]
        left, right, made = np.array(sorted(pairs), np.int64).T
        self.pair_key, self.pair_made = left * self.size + right, made.astype(np.int32)
        self._hashed()
        # characters that stand side by side in some piece
        inner = sorted({c for t in known if len(t) > 1 for c in t})
        number = {c: i + 1 for i, c in enumerate(inner)}
        self.kind_of = np.zeros(self.size, np.int32)
        for c, i in number.items():
            self.kind_of[known[c]] = i
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for t in known:
            for a, b in zip(t, t[1:]):
                self.beside[number[a], number[b]] = True
        # what pieces decode to
        out = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else trainer.get(44, " ⁇ ".encode()) if k == UNKNOWN else t.replace(SPACE, " ").encode()
               for t, k in zip(self.text, kinds)]
        self.spells = np.frombuffer(b"".join(out), np.uint8)
        self.spell_at = np.concatenate([[0], np.cumsum([len(b) for b in out])]).astype(np.int64)
        self.opens = np.array([k == NORMAL and t.startswith(SPACE) for t, k in zip(self.text, kinds)])

    def _hashed(self) -> None:
        """The pair table by open addressing, so that a lookup is one or few gathers."""
        bits = int(len(self.pair_key) * 4).bit_length()
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        open_, at = np.arange(len(self.pair_key)), self._slot(self.pair_key)
        self.probes = 0
        while len(open_):
            self.probes += 1
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            take = free[first]
            self.slots[at[take]], self.found[at[take]] = self.pair_key[open_[take]], self.pair_made[open_[take]]
            rest = np.ones(len(open_), bool)
            rest[take] = False
            open_, at = open_[rest], (at[rest] + 1) & mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(BASE)) >> self.shift).astype(np.int64)

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = self._slot(key)
        there = self.slots[at]
        out = np.where(there == key, self.found[at], np.int32(-1))
        look = np.flatnonzero((there != key) & (there >= 0))
        for _ in range(1, self.probes):
            if not len(look):
                break
            at[look] = (at[look] + 1) & (len(self.slots) - 1)
            there = self.slots[at[look]]
            hit = there == key[look]
            out[look[hit]] = self.found[at[look[hit]]]
            look = look[~hit & (there >= 0)]
        return out

    # ---- encoding -----------------------------------------------------------

    def symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, byte offset) of UTF-8 bytes: a piece for each character, or one for each byte of characters without."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(lead, append=len(data))
        first = data[lead].astype(np.int32)
        code = first.copy()
        for n, bits in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = np.flatnonzero(width == n)
            c = first[at] & bits
            for k in range(1, n):
                c = (c << 6) | (data[lead[at] + k] & 0x3F)
            code[at] = c
        sym = self.of_char[code]
        lost = np.flatnonzero(sym < 0)
        if not len(lost):
            return sym, lead
        n = np.ones(len(lead), np.int64)
        n[lost] = width[lost]
        pos = np.repeat(lead, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.where(np.repeat(sym < 0, n), self.byte_id[data[pos]], np.repeat(sym, n)), pos

    def rounds(self, sym: np.ndarray, word: np.ndarray, n_words: int, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces, their words, words where the order of merges matters) of flat symbols; words are ascending."""
        again = np.zeros(n_words, bool)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            made[:-1] = self.made(sym[:-1], sym[1:])
            made[:-1][word[1:] != word[:-1]] = -1
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(start, append=len(sym))
            rank = self.rank[made]
            least = np.minimum.reduceat(rank, start)
            goes_on = least < NONE
            if not goes_on.all():
                stay = np.repeat(goes_on, length)
                done.append((sym[~stay], word[~stay]))
                sym, word, made, rank = sym[stay], word[stay], made[stay], rank[stay]
                least, length = least[goes_on], length[goes_on]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            if single:
                at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            else:  # of overlapping occurrences every second one, from the left
                joins = np.concatenate([[False], at[1:] == at[:-1] + 1])
                if joins.any():
                    place = np.arange(len(at))
                    at = at[((place - np.maximum.accumulate(np.where(joins, 0, place))) & 1) == 0]
            new = made[at]
            # the pair with the next symbol, as it is before that merges
            after = np.full(len(at), -1, np.int32)
            inside = at + 2 < len(sym)
            inside[inside] = word[at[inside] + 2] == word[at[inside]]
            after[inside] = self.made(new[inside], sym[at[inside] + 2])
            sym[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            made[at] = after
            sym, word, made = sym[keep], word[keep], made[keep]
            now = at - np.arange(len(at))  # where the new symbols are
            before = np.full(len(at), -1, np.int32)
            inside = now > 0
            inside[inside] = word[now[inside] - 1] == word[now[inside]]
            before[inside] = self.made(sym[now[inside] - 1], sym[now[inside]])
            if not single:
                many = np.concatenate([[False], word[now[1:]] == word[now[:-1]]])
                many[:-1] |= many[1:]
                sooner = many & (np.minimum(self.rank[before], self.rank[after]) <= self.rank[new])
                again[word[now[sooner]]] = True
            made[now[inside] - 1] = before[inside]
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, word.dtype), again
        pieces, words = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words, kind="stable")
        return pieces[order], words[order], again

    def one_by_one(self, sym: np.ndarray) -> np.ndarray:
        """The pieces of one word, merged from a heap."""
        s, n = sym.tolist(), len(sym)
        makes = dict(zip(self.pair_key.tolist(), self.pair_made.tolist()))
        rank, after, before = self.rank.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                made = makes.get(s[i] * self.size + s[j])
                if made is not None:
                    heapq.heappush(heap, (rank[made], i, s[i], s[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = makes[a * self.size + b], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in s if x >= 0], np.int32)

    def words(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets by word) of the words that begin at start, which holds 0."""
        n = len(start)
        length = np.diff(start, append=len(sym))
        long_ = np.flatnonzero(length > LONG)
        parts: dict[int, np.ndarray] = {int(i): self.one_by_one(sym[start[i]:start[i] + length[i]]) for i in long_}
        short = np.ones(n, bool)
        short[long_] = False
        take, word = np.repeat(short, length), np.repeat(np.arange(n), length)
        pieces, words, again = self.rounds(sym[take], word[take], n)
        if again.any():
            over = np.repeat(again & short, length)
            stays = ~again[words]
            p, w, _ = self.rounds(sym[over], word[over], n, single=True)
            pieces, words = np.concatenate([pieces[stays], p]), np.concatenate([words[stays], w])
        for i, p in parts.items():
            pieces, words = np.concatenate([pieces, p]), np.concatenate([words, np.full(len(p), i)])
        if again.any() or parts:
            order = np.argsort(words, kind="stable")
            pieces, words = pieces[order], words[order]
        return pieces, np.concatenate([[0], np.cumsum(np.bincount(words, minlength=n))])

    def _slice(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets by word), each distinct word encoded once."""
        length = np.diff(start, append=len(sym))
        p = np.zeros(len(sym) + 1, U64)
        np.cumsum(mix(sym.astype(U64) + U64(1)) * powers(BASE, len(sym)), out=p[1:])
        digest = mix((p[start + length] - p[start]) * powers(BASE_INV, len(sym) + 1)[start] + length.astype(U64))
        _, first, of = np.unique(digest, return_index=True, return_inverse=True)
        same = length[first][of] == length
        if same.all():
            shift = np.repeat(start[first][of] - start, length)
            same = sym[np.arange(len(sym)) + shift] == sym
        if not same.all():  # two words with one digest
            first, of = np.arange(len(start)), np.arange(len(start))
        n = length[first]
        begin = np.cumsum(n) - n
        flat = sym[np.arange(n.sum()) + np.repeat(start[first] - begin, n)]
        pieces, at = self.words(flat, begin)
        n = np.diff(at)[of]
        ends = np.cumsum(n)
        return pieces[np.arange(ends[-1]) + np.repeat(at[:-1][of] - (ends - n), n)], np.concatenate([[0], ends])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[off[i]:off[i + 1]], without begin and end."""
        n_docs = len(off) - 1
        size = np.diff(off)
        full = np.flatnonzero(size)
        counts = np.zeros(n_docs, np.int64)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
        head = off[full] + np.arange(len(full))  # a space in front of each text
        put = np.ones(len(data) + len(full), bool)
        put[head] = False
        spaced = np.full(len(put), 0x20, np.uint8)
        spaced[put] = data
        sym, pos = self.symbols(spaced)
        cut = np.ones(len(sym), bool)
        kind = self.kind_of[sym]
        cut[1:] = ~self.beside[kind[:-1], kind[1:]]
        doc_at = np.searchsorted(pos, head)
        cut[doc_at] = True
        start = np.flatnonzero(cut)
        out, made_at, done, a = [], [], 0, 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(start, start[a] + SLICE)))
            stop = start[b] if b < len(start) else len(sym)
            ids, at = self._slice(sym[start[a]:stop], start[a:b] - start[a])
            out.append(ids)
            made_at.append(at[:-1] + done)
            done, a = done + len(ids), b
        made_at = np.concatenate([*made_at, [done]])
        bounds = made_at[np.append(np.searchsorted(start, doc_at), len(start))]
        counts[full] = np.diff(bounds)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])

    # ---- decoding -----------------------------------------------------------

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of ids[off[i]:off[i + 1]]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id outside the vocabulary")
        out = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            got: list[bytes] = []
            for c in range(a, b, SLICE):
                part = ids[c:min(b, c + SLICE)]
                n = self.spell_at[part + 1] - self.spell_at[part]
                ends = np.cumsum(n)
                got.append(self.spells[np.arange(ends[-1]) + np.repeat(self.spell_at[part] - (ends - n), n)].tobytes())
            text = b"".join(got)
            spoken = np.flatnonzero(self.kinds[ids[a:b]] != CONTROL)
            if len(spoken) and self.opens[ids[a + spoken[0]]]:
                text = text[1:]
            apart = len(spoken) and spoken[-1] - spoken[0] + 1 != len(spoken)
            try:
                if apart:
                    raise ValueError
                text.decode()
            except ValueError:
                text = self._mended(ids[a:b])
            out.append(text)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """The text of ids whose runs of byte pieces may be no characters."""
        def characters(run: bytearray) -> str:
            text, i = "", 0
            while i < len(run):
                n = 1 if run[i] < 0x80 else 2 if run[i] < 0xE0 else 3 if run[i] < 0xF0 else 4
                try:
                    text += bytes(run[i:i + n]).decode()
                except UnicodeDecodeError:
                    text, n = text + "�", 1
                i += n
            return text

        text, run, began = "", bytearray(), False
        for i in ids.tolist():
            kind, spelt = self.kinds[i], self.spells[self.spell_at[i]:self.spell_at[i + 1]].tobytes()
            if kind == BYTE:
                run += spelt
                continue
            text, run = text + characters(run), bytearray()
            if kind != CONTROL:
                text += spelt.decode()[int(not began and not text and bool(self.opens[i])):]
                began = True
        return (text + characters(run)).encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ends: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text; ids are packed as little-endian unsigned
    32-bit integers, with the begin and end ids if ``ends``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        head, tail = (np.array([x], "<u4").tobytes() if ends else b"" for x in (v.bos, v.eos))
        for batch in batches:
            ids, off = v.encode(*text_buffer(batch.column(1)))
            ids = ids.astype("<u4")
            packed = pa.array([head + ids[a:b].tobytes() + tail for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off) + 2 * ends, pa.int64()), packed], names=["doc_id", "n_tokens", "ids"])

    return map_arrow(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of packed ids; begin and end ids are silent."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            rows = [x or b"" for x in batch.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])]).astype(np.int64)
            texts = v.decode(np.frombuffer(b"".join(rows), "<u4").astype(np.int64), off)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), batch.column(1), text], names=["doc_id", "n_tokens", "ids", "text"])

    return map_arrow(encoded.select(encoded[key].cast("long").alias("doc_id"), encoded[ids].alias("ids")), run, "doc_id long, n_tokens long, ids binary, text string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
