"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than ``CHUNK`` characters is encoded in overlapping chunks with
offsets.  Neighbouring chunks are spliced at a position inside their overlap
that is a token boundary in both and is proven stable: a non-space character
followed by a space.  The proof is checked against the vocabulary when it is
loaded: if no piece holds a space mark after another character, no merge ever
crosses such a position, so both sides are encoded as in the whole text.  If an
overlap holds no such boundary it is doubled, up to the whole rest of the text.
A vocabulary without that property encodes every text whole.

Defined cases: a null text counts as empty (0 tokens); a null doc_id is passed
on; repeated rows count alike; extra columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from llm.common import map_arrow, table
from llm.kernels import text_buffer

MODEL = "piece_bpe_32k.model"
#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 50_000, 256
#: Texts that are encoded in one call.
BATCH = 128
LIMIT = 4096


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.stable_spaces = not any("▁" in p.lstrip("▁") for p in pieces)

    def boundaries(self, text: str) -> np.ndarray:
        """Character offsets at which tokens of text start, its length last."""
        proto = self.sp.encode(text, return_type="proto")
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        # byte offsets to character offsets; the pieces of one character's bytes share theirs
        char_at = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
        return char_at[[p.begin for p in proto.pieces] + [len(data)]]

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if not self.stable_spaces or len(text) <= chunk:
            return len(self.sp.encode(text))
        total, start, skip_to = 0, 0, 0  # the chunk begins at start; tokens before skip_to are counted
        while True:
            end = start + chunk
            while True:
                if end >= len(text):
                    at = self.boundaries(text[start:])
                    return total + int((at[:-1] >= skip_to - start).sum())
                cut = self._splice(text, end - overlap, end)
                if cut > skip_to:
                    break
                end, overlap = end + overlap, overlap * 2  # widen
            here = self.boundaries(text[start:end])
            nxt = max(skip_to, cut - overlap // 2, start + 1)
            follow = self.boundaries(text[nxt:min(len(text), end)])
            if cut - start not in here or cut - nxt not in follow:  # not a common boundary: widen the overlap
                if overlap > len(text):
                    return len(self.sp.encode(text))
                overlap *= 2
                chunk = max(chunk, 2 * overlap)
                continue
            total += int(((here[:-1] >= skip_to - start) & (here[:-1] < cut - start)).sum())
            start, skip_to = nxt, cut

    @staticmethod
    def _splice(text: str, low: int, high: int) -> int:
        """Last position in [low, high) of a space after a non-space, or -1."""
        at = high
        while True:
            at = text.rfind(" ", max(low, 1), at)
            if at < 0 or text[at - 1] != " ":
                return at


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            col = batch.column(1)
            _, off = text_buffer(col)
            n_bytes = np.diff(off)
            counts = np.zeros(len(n_bytes), np.int64)
            for a in range(0, len(counts), BATCH):
                texts = [t or "" for t in col.slice(a, BATCH).to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
                for i, ids in zip(short, c.sp.encode([texts[i] for i in short], num_threads=1)):
                    counts[a + i] = len(ids)
                for i, t in enumerate(texts):
                    if len(t) > CHUNK:
                        counts[a + i] = c.count_long(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(counts), pa.array(counts > LIMIT)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(
        docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
