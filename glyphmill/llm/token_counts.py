"""Token counts with overlap resynchronisation for huge documents (operator 5).

Texts up to a chunk are encoded as they are.  A longer text is encoded in overlapping chunks with offsets.  A position is
proven stable when no piece of the vocabulary holds the two characters on its sides next to each other: no merge of any
context can cross it, so what lies left of it and what lies right of it are encoded alike in every chunk that holds both
characters.  Two neighbours are aligned in their overlap: between its first and its last stable position both must report
the same pieces with the same ends, and there they are spliced.  Where that fails the overlap is widened, first to the
left; where the left chunk has no stable position to widen to, up to the next one behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import kernels
from glyphmill.llm.common import map_batches

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
TOKEN_LIMIT = 4096

#: The piece vocabulary's mark for a space.
SPACE = "▁"


class ChunkedEncoder:
    """Encodes whole texts with a piece model, long ones in chunks."""

    def __init__(self, model: bytes, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        pieces = [p.id_to_piece(k) for k in range(p.get_piece_size())]
        self.inner = np.unique(np.array([ord(a) << 21 | ord(b) for x in pieces for a, b in zip(x, x[1:], strict=False)], dtype=np.int64))
        #: Characters of each piece; of a character in bytes, its first one counts.
        self.chars = np.array([int(not 0x80 <= int(x[3:-1], 16) <= 0xBF) if p.is_byte(k) else len(x) for k, x in enumerate(pieces)])

    def stable(self, text: str, begin: int, end: int) -> np.ndarray:
        """Positions between `begin` and `end`, both left out, that no piece of any encoding can cover."""
        points = np.frombuffer(text[begin:end].replace(" ", SPACE).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.inner, pairs), len(self.inner) - 1)
        return begin + 1 + np.flatnonzero(self.inner[at] != pairs)

    def _encode(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the text positions at which its pieces end (the encoder puts a space before a text)."""
        part = text[begin:end]
        ids = np.array(self.processor.encode(part), dtype=np.int64)
        ends = np.cumsum(self.chars[ids]) - 1
        if len(ids) and ends[-1] != len(part):  # a model that rewrites texts: the library's own offsets
            found = self.processor.encode(part, return_type="proto")
            ids, ends = np.array([x.id for x in found.pieces], dtype=np.int64), np.cumsum([len(x.surface) for x in found.pieces])
        return ids, begin + ends

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk:
            return self.processor.encode(text)
        out: list[np.ndarray] = []
        done, begin, end = 0, 0, self.chunk  # pieces up to `done` are out; the left chunk is from `begin` to `end`
        left = self._encode(text, begin, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(done, end - overlap)
                places = self.stable(text, start, end)
                if len(places):
                    stop = min(len(text), end + max(1, self.chunk - overlap))
                    right = self._encode(text, start, stop)
                    if self._aligned(left, right, int(places[0]), int(places[-1])):
                        break
                self.widened += 1
                overlap *= 2
                if start == done:  # the left chunk has nothing more to overlap with
                    end = self._behind(text, end)
                    left = self._encode(text, begin, end)
                    overlap = self.overlap
                    if end == len(text):
                        break
            if end == len(text):
                break
            cut = int(places[-1])
            out.append(self._between(left, done, cut)[0])
            done, begin, end, left = cut, start, stop, right
        out.append(self._between(left, done, len(text))[0])
        return np.concatenate(out).tolist()

    def _behind(self, text: str, end: int) -> int:
        """Where a chunk to `end` that has no stable position may end instead: some way behind the next one."""
        start, step = end - 1, self.chunk
        while start < len(text) - 1:
            places = self.stable(text, start, min(len(text), start + step))
            if len(places):
                return min(len(text), int(places[0]) + self.overlap)
            start, step = min(len(text), start + step) - 1, 2 * step
        return len(text)

    @staticmethod
    def _between(chunk: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a chunk that end behind `start` and up to `stop`."""
        ids, ends = chunk
        a, b = np.searchsorted(ends, (start, stop), side="right") if start else (0, np.searchsorted(ends, stop, side="right"))
        return ids[a:b], ends[a:b]

    def _aligned(self, left, right, first: int, last: int) -> bool:
        """Whether both chunks end a piece at both positions and have the same pieces between."""
        for at in (first, last):
            for _, ends in (left, right):
                k = np.searchsorted(ends, at)
                if k == len(ends) or ends[k] != at:
                    return False
        return all(np.array_equal(x, y) for x, y in zip(self._between(left, first, last), self._between(right, first, last), strict=True))


@lru_cache(maxsize=2)
def _encoder(model: bytes, chunk: int, overlap: int) -> ChunkedEncoder:
    return ChunkedEncoder(model, chunk, overlap)


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of `docs`: `(id_col, n_bytes, n_tokens, over_limit)` for the piece model in `model` (its bytes).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; a null id stays null; extra columns
    are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, chunk, overlap)
        texts = kernels.plain(batch.column(1))
        for start, stop in kernels.runs(texts):
            part = texts[start:stop]
            n_bytes = np.diff(kernels.buffer(part)[1])
            values = part.to_pylist()
            short = [k for k, t in enumerate(values) if len(t) <= chunk]
            counts = np.zeros(len(values), dtype=np.int64)
            counts[short] = [len(x) for x in encoder.processor.encode([values[k] for k in short], num_threads=1)]
            for k in set(range(len(values))) - set(short):
                counts[k] = len(encoder.encode(values[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(n_bytes), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = map_batches(rows, fn, "id long, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
