"""Token ids as bit-packed files (operator 11).

Each id takes the fewest bits that hold the vocabulary.  A file is, little-endian:

    magic (8 bytes), bits and ids a block (uint32 each), documents, documents with a null id, ids, blocks (uint64 each),
    range of the file and its number in the range (uint32 each), 8 zero bytes
    ids of the documents (int64 each), ends of the documents among the file's ids (uint64 each)
    places of the blocks in the file and the end of the last one (uint64 each)
    blocks: groups of 64 ids in `bits` words of 64 bits each; a line feed ends the file

So ids from any place are read by the place of their block and unpacked by shifts of whole columns of groups.

Documents are encoded where they are read and sent to the range of their id.  The ranges are quantiles of the document ids; an
id that many rows share takes as many ranges as its share of the rows.  Each range writes its files; an index of them, from
their headers alone, adds up the ids before each.  Spark's text writer puts the bytes of a string into a file as they are, one
row per file, so files appear when their task commits, in any store that Spark writes to.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm import kernels
from glyphmill.llm.common import map_batches
from glyphmill.sources.scratch import new_path

MAGIC = b"GLYPACK1"
_HEADER = "<8sIIQQQQII8x"
_HEADER_BYTES = struct.calcsize(_HEADER)
#: Ids of a block, a multiple of 64, and of a file; a file only has more where a single document has.
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
#: The index of up to so many files (24 bytes each) goes to all tasks that read them; a larger one is joined by a shuffle.
BROADCAST_FILES = 100_000
#: Characters of a text that are split at a time, of a unit that is remembered, and units that a worker remembers.
SPLIT_CHARS, UNIT_CHARS, UNITS = 1 << 20, 64, 500_000

#: A blank or line feed behind a visible ASCII or a word character begins a unit, and so does a mark behind a digit or Latin
#: letter: no pre-token of a byte-level vocabulary reaches across, and what follows does not depend on what is before.
_LATIN = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
_BOUNDARY = rf"(?<=[!-~\w])(?=[ \n])|(?<=[{_LATIN}])(?=[.,;:!?])"
_CUT = re.compile(_BOUNDARY)
#: From boundary to boundary: a word, a mark, or, more slowly, anything.
_UNIT = re.compile(rf"[ \n]?[{_LATIN}]+(?![^ \n.,;:!?])|[.,;:!?](?![^ \n])|(?s:.+?)(?:{_BOUNDARY}|\Z)")
_CLOSED = re.compile(r"[ \n].*[!-~\w]", re.S)


def bits_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids, in groups of 64 (the last one filled with zeros), in `bits` words of 64 bits a group."""
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), bits), "<u8")
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= groups[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= groups[:, lane] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(packed, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of what `pack` made."""
    words = np.frombuffer(packed, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & mask
    return out.reshape(-1)[:n]


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK_IDS, at: int = 0, number: int = 0) -> bytes:
    """One file of documents in their order, those with null ids first: the `number`-th file of range `at`."""
    if block % 64:
        raise ValueError("a block holds a multiple of 64 ids")
    ends = np.cumsum([len(x) for x in ids], dtype="<u8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(flat[k : k + block], bits) for k in range(0, len(flat), block)]
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = struct.pack(_HEADER, MAGIC, bits, block, len(ids), sum(d is None for d in doc_ids), len(flat), len(blocks), at, number)
    first = len(head) + 16 * len(ids) + 8 * (len(blocks) + 1)
    places = first + np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join((head, names.tobytes(), ends.tobytes(), places.astype("<u8").tobytes(), *blocks, b"\n"))


class TokenFile:
    """A file's bytes, or a memory map of it: documents and ids from any place, of which only the blocks are unpacked."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.n_docs, self.n_null, self.n_ids, n_blocks, self.at, self.number = struct.unpack_from(_HEADER, self.data)
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        at = _HEADER_BYTES
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        self.ends = np.frombuffer(self.data, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)
        self.places = np.frombuffer(self.data, "<u8", n_blocks + 1, at + 16 * self.n_docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of the file from `start` up to `stop`."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"{start} to {stop} of {self.n_ids} ids")
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        found = unpack(self.data[self.places[first] : self.places[last + 1]], self.bits, n)
        return found[start - first * self.block : stop - first * self.block]

    def bounds(self, k: int) -> tuple[int, int]:
        return int(self.ends[k - 1]) if k else 0, int(self.ends[k])

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, its end id included."""
        return self.ids(*self.bounds(k))


class UnitEncoder:
    """The library's ids of whole texts: units between safe boundaries are encoded once and remembered as bytes."""

    def __init__(self, model: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bits = bits_for(max(*vocabulary.values(), end_id))
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, number in vocabulary.items():
            self.lengths[number] = len(piece)  # a character of a byte-level piece is a byte
        self.width = "<u2" if self.bits <= 16 else "<u4"
        self.end = np.array([end_id], self.width).tobytes()
        self.known: dict[str, bytes] = {}  # of late
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units: those with a safe boundary on both sides in one text, cut by the bytes that pieces stand for."""
        closed = [u for u in units if _CLOSED.fullmatch(u)]
        found: dict[str, bytes] = {}
        if closed:
            flat = np.array(self.library.encode_batch_fast(["".join(closed)], add_special_tokens=False)[0].ids, self.width)
            behind = np.cumsum(self.lengths[flat])
            ends = np.cumsum([len(u.encode()) for u in closed])
            cuts = np.searchsorted(behind, ends) + 1
            if len(behind) and behind[-1] == ends[-1] and np.array_equal(behind[cuts - 1], ends):
                data, bounds = flat.tobytes(), [0, *(flat.itemsize * cuts).tolist()]
                found = {u: data[bounds[k] : bounds[k + 1]] for k, u in enumerate(closed)}
        rest = [u for u in units if u not in found]
        found.update(zip(rest, self._library(rest), strict=True))
        return found

    def _parts(self, text: str) -> Iterator[list[str]]:
        begin = 0
        while len(text) - begin > SPLIT_CHARS:
            cut = _CUT.search(text, begin + SPLIT_CHARS)
            if not cut:
                break
            yield _UNIT.findall(text[begin : cut.start()])
            begin = cut.start()
        yield _UNIT.findall(text[begin:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as numbers of `width`."""
        parts = [list(self._parts(t)) if t else [] for t in texts]
        if len(self.known) > UNITS // 2:
            self.known, self.older = {}, self.known
        found = [[list(map(self.known.get, units)) for units in text] for text in parts]
        missing = [[[k for k, x in enumerate(got) if x is None] if None in got else [] for got in text] for text in found]
        new = {units[k] for text, gaps in zip(parts, missing, strict=True) for units, at in zip(text, gaps, strict=True) for k in at}
        made = {u: self.older[u] for u in new if u in self.older}
        new.difference_update(made)
        long = [u for u in new if len(u) > UNIT_CHARS]
        made.update(self._learn([u for u in new if len(u) <= UNIT_CHARS]))
        self.known.update(made)
        made.update(zip(long, self._library(long), strict=True))
        for text, got, gaps in zip(parts, found, missing, strict=True):
            for units, ids, at in zip(text, got, gaps, strict=True):
                for k in at:
                    ids[k] = made[units[k]]
        return [b"".join(map(b"".join, text)) + self.end for text in found]


@lru_cache(maxsize=2)
def _encoder(model: str, end_id: int) -> UnitEncoder:
    return UnitEncoder(model, end_id)


def _ranges(rows: DataFrame, parts: int) -> tuple[int, np.ndarray]:
    """Ranges for null ids, and the quantiles that bound the other ranges."""
    probs = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    found = rows.agg(F.count("*").alias("n"), F.count("id").alias("some"), F.percentile_approx("id", probs, F.lit(max(10_000, 20 * parts))).alias("q")).first()
    nulls = -(-parts * (found.n - found.some) // found.n) if found.n else 0
    return nulls, np.array(found.q if parts > 1 and found.q else [], np.int64)


def write_token_files(docs: DataFrame, path: str, model: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK_IDS, parts: int | None = None) -> None:
    """Encode whole texts with the byte-level vocabulary `model` (the text of its file), append `end_id` to each, and write
    files of about `file_ids` ids to the folder `path`/files, ascending by document id, and their index to `path`/index.

    Null and empty texts have the end id alone; rows with a null id come first; rows that share an id are all there, in an
    order of their own; a document is never split, so one of more ids than `file_ids` has a file of that size; other columns
    are ignored; an empty table writes no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nulls, bounds = _ranges(rows, parts)
    sent = spark.sparkContext.broadcast(model)

    def encoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, end_id)
        texts = kernels.plain(batch.column(1))
        tie = kernels.mix(batch.column(2).to_numpy().astype(np.uint64)).view(np.int64)
        spread = (tie.view(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        low, high = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, side="right")
        at = np.where(missing, np.floor(spread * max(1, nulls)), nulls + low + np.floor(spread * (high - low + 1)))
        order = (tie.view(np.uint64) >> np.uint64(1)).view(np.int64)
        for start, stop in kernels.runs(texts):
            made = encoder.encode(texts[start:stop].to_pylist())
            cols = [pa.array(at[start:stop].astype(np.int32)), batch.column(0)[start:stop], pa.array(order[start:stop]), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["at", "id", "tie", "ids"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, end_id)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = number = 0
        of = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_bytes(names, held, encoder.bits, block, of, number)], pa.binary())], ["file"])

        for batch in batches:
            for at, name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), encoder.width)
                if held and (at != of or size + len(ids) > file_ids):
                    yield made()
                    names, held, size, number = [], [], 0, number + 1
                if at != of:
                    of, number = at, 0
                names.append(name)
                held.append(ids.copy())
                size += len(ids)
        if held:
            yield made()

    made = map_batches(rows, encoded, "at int, id long, tie long, ids binary")
    dealt = made.repartitionById(nulls + len(bounds) + 1, "at").sortWithinPartitions("at", F.col("id").asc_nulls_first(), "tie").select("at", "id", "ids")
    dealt.mapInArrow(files, "file binary").select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    _index(spark, path).write.parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/files")


def _index(spark: SparkSession, path: str) -> DataFrame:
    """`(file, at, number, n_docs, n_ids, start)` of each file; `start` ids are in the files before it."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack(_HEADER, x) for x in batch.column(1).to_pylist()]
            cols = [batch.column(0), *(pa.array([h[k] for h in found], pa.int64()) for k in (7, 8, 3, 5))]
            yield pa.RecordBatch.from_arrays(cols, ["file", "at", "number", "n_docs", "n_ids"])

    heads = _stored(spark, path).select("path", F.substring("content", 1, _HEADER_BYTES).alias("head"))
    found = heads.mapInArrow(headers, "file string, at long, number long, n_docs long, n_ids long")
    behind = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = found.groupBy("at").agg(F.sum("n_ids").alias("n_ids")).select("at", behind(Window.orderBy("at")).alias("before"))  # a row per range
    own = found.withColumn("own", behind(Window.partitionBy("at").orderBy("number")))
    return own.join(ranges, "at").select("file", "at", "number", "n_docs", "n_ids", (F.col("before") + F.col("own")).alias("start"))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document of the files in `path`: `(id_col, start, n_tokens, ids_crc32, ids)`.

    `start` counts the ids of all documents before it; `ids_crc32` is taken of the ids as 32-bit numbers; without `with_ids`
    the ids stay behind.  A folder without files gives no rows.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = TokenFile(data.as_buffer())
                first = 0
                while first < found.n_docs:  # documents of about a block at a time
                    begin = found.bounds(first)[0]
                    last = max(first + 1, int(np.searchsorted(found.ends, begin + found.block, side="right")))
                    ids, ends = found.ids(begin, found.bounds(last - 1)[1]), found.ends[first:last] - begin
                    begins = np.concatenate(([0], ends[:-1]))
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    names = pa.array(found.doc_ids[first:last], mask=np.arange(first, last) < found.n_null)
                    places = (np.full(last - first, x, np.int64) for x in (found.at, found.number))
                    cols = [*map(pa.array, places), names, pa.array(begins + begin), pa.array(ends - begins), pa.array(crcs, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, ["at", "number", "id", "own", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    first = last

    more = (", ids array<long>", ["ids"]) if with_ids else ("", [])
    found = _stored(spark, path).select("content").mapInArrow(documents, "at long, number long, id long, own long, n_tokens long, ids_crc32 long" + more[0])
    index = spark.read.parquet(f"{path}/index").select("at", "number", F.col("start").alias("before"))
    if index.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        index = F.broadcast(index)
    placed = found.join(index, ["at", "number"])
    return placed.select(F.col("id").alias(id_col), (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *more[1])


def token_files(docs: DataFrame, model: str, end_id: int) -> DataFrame:
    """Write the files of `docs` to a new folder in the shared one, and read their documents back without the ids."""
    path = new_path(docs.sparkSession)
    write_token_files(docs, path, model, end_id)
    return read_token_files(docs.sparkSession, path, with_ids=False)
