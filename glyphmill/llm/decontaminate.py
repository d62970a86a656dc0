"""Benchmark decontamination by size-partitioned MinHash containment (operator 6).

Items are partitioned by the power of two of their shingle count.  A partition with sizes up to m keeps, per item, the
m - ceil(t m) + 1 smallest shingle hashes: a bottom-k MinHash sketch of which at least one value lies in any document
that holds a share t of the item's shingles.  So a document of any length is a candidate when one of its shingle
hashes hits a sketch, and the search misses nothing.  Candidates are verified by exact shingle containment.

Items of up to BLOCK_SHINGLES shingles are broadcast, and documents are only scanned.  More items stay a table: one scan of
the documents keeps the shingles that have their bit in a map of fixed size, and these are joined with the items'; pairs
that hit a sketch are verified by their number of shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import kernels
from glyphmill.llm.common import bit_map, drop_table, map_batches, write_table

#: Shingles of the items that are broadcast: 8 MB in a task.
BLOCK_SHINGLES = 1_000_000
#: Size of the bit map by which documents are searched for shingles of more items (8 MB, whatever the items).
BITS = 1 << 26
SCHEMA = "doc long, item long, n_item long, n_shared long"


def _sketch_length(n: int, num: int, den: int) -> int:
    largest = (1 << n.bit_length()) - 1
    return min(n, largest - -(-largest * num // den) + 1)


def _item_sets(size: int, num: int, den: int):
    """(id, text) to (item, width, n, k, hashes), the first k of them the sketch: items of fewer words than `size` are one
    window of their own width."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = kernels.plain(batch.column(1))
        words, firsts = kernels.word_hashes(texts)
        width = np.minimum(np.diff(firsts), size)
        hashes, offsets = kernels.distinct_sorted(*kernels.shingle_hashes(words, firsts, size))
        n = np.diff(offsets)
        k = np.array([_sketch_length(x, num, den) for x in n.tolist()], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width.astype(np.int32)), pa.array(n), pa.array(k), lists], ["item", "width", "n_item", "k", "hashes"])

    return fn


class _Block:
    """A block of items: sketches by window width, and whole sets."""

    def __init__(self, items: list[tuple[int | None, int, np.ndarray]], num: int, den: int):
        self.ids = [i for i, _, _ in items]
        self.sets = [h for _, _, h in items]
        self.need = [-(-len(h) * num // den) for h in self.sets]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {w for _, w, _ in items}:
            values, owners = [], []
            for k, (_, w, h) in enumerate(items):
                if w == width:
                    sketch = h[: _sketch_length(len(h), num, den)]
                    values.append(sketch)
                    owners.append(np.full(len(sketch), k))
            value, owner = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[(value & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.by_width[width] = (value, owner, maybe)

    def search(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of all texts that hold enough of an item."""
        for width, (value, owner, maybe) in self.by_width.items():
            hashes, offsets = kernels.shingle_hashes(words, firsts, width, short_whole=False)
            at = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            if not len(at):
                continue
            low = np.searchsorted(value, hashes[at], side="left")
            high = np.searchsorted(value, hashes[at], side="right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            text = np.searchsorted(offsets, at, side="right") - 1
            candidates = {(int(t), int(k)) for t, a, b in zip(text, low, high, strict=True) for k in owner[a:b]}
            last, whole = -1, None
            for t, k in sorted(candidates):
                if t != last:
                    last, whole = t, np.unique(hashes[offsets[t] : offsets[t + 1]])
                place = np.minimum(np.searchsorted(whole, self.sets[k]), len(whole) - 1)
                shared = int((whole[place] == self.sets[k]).sum())
                if shared >= self.need[k]:
                    yield t, k, shared


def _items(items: DataFrame, item_col: str, text_col: str, size: int, num: int, den: int) -> tuple[DataFrame, _Block | None]:
    """The items' sets as a written table, and on the driver where they are few."""
    items = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = map_batches(items, _item_sets(size, num, den), "item long, width int, n_item long, k int, hashes array<long>").filter("width > 0")
    sets = write_table(sets.withColumn("uid", F.monotonically_increasing_id()))
    if (sets.agg(F.sum("n_item")).first()[0] or 0) > BLOCK_SHINGLES:
        return sets, None
    found = sets.select("item", "width", "hashes").toArrow().to_pylist()
    drop_table(sets)
    return sets, _Block([(r["item"], r["width"], np.array(r["hashes"], dtype=np.int64).view(np.uint64)) for r in found], num, den)


#: A text's key: contamination is a matter of the text alone.
KEYS = ("key_a", "key_b")


def _keyed(text: str) -> list:
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(value).alias(KEYS[0]), F.xxhash64(F.lit(1), value).alias(KEYS[1])]


def _joined(docs: DataFrame, text_col: str, sets: DataFrame, num: int, den: int) -> DataFrame:
    """`(key_a, key_b, item, n_item, n_shared)` of the texts that hold enough of an item, without any side on the driver."""
    values = sets.select("uid", "item", "n_item", "width", "k", F.posexplode("hashes").alias("place", "value"))
    bits = bit_map(sets.select(F.explode("hashes").alias("value")), "value", BITS)
    widths = [r.width for r in sets.select("width").distinct().collect()]
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(keys, text) to the distinct windows of each width that have their bit."""
        texts = kernels.plain(batch.column(2))
        keys = [batch.column(k).to_numpy() for k in range(2)]
        for start, stop in kernels.runs(texts):
            words = kernels.word_hashes(texts[start:stop])
            for width in widths:
                hashes, offsets = kernels.distinct_sorted(*kernels.shingle_hashes(*words, width, short_whole=False))
                low = hashes & np.uint64(BITS - 1)
                hits = np.flatnonzero(sent.value[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))
                owner = start + np.searchsorted(offsets, hits, side="right") - 1
                cols = [pa.array(k[owner]) for k in keys] + [pa.array(np.full(len(hits), width, np.int32)), pa.array(hashes[hits].view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, [*KEYS, "width", "value"])

    rows = docs.select(*_keyed(text_col), F.col(text_col).cast("string").alias("text"))
    hits = map_batches(rows, fn, "key_a long, key_b long, width int, value long").distinct()
    shared = hits.join(values, ["width", "value"]).groupBy(*KEYS, "uid", "item", "n_item").agg(F.count("*").alias("n_shared"), F.max(F.col("place") < F.col("k")).alias("sketched"))
    return write_table(shared.filter(F.col("sketched") & (F.col("n_shared") * den >= F.col("n_item") * num)).select(*KEYS, "item", "n_item", "n_shared"))


def _found(docs: DataFrame, block: _Block) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), kernels.plain(batch.column(1))
        rows = []
        for start, stop in kernels.runs(texts):
            for t, k, shared in sent.value.search(*kernels.word_hashes(texts[start:stop])):
                rows.append((ids[start + t].as_py(), sent.value.ids[k], len(sent.value.sets[k]), shared))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc", "item", "n_item", "n_shared"])

    return map_batches(docs, fn, SCHEMA)


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, num: int = 80, den: int = 100,
) -> DataFrame:
    """`(id_col, item_col, n_item, n_shared)`: documents that hold at least num/den of an item's distinct shingles.

    One row per pair of a document row and an item row; a null id stays null.  Null, empty and wordless texts on either
    side give no row; an item of fewer words than `size` must stand in the document as one run of words.  Extra columns
    are ignored; empty tables give an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets, block = _items(items, item_col, item_text_col, size, num, den)
    if block:
        out = _found(docs, block)
    else:
        pairs = _joined(docs, "text", sets, num, den)
        drop_table(sets)
        out = docs.select(F.col("id").alias("doc"), *_keyed("text")).join(pairs, list(KEYS))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of `docs`, all columns as they were, that hold no item (see `contained_items`).

    Null, empty and wordless texts hold none and stay; repeated rows stay or go together; null ids and further columns,
    whatever their names, are kept as they are; with an empty table of items all rows stay.
    """
    sets, block = _items(items, item_col, item_text_col, size, num, den)
    if not block:
        pairs = _joined(docs, text_col, sets, num, den).select(*[F.col(k).alias(f"glyphmill_{k}") for k in KEYS]).distinct()
        drop_table(sets)
        a, b = _keyed(text_col)
        return docs.join(pairs, (a == pairs[f"glyphmill_{KEYS[0]}"]) & (b == pairs[f"glyphmill_{KEYS[1]}"]), "left_anti")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = kernels.plain(batch.column(at))
        keep = np.ones(len(texts), dtype=bool)
        for start, stop in kernels.runs(texts):
            for t, _, _ in sent.value.search(*kernels.word_hashes(texts[start:stop])):
                keep[start + t] = False
        yield batch.filter(pa.array(keep))

    return map_batches(docs, fn, docs.schema)
