"""Helpers shared by the operators: durable intermediate tables, Arrow maps, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.sources.scratch import drop_table, shared_dir, write_table

__all__ = ["ASCII_UPPER", "BATCH_ROWS", "bit_map", "bucket_of", "components", "drop_table", "map_batches", "shared_dir", "write_table"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows and bytes of an Arrow batch at most (a single row may have more bytes); a worker and the executor's buffers hold a few
#: batches at a time.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` over single batches of at most BATCH_ROWS rows and BATCH_BYTES (settings of the session that are lowered if
    they are more)."""
    conf = df.sparkSession.conf
    for setting, most in _LIMITS.items():
        found = conf.get(setting).lower()
        if not (found.rstrip("b").isdigit() and 0 < int(found.rstrip("b")) <= most):
            conf.set(setting, most)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(each, schema)


def bit_map(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit map of the low bits of a column of hashes, as 64-bit words: a value without its bit is none of them."""
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    found = rows.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def bucket_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod` (null ids: bucket 0)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod)), F.lit(0)).cast("int")


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links(a, b)`: returns `(node, label)` with the smallest node of each component.

    Minimum labels with pointer jumping; every round is written to the shared folder, so no lineage piles up and
    nothing is collected.
    """
    edges = write_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = write_table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        low = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("hop"))
        new = write_table(
            low.join(hop, "low", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("hop", "low")).alias("label"))
        )
        changed = new.filter("old <> label").limit(1).count()
        drop_table(labels)
        labels, before = new.select("node", "label"), new
        labels._glyphmill_path = before._glyphmill_path
        if not changed:
            drop_table(edges)
            return labels
