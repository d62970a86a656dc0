"""An alphabetic index that grows with a stream, and that merges with others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glyphmill.functions import matching

#: Lanes of a bucket: one that holds most names is counted in so many tasks.
LANES = 32
SAMPLES = 3
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SAMPLE = "array<struct<key: binary, name: string>>"


class _Lane(StatefulProcessor):
    """The number of a lane's names so far and the first of them in collation order."""

    def __init__(self, samples: int) -> None:
        self.samples = samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", f"records long, first {_SAMPLE}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        records, first = 0, []
        if self.seen.exists():
            records, held = self.seen.get()
            first = [(bytes(k), name) for k, name in held]
        for frame in rows:
            records += len(frame)
            first = sorted([*first, *zip(map(bytes, frame["key"]), frame["name"], strict=True)])[: self.samples]
        self.seen.update((records, first))
        yield pd.DataFrame({"bucket": [key[0]], "lane": [key[1]], "records": [records], "first": [[{"key": k, "name": name} for k, name in first]]})

    def close(self) -> None:
        pass


def _keyed(names: DataFrame, column: str, locale: str) -> DataFrame:
    of = F.col(f"`{column}`").cast("string")
    return names.filter(of.isNotNull()).select(matching.index_bucket(of, locale).alias("bucket"), matching.sort_key(of, locale).alias("key"), of.alias("name"))


def _firsts(lanes: DataFrame, samples: int) -> DataFrame:
    """Rows of `(bucket, records, first)` added up by bucket; each has at most `samples` names, so a bucket's stay few."""
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, samples).alias("first")
    return lanes.groupBy("bucket").agg(F.sum("records").alias("records"), first)


def grow_index(names: DataFrame, path: str, checkpoint: str, column: str = "text", locale: str = "en_US", samples: int = SAMPLES, lanes: int = LANES) -> StreamingQuery:
    """Add the names that have come in a stream to the index at `path`, and stop; a restart goes on from the checkpoint.

    The state of a bucket is kept in lanes by a hash of the name: how many names it has had, and the first `samples` of them in
    collation order, equal ones by code points.  Each increment writes the lanes that it has changed, whole, so that
    `read_index` needs no others.  Names may come in any order and in any parts.  Null names are left out, repeated names count
    each time, empty ones belong to the bucket that the locale gives them.
    """
    spark = names.sparkSession
    keyed = _keyed(names, column, locale).withColumn("lane", F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int"))
    grown = keyed.groupBy("bucket", "lane").transformWithStateInPandas(_Lane(samples), f"bucket string, lane int, records long, first {_SAMPLE}", "append", "none")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)  # taken over by the query when it starts
    try:
        return grown.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def read_index(spark: SparkSession, path: str, samples: int = SAMPLES) -> DataFrame:
    """`(bucket, records, first)` of an index: the last state of each lane, lanes added up.  A lane's records only grow."""
    lanes = spark.read.schema(f"bucket string, lane int, records long, first {_SAMPLE}").parquet(path)
    last = lanes.groupBy("bucket", "lane").agg(F.max_by(F.struct("records", "first"), "records").alias("s"))
    return _firsts(last.select("bucket", "s.records", "s.first"), samples)


def index_of(names: DataFrame, column: str = "text", locale: str = "en_US", samples: int = SAMPLES, lanes: int = LANES) -> DataFrame:
    """`(bucket, records, first)` of a table of names: what a stream of them would have grown."""
    keyed = _keyed(names, column, locale).withColumn("lane", F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int"))
    counts = keyed.groupBy("bucket", "lane").agg(F.count("*").alias("records"))
    # a name has one lane, so that the first names of all lanes hold those of the bucket; equal names are counted before
    once = keyed.groupBy("bucket", "lane", "key", "name").agg(F.least(F.count("*"), F.lit(samples)).cast("int").alias("n"))
    few = once.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "lane").orderBy("key", "name"))).filter(F.col("r") <= samples)
    each = few.select("bucket", "lane", F.explode(F.array_repeat(F.struct("key", "name"), F.col("n"))).alias("one"))
    firsts = each.groupBy("bucket", "lane").agg(F.slice(F.array_sort(F.collect_list("one")), 1, samples).alias("first"))
    return _firsts(counts.join(firsts, ["bucket", "lane"]).select("bucket", "records", F.col("first").cast(_SAMPLE)), samples)


def merge_indexes(*indexes: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One index of several `(bucket, records, first)`, in whatever order; each must keep at least `samples` names."""
    all_of = indexes[0].select("bucket", "records", "first")
    for one in indexes[1:]:
        all_of = all_of.unionByName(one.select("bucket", "records", "first"))
    return _firsts(all_of, samples)


def names_of(index: DataFrame) -> DataFrame:
    """`(bucket, records, names)`: an index without the sort keys of its names."""
    return index.select("bucket", "records", F.transform("first", lambda x: x["name"]).alias("names"))
