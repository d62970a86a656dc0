"""Text in, and JSON, TSV or sectioned text out."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import ordering
from glyphmill.sources.scratch import drop_table, new_path


def read_lines(spark: SparkSession, path: str, skip_empty: bool = True) -> DataFrame:
    """One row `(text)` for each line."""
    lines = spark.read.text(path).select(F.col("value").alias("text"))
    return lines.filter(F.length("text") > 0) if skip_empty else lines


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row `(text)` for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files that arrive in a folder, as a stream."""
    return spark.readStream.text(path).select(F.col("value").alias("text")).filter(F.length("text") > 0)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines that a socket sends, as a stream `(text, timestamp)` with the time at which each came.

    A socket cannot send its lines again: a query that must go on after a failure reads `spool`ed lines.
    """
    lines = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return lines.select(F.col("value").alias("text"), "timestamp").filter(F.length("text") > 0)


def in_batches(lines: Iterable[str], most: int = 50_000, seconds: float = 1.0) -> Iterator[list[str]]:
    """Lines in lists of at most `most`, each given out `seconds` after its first line at the latest; empty lines are left out.

    A thread reads ahead by at most one list, so an input without end is read in bounded memory.
    """
    ahead: queue.Queue = queue.Queue(maxsize=most)
    end = object()

    def read() -> None:
        try:
            for line in lines:
                if line := line.rstrip("\n"):
                    ahead.put(line)
            ahead.put(end)
        except BaseException as e:  # raised again where the lines are taken
            ahead.put(e)

    threading.Thread(target=read, daemon=True).start()
    while True:
        held = [ahead.get()]
        due = time.monotonic() + seconds
        while held[-1] is not end and not isinstance(held[-1], BaseException) and len(held) < most:
            try:
                held.append(ahead.get(timeout=max(0.0, due - time.monotonic())))
            except queue.Empty:
                break
        last = held[-1]
        if last is end or isinstance(last, BaseException):
            if held[:-1]:
                yield held[:-1]
            if isinstance(last, BaseException):
                raise last
            return
        yield held


def spool(spark: SparkSession, lines: Iterable[str], path: str | None = None, most: int = 50_000, seconds: float = 1.0) -> str:
    """Lines of an input that cannot be read twice, such as stdin, as Parquet files `(n, text)` of a folder; its path.

    Each list of lines is committed as a file as it comes, numbered from 0, so the driver never holds the input and a stream
    that reads the folder (`stream_spool`) sees lines while others are still to come.  Without a `path` a new folder in the
    shared one is taken.  An input without lines gives an empty table.
    """
    path = path or new_path(spark)
    kind, n = "n long, text string", 0
    spark.createDataFrame([], kind).write.mode("append").parquet(path)
    for held in in_batches(lines, most, seconds):
        spark.createDataFrame([(n + k, x) for k, x in enumerate(held)], kind).coalesce(1).write.mode("append").parquet(path)
        n += len(held)
    return path


def stream_spool(spark: SparkSession, path: str) -> DataFrame:
    """The lines `(n, text)` of a `spool`, as a stream; a restart goes on after those it has seen."""
    return spark.readStream.schema("n long, text string").parquet(path)


def tsv_cell(column: Column, kind: str) -> Column:
    """A cell's text: `-` for null, empty text and empty list, yes or no, lists joined by commas."""
    if kind == "boolean":
        return F.coalesce(F.when(column, F.lit("yes")).otherwise(F.when(~column, F.lit("no"))), F.lit("-"))
    if kind.startswith("array"):
        return F.coalesce(F.nullif(F.array_join(column.cast("array<string>"), ","), F.lit("")), F.lit("-"))
    shown = F.to_json(column) if kind.startswith(("struct", "map")) else column.cast("string")
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("-"))


def as_tsv(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row `(line)` for each row, of all columns or of some in their order."""
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws("\t", *[tsv_cell(F.col(f"`{n}`"), kinds[n]) for n in columns or df.columns]).alias("line"))


def tsv_header(df: DataFrame, columns: list[str] | None = None) -> str:
    return "\t".join(columns or df.columns)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def as_sections(df: DataFrame, group: str, item: str) -> DataFrame:
    """One row `(line)` for each group: its heading, then its items, one in a line.  For groups of any size see `section_lines`."""
    listed = df.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(F.col(item).cast("string"))), "\n").alias("items"))
    return listed.select(F.concat_ws("\n", F.concat(F.col(group).cast("string"), F.lit(":")), F.col("items")).alias("line"))


def _headed(df: DataFrame, group: str, item: str, indent: str) -> DataFrame:
    """`(g, at, line)`: items with their place in their group, the first of each under the heading."""
    of, it = F.col(f"`{group}`").cast("string"), F.col(f"`{item}`").cast("string")
    at = ordering.placed(df.select(of.alias("g"), it.alias("i")), "i", within=("g",), name="at")
    heading = F.when(F.col("at") == 1, F.concat(F.coalesce("g", F.lit("")), F.lit(":\n"))).otherwise("")
    out = at.select("g", "at", F.concat(heading, F.lit(indent), F.coalesce("i", F.lit(""))).alias("line"))
    out._glyphmill_under = (at,)
    return out


def section_lines(df: DataFrame, group: str, item: str, indent: str = "") -> DataFrame:
    """`(place, line)`: groups in order, each under its heading, its items in order with `indent` before them.

    A heading stands in the row of its group's first item, so a group is never gathered: rows are dealt by ranges of group
    and item, a large group spans partitions, and which row is its first follows from counts of partitions.  `place` counts
    rows from 1.  Null groups come first under an empty heading, null items first as empty lines.
    """
    headed = _headed(df, group, item, indent)
    out = ordering.placed(headed, "g", "at", name="place")
    lines = out.select("place", "line")
    lines._glyphmill_under = (headed, out)
    return lines


def write_sections(df: DataFrame, path: str, group: str, item: str, indent: str = "") -> None:
    """The lines of `section_lines` as text files whose names ascend in their order; no task holds more than its range."""
    headed = _headed(df, group, item, indent)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = headed.repartitionByRange(parts, "g", "at").sortWithinPartitions("g", "at")
    rows.select("line").write.mode("overwrite").text(path)
    drop_table(headed)


def flatten_extended(df: DataFrame, column: str = "extended") -> DataFrame:
    """The fields of a nested column beside the others."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
