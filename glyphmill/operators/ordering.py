"""Places in an order over tables of any size: rows are dealt by range, so that equal keys may span partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.sources.scratch import write_table

#: Up to so many (partition, group) pairs, of 40 bytes or so, are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

_AT, _TIE, _ROW = "glyphmill_at", "glyphmill_tie", "glyphmill_row"


def _order(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def dealt(df: DataFrame, *keys: Column | str, parts: int | None = None) -> DataFrame:
    """The table, written in the order of `keys`, with `glyphmill_at`: partition << 33 | row in the partition.

    Spark samples the keys for the ranges.  A hash of the whole row and its number in its input file follow the keys in
    the order, so a key that many rows share, even whole rows that repeat, is spread over as many partitions as its share
    of the table asks for.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    keyed = df.withColumn(_TIE, F.xxhash64(*hashed)).withColumn(_ROW, F.monotonically_increasing_id())
    order = [*_order(keys), F.col(_TIE), F.col(_ROW)]
    rows = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return write_table(rows.withColumn(_AT, F.monotonically_increasing_id()).drop(_TIE, _ROW))


def placed(df: DataFrame, *keys: Column | str, within: tuple[str, ...] = (), name: str = "place", total: str | None = None, parts: int | None = None) -> DataFrame:
    """The table with each row's place, from 1, in the order of `keys`; with `within`, in its group of equal columns.

    `total` names a further column for the number of rows of the group.

    No window runs over the rows: a place is the row's number in its partition plus the rows of its group in the partitions
    before it.  Those are counted per partition and group, and added up per group over at most `parts` numbers.  Nulls come
    first (or where a key's sort order says), equal keys in an order of their own; a column named like `name` is replaced; an
    empty table stays empty.  Runs when it is called, as the ranges must not change between counting and placing.
    """
    df = df.drop(name, *([total] if total else []))
    rows = dealt(df, *within, *keys, parts=parts)
    part = F.shiftright(F.col(_AT), 33).alias("glyphmill_part")
    groups = rows.groupBy(part, *within).agg(F.count("*").alias("glyphmill_n"), F.min(_AT).alias("glyphmill_first"))
    # without `within` this window is over one row per partition
    ahead = Window.partitionBy(*within).orderBy("glyphmill_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("glyphmill_n").over(Window.partitionBy(*within))
    groups = write_table(groups.withColumns({"glyphmill_ahead": F.coalesce(F.sum("glyphmill_n").over(ahead), F.lit(0)), "glyphmill_total": whole}))
    starts = groups.select(
        F.col("glyphmill_part").alias("glyphmill_of"),
        *[F.col(f"`{c}`").alias(f"glyphmill_of_{k}") for k, c in enumerate(within)],
        (F.col("glyphmill_ahead") - F.col("glyphmill_first") + 1).alias("glyphmill_shift"),
        "glyphmill_total",
    )
    if not within or starts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        starts = F.broadcast(starts)
    same = F.shiftright(F.col(_AT), 33) == F.col("glyphmill_of")
    for k, c in enumerate(within):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"glyphmill_of_{k}"))
    more = [F.col("glyphmill_total").alias(total)] if total else []
    out = rows.join(starts, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(_AT) + F.col("glyphmill_shift")).alias(name), *more)
    out._glyphmill_under = (rows, groups)
    return out


def densely_placed(df: DataFrame, key: str, name: str = "place", parts: int | None = None) -> DataFrame:
    """The table with the place of its key among the distinct keys, from 1 without gaps; nulls have the first."""
    df = df.drop(name)
    keys = placed(df.select(F.col(f"`{key}`").alias("glyphmill_key")).distinct(), "glyphmill_key", name="glyphmill_place", parts=parts)
    out = df.join(keys, F.col(f"`{key}`").eqNullSafe(F.col("glyphmill_key")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("glyphmill_place").alias(name))
