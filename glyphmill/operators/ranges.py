"""Points in ranges: an interval join as an equi-join on aligned blocks, and the tables of code point ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text
from glyphmill.sources.scratch import write_table

#: A block of each size from 1 to this power of two may cover a part of a range.
LEVELS = 62


def _covered(low: Column, high: Column) -> Column:
    """The aligned blocks `(level, block)` that make up a range, two a level at most, from its ends to its middle."""
    start = F.struct(low.alias("a"), (high + 1).alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        left, right = (a < b) & (a % 2 != 0), (a < b) & (b % 2 != 0)
        one = lambda block: F.array(F.struct(level.cast("int").alias("level"), block.alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        out = F.concat(acc["out"], F.when(left, one(a)).otherwise(none), F.when(right & (b - 1 >= a + left.cast("long")), one(b - 1)).otherwise(none))
        halved = lambda x: F.shiftright(x, 1)
        return F.struct(halved(a + 1).alias("a"), halved(b).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda acc: acc["out"])


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Points with the ranges `low` to `high`, both included, that hold them: the columns of both tables.

    A range is split into its aligned blocks of a power of two, at most two of each size; a point lies in one block of each
    size that occurs.  So the join is an equi-join on size and block, no range is compared with a point outside it, wide
    ranges take no more than some dozens of rows, and neither side is sent whole to a task.  Numbers are 64-bit and below 2 ** 62 in size.  Ranges with a null end, or that end before they begin, hold nothing, null
    points are in none; overlapping and repeated ranges each give a row; columns of both tables must have different names.
    """
    names = [F.col(f"`{c}`") for c in ranges.columns]
    real = ranges.filter(F.col(f"`{low}`") <= F.col(f"`{high}`"))
    shift = F.lit(1 << 62)  # so that numbers below zero have blocks too
    blocks = real.select(*names, F.inline(_covered(F.col(f"`{low}`").cast("long") + shift, F.col(f"`{high}`").cast("long") + shift))).withColumnsRenamed({"level": "glyphmill_level", "block": "glyphmill_block"})
    blocks = write_table(blocks)
    used = [r[0] for r in blocks.select("glyphmill_level").distinct().collect()]  # at most LEVELS + 1 numbers
    at = F.col(f"`{point}`").cast("long") + shift
    own = F.array(*[F.struct(F.lit(k).alias("glyphmill_level"), F.shiftright(at, k).alias("glyphmill_block")) for k in sorted(used)] or [F.struct(F.lit(-1).alias("glyphmill_level"), at.alias("glyphmill_block"))])
    found = points.select(*[F.col(f"`{c}`") for c in points.columns], F.inline(own)).join(blocks, ["glyphmill_level", "glyphmill_block"])
    return found.drop("glyphmill_level", "glyphmill_block")


def code_points(spark: SparkSession) -> DataFrame:
    """`(code_point, char)` of all code points but surrogates, which no text holds."""
    # behind a byte order mark, as U+FEFF would be taken for one itself
    ids = spark.range(0x110000).filter("id < 55296 or id > 57343")
    return ids.select(F.col("id").alias("code_point"), F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32").alias("char"))


def property_ranges(spark: SparkSession, **properties: Column) -> DataFrame:
    """`(first, last)` of the ranges of code points that agree in all `properties`, made of the column `char`, with these.

    Ranges end at multiples of 4,096, so that they are found in tasks of that many code points.
    """
    named = code_points(spark).select("code_point", F.shiftright("code_point", 12).alias("page"), *[p.alias(n) for n, p in properties.items()])
    inside = Window.partitionBy("page").orderBy("code_point")
    same = F.struct(*properties)
    begins = (F.lag("code_point").over(inside).isNull() | (F.lag(same).over(inside) != same)).cast("int")
    runs = named.withColumn("begins", begins).withColumn("run", F.sum("begins").over(inside))
    return runs.groupBy("page", "run", *properties).agg(F.min("code_point").alias("first"), F.max("code_point").alias("last")).drop("page", "run")


def script_ranges(spark: SparkSession) -> DataFrame:
    """`(script, category, first, last)`: some thousands of ranges, whatever the texts, written when this is called."""
    return write_table(property_ranges(spark, script=text.char_script(F.col("char")), category=text.char_category(F.col("char"))).coalesce(1))


def character_profile(df: DataFrame, column: str, key: str, ranges: DataFrame | None = None) -> DataFrame:
    """`(key, script, category, n)`: how many characters of each script and category the texts of a key hold.

    Characters are counted by key and code point where they are read; the counts, not the characters, are joined with the
    ranges.  Null and empty texts have no rows; texts of equal keys are taken together, those of null keys too.
    """
    ranges = script_ranges(df.sparkSession) if ranges is None else ranges
    chars = df.select(F.col(f"`{key}`").alias("key"), F.explode(F.split(F.col(f"`{column}`"), "")).alias("char")).filter("char <> ''")
    counted = chars.groupBy("key", "char").agg(F.count("*").alias("n")).withColumn("code_point", F.ascii("char").cast("long"))
    found = interval_join(counted, ranges, "code_point", "first", "last")
    return found.groupBy("key", "script", "category").agg(F.sum("n").alias("n")).select(F.col("key").alias(key), "script", "category", "n")
