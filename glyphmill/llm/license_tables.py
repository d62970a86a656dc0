"""License scans with any number of templates of any length (operator 4): the set-similarity join as joins by word.

Blocks, order, prefixes and threshold are those of `license_scan`, DataFrame functions only; the templates stay a table.
Documents meet the templates that hold one of their words in their prefix, and stay if they hold enough of the template's
words at all.  Their blocks are then counted without being made: a word that stands on line l, and before that on line p,
counts for just the blocks that begin after p, reach l and begin by l, a run of lines.  So each word and line gives a plus
and a minus, and their running sum over the lines is the overlap of every block: time is linear in words that documents and
templates share, whatever the templates' length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import drop_table, write_table
from glyphmill.llm.quality_rules import let

#: Texts of templates, and prefixes of templates, of up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

KIND = "array<struct<line: string, label: string, containment: double>>"


def ordered_table(texts: DataFrame, templates: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """`(tid, label, word, n, need, prefix)` of templates `(label, words)`: a row for each distinct word of each.

    Words are ordered by the number of texts `(rid, word)` that hold them, rarest first, ties by word.
    """
    num, den = threshold
    each = templates.select("tid", "label", F.explode(F.array_distinct("words")).alias("word"))
    known = each.select("word").distinct()
    counts = texts.join(known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    of = Window.partitionBy("tid")
    size = F.count("*").over(of)
    ranked = each.join(counts, "word", "left").withColumn("r", F.row_number().over(of.orderBy(F.coalesce("df", F.lit(0)), "word")))
    sized = ranked.select("tid", "label", "word", "r", size.alias("n")).withColumn("need", F.expr(f"(n * {num} + {den - 1}) div {den}"))
    return sized.select("tid", "label", "word", "n", "need", (F.col("r") <= F.col("n") - F.col("need") + 1).alias("prefix"))


def _first_or_last(lines: DataFrame, x: Column, of: Column, q: Column, last: bool) -> DataFrame:
    """For each line (rid, l): the smallest `of` among lines of its text with x >= q, or with `last` the largest with x <= q.

    Lines and questions are put in one order, and a running minimum answers them: no line meets many others.
    """
    told = lines.filter(of.isNotNull()).select("rid", x.alias("x"), F.lit(0).alias("asks"), of.alias("of"), F.lit(None).cast("int").alias("l"))
    asked = lines.select("rid", q.alias("x"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("of"), "l")
    order = F.col("x").asc() if last else F.col("x").desc()
    so_far = Window.partitionBy("rid").orderBy(order, "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (F.max if last else F.min)("of").over(so_far)
    return told.unionByName(asked).withColumn("found", found).filter("asks = 1").select("rid", "l", "found")


def block_lines(docs: DataFrame, following: int, words_of) -> DataFrame:
    """Lines of `(rid, text)`: `(rid, l, words, block, first, until)`.

    `block` is the first line from l on that a block begins on (one that is not empty), `first` the first line whose block
    reaches line l, `until` the last line of the block that begins on line l.
    """
    split = docs.select("rid", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    sized = split.select("rid", "l", (F.col("line") != "").alias("is_block"), words_of(F.col("line")).alias("words")).withColumn("c", F.size("words").cast("long"))
    end = F.sum("c").over(Window.partitionBy("rid").orderBy("l").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on = F.min(F.when(F.col("is_block"), F.col("l"))).over(Window.partitionBy("rid").orderBy(F.col("l").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = write_table(sized.withColumns({"b": end, "block": on}))
    first = _first_or_last(lines, F.col("b"), F.col("l"), F.col("b") - F.col("c") - following + 1, last=False)
    firsts = lines.join(first, ["rid", "l"]).select("rid", "l", "block", "words", "c", F.least("found", "l").alias("first"))
    until = _first_or_last(firsts, F.col("first"), F.when(F.col("c") > 0, F.col("l")), F.col("l"), last=True)
    out = write_table(firsts.join(until, ["rid", "l"]).select("rid", "l", "block", "words", "first", F.greatest(F.coalesce("found", "l"), "l").alias("until")))
    drop_table(lines)
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def blocks_by_join(docs: DataFrame, templates: DataFrame, threshold: tuple[int, int], following: int, words_of) -> DataFrame:
    """`(rid, blocks)` of the texts `(rid, text)` of a written table that have any, for templates `(tid, label, words)`."""
    lines = block_lines(docs, following, words_of)
    on_line = lines.select("rid", "l", "first", F.explode(F.array_distinct("words")).alias("word"))
    held = on_line.select("rid", "word").distinct()
    table = write_table(ordered_table(held, templates, threshold))
    occurrences = write_table(on_line.join(_small(table.select("word").distinct()), "word", "left_semi"))
    held = occurrences.select("rid", "word").distinct()
    given = held.join(_small(table.filter("prefix").select("tid", "word")), "word").select("rid", "tid").distinct()
    # of a template's words the text must hold enough; those it holds go on
    shared = given.join(table.select("tid", "word", "label", "n", "need"), "tid").join(held, ["rid", "word"])
    enough = F.count("*").over(Window.partitionBy("rid", "tid")) >= F.col("need")
    hits = shared.withColumn("enough", enough).filter("enough").drop("enough").join(occurrences, ["rid", "word"])
    before = F.lag("l").over(Window.partitionBy("rid", "tid", "word").orderBy("l"))
    runs = hits.withColumn("start", F.greatest(F.coalesce(before + 1, F.lit(0)), "first")).filter(F.col("start") <= F.col("l"))
    change = F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("l") + 1).alias("at"), F.lit(-1).alias("d"))))
    changes = runs.select("rid", "tid", "label", "n", "need", change).groupBy("rid", "tid", "label", "n", "need", "at").agg(F.sum("d").alias("d"))
    along = Window.partitionBy("rid", "tid").orderBy("at")
    overlap = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = changes.select("rid", "tid", "label", "n", "need", "at", overlap.alias("overlap"), F.lead("at").over(along).alias("next")).filter(F.col("overlap") >= F.col("need"))
    # a stretch of lines with one overlap is told by its first block; of stretches that follow each other the best one stays
    told = level.join(lines.select("rid", F.col("l").alias("at"), F.col("block").alias("l")), ["rid", "at"]).filter(F.col("l") < F.col("next"))
    run = F.sum((F.col("at") != F.coalesce(F.lag("next").over(along), F.lit(-1))).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = told.withColumn("run", run).groupBy("rid", "tid", "label", "n", "run").agg(F.max_by("l", F.struct("overlap", -F.col("l"))).alias("l"), F.max("overlap").alias("overlap"))
    met = best.join(lines.select("rid", "l", "until"), ["rid", "l"]).withColumn("containment", F.col("overlap") / F.col("n"))
    of = met.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("l", "tid", "until", "label", "containment"))).alias("met"))
    parts = F.split("text", "\n")
    line = lambda all_of, m: F.array_join(F.slice(all_of, m["l"] + 1, m["until"] - m["l"] + 1), "\n")
    texts = let(parts, lambda all_of: F.transform("met", lambda m: F.struct(line(all_of, m).alias("line"), m["label"].alias("label"), m["containment"].alias("containment"))))
    out = write_table(docs.join(of, "rid").select("rid", texts.cast(KIND).alias("blocks")))
    drop_table(lines, table, occurrences)
    return out
