"""Sorting, distinct, grouping and fan-out over tables of text."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import matching, text
from glyphmill.operators import ordering


def sort_table(df: DataFrame, column: str, locale: str = "en_US", reverse: bool = False, strength: str | None = None, case_first: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Rows in collation order; with `ordinal`, ties keep its order, also in reverse."""
    native = not case_first and strength not in ("quaternary", "identical")
    key = matching.collated(F.col(column), locale, strength) if native else matching.sort_key(F.col(column), locale, strength, case_first)
    return df.orderBy(key.desc() if reverse else key.asc(), *([F.col(ordinal)] if ordinal else []))


def unique_sorted(df: DataFrame, column: str, locale: str = "en_US", reverse: bool = False) -> DataFrame:
    """Each text once, in collation order, equal ones by code points."""
    once = df.select(column).distinct()
    key = matching.collated(F.col(column), locale)
    return once.orderBy(key.desc() if reverse else key.asc(), F.col(column))


def unique_first(df: DataFrame, column: str, ordinal: str, locale: str = "en_US", strength: str | None = None) -> DataFrame:
    """Of the rows whose texts a collation takes for equal, the one of the lowest `ordinal`: the first seen of each, whole.

    One aggregation by sort key, in the tasks that read the rows and then by key, so a text that many rows share is reduced
    before it is sent.  Rows that tie in their ordinal are told apart by their text and then by all their columns that can be
    ordered; null ordinals come last; null texts are equal to each other.  Order the result by `ordinal` for first-seen order.

    That aggregation sorts the rows of each task, as its buffer is a whole row.  A table of nothing but a text and its ordinal
    is first reduced to its distinct texts, and only those get a sort key and are sorted.  With an ordinal of fixed width (a
    number, a date, or two numbers as `ordinal_of` packs them) that step hashes, so what a task holds, spills and sends
    grows with its distinct texts, not with its rows.
    """
    of, by = F.col(f"`{column}`"), F.col(f"`{ordinal}`")
    if sorted(df.columns) == sorted([column, ordinal]) and df.schema[column].dataType.simpleString() == "string":
        df = df.groupBy(of.alias(column)).agg(F.min(by).alias(ordinal)).select(*[F.col(f"`{c}`") for c in df.columns])
    ordered = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    order = F.struct(by.isNull().alias("glyphmill_null"), *[F.col(f"`{c}`") for c in dict.fromkeys([ordinal, column, *ordered])])
    # the order holds the row, unless some of its columns have none
    first = F.min(order) if len(ordered) == len(df.columns) else F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order)
    found = df.groupBy(matching.sort_key(of, locale, strength).alias("glyphmill_key")).agg(first.alias("glyphmill_row"))
    return found.select(*[F.col(f"glyphmill_row.`{c}`") for c in df.columns])


#: An ordinal of two numbers is the first times this, and the second; a null first number counts as this much.
_SECOND, _NULL_FIRST = Decimal(10**10), Decimal(10**19)


def ordinal_of(first: Column, second: Column) -> Column:
    """A long and an int from 0 as one decimal that sorts as they do, null longs last: of fixed width, unlike a struct."""
    return F.coalesce(first.cast("decimal(20,0)"), F.lit(_NULL_FIRST)) * F.lit(_SECOND) + second


def ordinal_parts(ordinal: Column) -> tuple[Column, Column]:
    """The long and the int that `ordinal_of` has packed."""
    second = F.pmod(ordinal, F.lit(_SECOND))
    first = ((ordinal - second) / F.lit(_SECOND)).cast("decimal(20,0)")
    return F.when(first < F.lit(_NULL_FIRST), first).cast("long"), second.cast("int")


def ranked(df: DataFrame, key: Column, *ties: str, name: str = "rank", dense: bool = False) -> DataFrame:
    """The table with each row's place from 1 by a key, then by `ties`; `dense`: equal keys share theirs, without gaps.

    No task has to hold the rows of a key or of a beginning of keys: see `ordering.placed`.  Null keys come first; a column
    named like `name` is replaced; rows that are equal in key and ties are placed in an order of their own.
    """
    kept = [c for c in df.columns if c != name]
    keyed = df.select(*[F.col(f"`{c}`") for c in kept], key.alias("glyphmill_key_of"))
    if dense:
        out = ordering.densely_placed(keyed, "glyphmill_key_of", name=name)
    else:
        out = ordering.placed(keyed, "glyphmill_key_of", *[F.col(f"`{c}`") for c in ties], name=name)
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{name}`").cast("int").alias(name))


def index_buckets(df: DataFrame, column: str, locale: str = "en_US") -> DataFrame:
    """`(bucket, names)`: names in collation order under their index label.  For tables of any size see `index_rows`."""
    keyed = df.select(matching.index_bucket(F.col(column), locale).alias("bucket"), F.struct(matching.sort_key(F.col(column), locale).alias("k"), F.col(column).alias("name")).alias("n"))
    return keyed.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list("n")), lambda n: n["name"]).alias("names"))


def index_rows(df: DataFrame, column: str, locale: str = "en_US") -> DataFrame:
    """The rows, with all their columns, and `bucket` and `place` (from 1 over the whole index): no bucket is gathered."""
    return ranked(df, matching.sort_key(F.col(column), locale), name="place").withColumn("bucket", matching.index_bucket(F.col(column), locale))


def bucket_counts(df: DataFrame, column: str, locale: str = "en_US") -> DataFrame:
    """`(bucket, records)` of the buckets that have any."""
    return df.groupBy(matching.index_bucket(F.col(column), locale).alias("bucket")).agg(F.count("*").alias("records"))


def tokens(df: DataFrame, column: str, kind: str = "word", locale: str = "en_US") -> DataFrame:
    """The table with a row for each sentence, word, line segment or grapheme: `position` and `token` are added, in the place of
    columns that are named so already."""
    breaks = {"sentence": text.break_sentences, "word": text.break_words, "line": text.break_lines}
    found = text.break_graphemes(F.col(column)) if kind == "grapheme" else breaks[kind](F.col(column), locale)
    return df.select(*[c for c in df.columns if c not in ("position", "token")], F.posexplode(found).alias("position", "token"))


def transliterate_all(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """A row for each text and transliterator: `transliterator` and `result` (null where it is unknown), in the place of columns
    that are named so already."""
    results = F.array(*[F.struct(F.lit(i).alias("transliterator"), text.transliterate(F.col(column), i).alias("result")) for i in ids])
    others = [c for c in df.columns if c not in ("transliterator", "result")]
    return df.select(*others, F.inline(results))


def selected(column: Column, selector: str, major: list[str] | None = None) -> Column:
    """Whether a value is chosen: `any`, `major`, a comma list, or a regular expression; case does not matter."""
    if selector.lower() == "any":
        return F.lit(True)
    if selector.lower() == "major":
        return F.lower(column).isin([m.lower() for m in major or []])
    names = [s.strip().lower() for s in selector.split(",") if s.strip()]
    if len(names) > 1 or re.fullmatch(r"[\w ]+", selector):
        return F.lower(column).isin(names)
    return F.regexp_like(column, F.lit(f"(?i)^({selector})$"))


def mixed_script_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text holds letters of more than one script."""
    return df.filter(F.size(text.detect_scripts(F.col(column))) > 1)
