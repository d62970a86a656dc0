"""License scans by exact set-similarity join (operator 4), DataFrame functions only.

The templates are a small table, so the join is row-local: no shuffle of the texts.  Template words are ordered by
their document frequency over the whole corpus, rarest first, and the prefix words of the templates index them.  With a
containment threshold t a template of n words needs a = ceil(t n) of them; a block can only reach that if it holds one of
the n - a + 1 rarest (prefix filter), has at least a template words (length filter), and if enough words follow its first
prefix word in both orders (positional filter).  Only the templates that the index gives for a block's words are looked
at, and those that pass are verified by their exact intersection.  As statements are wrapped, a block is a line with the
lines that follow it, up to the end of the one that holds the last of as many words as the longest template has.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import ASCII_UPPER, drop_table, write_table
from glyphmill.llm.license_tables import KIND, blocks_by_join
from glyphmill.llm.quality_rules import let

#: A word, and a word of a text whose A-Z are not lowered yet.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Statements by which texts name a licence, as (label, words); the default table of templates.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
)
#: Up to so many templates, of up to so many words, go into the plan; more, or longer ones, stay a table (`license_tables`).
PLAN_TEMPLATES, PLAN_WORDS = 1_000, 100
THRESHOLD = (9, 10)


@dataclass(frozen=True)
class Template:
    """Distinct words of a template in corpus order (rarest first), the overlap it needs, and its length in words."""

    label: str
    words: tuple[str, ...]
    need: int
    length: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def _lowered(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(f"({WORD}+)"), F.lit(1))


def template_table(spark: SparkSession, templates: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """`(tid, label, words)` of a table `(label, text)` or of pairs, written; rows without a label or words are left out."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list(templates), "label string, text string")
    words = templates.select(F.col("label").cast("string").alias("label"), _words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    return write_table(words.filter("label is not null and size(words) > 0").select(F.monotonically_increasing_id().alias("tid"), "label", "words"))


def template_rows(templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """(label, words) of pairs; those without a label or words are left out."""
    rows = [(label, re.findall(f"{WORD}+", (text or "").translate(_LOWER))) for label, text in templates]
    return [(label, words) for label, words in rows if words and label is not None]


def ordered_templates(
    docs: DataFrame, text_col: str, rows: list[tuple[str, list[str]]], threshold: tuple[int, int] = THRESHOLD
) -> tuple[list[Template], list[str]]:
    """Templates of (label, words), and all their words, in the order of document frequencies over all of `docs` (ties by word)."""
    known = sorted({w for _, words in rows for w in words})
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held = F.array_intersect(_strings(known), F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    counts = {r.word: r.n for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()} if known else {}
    order = sorted(known, key=lambda w: (counts.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    num, den = threshold
    return [Template(label, tuple(sorted(set(words), key=place.__getitem__)), -(-len(set(words)) * num // den), len(words)) for label, words in rows], order


def _matches(line: Column, block: Column, found: list[Template]) -> Column:
    """(line, label, containment) of the templates that a block (its template words in corpus order) holds enough of."""
    fields = [F.struct(F.lit(t.label).alias("label"), _strings(t.words).alias("words"), _strings(t.prefix).alias("prefix"), F.lit(t.need).alias("need")) for t in found]
    index: dict[str, list[int]] = {}
    for k, t in enumerate(found):
        for word in t.prefix:
            index.setdefault(word, []).append(k)
    numbers = F.map_from_arrays(_strings(index), F.array(*[F.array(*map(F.lit, ids)) for ids in index.values()]))
    given = F.array_distinct(F.flatten(F.filter(F.transform(block, lambda w: numbers[w]), lambda x: x.isNotNull())))

    def containment(t: Column) -> Column:
        word = F.get(F.array_intersect(t["prefix"], block), F.lit(0))
        in_template = F.array_position(t["words"], word) - 1
        in_block = F.array_position(block, word) - 1
        bound = F.least(F.size(t["words"]) - in_template, F.size(block) - in_block)
        shared = F.size(F.array_intersect(t["words"], block))
        return F.when((F.size(block) >= t["need"]) & (bound >= t["need"]) & (shared >= t["need"]), shared / F.size(t["words"])).otherwise(F.lit(0.0))

    every = F.array(*fields)
    seen = F.transform(given, lambda k: let(F.get(every, k), lambda t: F.struct(line.alias("line"), t["label"].alias("label"), containment(t).alias("containment"))))
    return F.filter(seen, lambda m: m["containment"] > 0)


def _places(words: Column, phrase: str) -> Column:
    """Starts at which the words of a phrase stand one after another."""
    parts = phrase.split()
    hit = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), hit)
    return F.when(F.size(words) >= len(parts), found).otherwise(F.array().cast("array<int>"))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | Sequence[tuple[str, str]] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """One row per row of `docs`: `(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks)`.

    `blocks` are the blocks (`line`) that meet the containment threshold of a template, with its label and their containment;
    `score` is 1 where a base phrase stands, else the best containment.  Null and empty texts have no words and empty
    labels; repeated rows are scanned each; a null id stays null; extra columns are ignored; an empty table gives an
    empty result.  `templates` are pairs or a table (label, text): repeated ones match alike, null labels and texts without
    words are left out, and without any only the base phrases count.  More than PLAN_TEMPLATES templates, or
    longer ones than PLAN_WORDS words, stay a table that words are joined with, in time linear in the words; all is the same
    then but `blocks`, which has, of blocks on lines after one another that meet a template, the first with the most of it.
    """
    if not isinstance(templates, DataFrame) and len(templates) <= PLAN_TEMPLATES:
        rows = template_rows(templates)
        fit = all(len(words) <= PLAN_WORDS for _, words in rows)
    else:
        fit, rows = False, []
    if not fit:
        table = template_table(docs.sparkSession, templates)
        sizes = table.agg(F.count("*").alias("n"), F.max(F.size("words")).alias("most")).first()
        fit = sizes.n <= PLAN_TEMPLATES and (sizes.most or 0) <= PLAN_WORDS
        if not fit:
            return _scan_by_join(docs, id_col, text_col, table, sizes.most, threshold)
        rows = [(r.label, r.words) for r in table.collect()]
        drop_table(table)
    found, order = ordered_templates(docs, text_col, rows, threshold)
    rare = sorted({w for t in found for w in t.prefix}) or ["\0"]
    following = max((t.length for t in found), default=0)  # words after a line that may belong to a statement begun on it
    holds_prefix = f"(?i)(?<!{RAW_WORD})(?:{'|'.join(map(re.escape, rare))})(?!{RAW_WORD})"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    in_order = lambda line: F.array_intersect(_strings(order), _words_of(line))
    of_line = lambda line: let(in_order(line), lambda b: _matches(line, b, found))
    window = f"(?<![^\n])(?=([^\n]*+(?:{NO_WORD}*+{RAW_WORD}++){{0,{following}}}+[^\n]*+))[^\n]"
    candidates = F.filter(F.regexp_extract_all(text, F.lit(window), F.lit(1)), lambda x: F.regexp_like(x, F.lit(holds_prefix)))
    blocks = F.flatten(F.transform(candidates, of_line)).cast(KIND) if found else F.array().cast(KIND)
    out = docs.select(
        F.col(id_col).alias(id_col),
        *_base(text),
        F.when(F.regexp_like(text, F.lit(holds_prefix)), blocks).otherwise(F.array().cast(KIND)).alias("blocks"),
    )
    return _report(out, id_col)


def _scan_by_join(docs: DataFrame, id_col: str, text_col: str, templates: DataFrame, longest: int, threshold: tuple[int, int]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    texts = write_table(docs.select(F.col(id_col).alias("glyphmill_id"), text).withColumn("rid", F.monotonically_increasing_id()))
    blocks = blocks_by_join(texts, templates, threshold, longest, _words_of)
    drop_table(templates)
    out = texts.join(blocks, "rid", "left").select(F.col("glyphmill_id").alias(id_col), *_base(F.col("text")), F.coalesce("blocks", F.array().cast(KIND)).alias("blocks"))
    report = _report(out, id_col)
    report._glyphmill_under = (texts, blocks)
    return report


def _base(text: Column) -> list[Column]:
    """`n_words`, and `b` with the places and labels of the base phrases."""

    def base(words: Column) -> Column:
        found = [_places(words, p) for p, _ in PHRASES]
        every = F.concat(*found)
        labels = F.sort_array(F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(found, PHRASES, strict=True)])))
        return F.struct(F.size(every).cast("long").alias("n"), F.array_min(every).cast("long").alias("first"), F.array_max(every).cast("long").alias("last"), labels.alias("labels"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("labels"))
    places = F.when(F.regexp_like(text, F.lit("(?i)license")), let(_words_of(text), base)).otherwise(none)
    return [F.regexp_count(text, F.lit(f"{RAW_WORD}+")).cast("long").alias("n_words"), places.alias("b")]


def _report(out: DataFrame, id_col: str) -> DataFrame:
    labels = F.sort_array(F.array_union("b.labels", F.transform("blocks", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda m: m["containment"])), F.lit(0.0))
    return out.select(
        id_col, "n_words", F.col("b.n").alias("n_base"), F.col("b.first").alias("first_word"), F.col("b.last").alias("last_word"),
        F.array_join("b.labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("b.n") > 0, F.lit(1.0)).otherwise(best).alias("score"), "blocks",
    )
