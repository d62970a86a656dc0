"""Joins on derived keys: collation-equal and look-alike texts, with frequent keys dealt over several tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import matching, text
from glyphmill.sources.scratch import write_table


class Classes(NamedTuple):
    """`classes(class_id, key, n_texts, n_rows)`, `key` a digest, and `members`: the rows with their `class_id`."""

    classes: DataFrame
    members: DataFrame


class ClassPairs(NamedTuple):
    """`pairs` of class ids, and the rows of both sides with their `class_id`."""

    pairs: DataFrame
    left: DataFrame
    right: DataFrame


def heavy_keys(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """`(key, salts)` of the keys that hold more than a `parts`-th of the rows, at most `parts` of them: the number of tasks
    over which a key is to be dealt.  Nulls join nothing and are none of them."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("glyphmill_n"))
    total = rows.count()
    share = max(1, total // parts)
    return counted.filter(F.col("glyphmill_n") > share).select(key, F.ceil(F.col("glyphmill_n") / share).cast("int").alias("salts"))


def _salted(rows: DataFrame, heavy: DataFrame, key: str, salt: str, copied: bool) -> DataFrame:
    """The rows with `salt`: one of a heavy key's numbers by the row's hash, or (`copied`) a copy for each of them."""
    of = heavy.select(F.col(key).alias("glyphmill_of"), F.col("salts").alias("glyphmill_salts"))
    found = rows.join(F.broadcast(of), F.col(key) == F.col("glyphmill_of"), "left")  # at most `parts` rows
    n = F.coalesce("glyphmill_salts", F.lit(1))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    at = F.explode(F.sequence(F.lit(0), n - 1)) if copied else F.pmod(F.xxhash64(*hashed, F.monotonically_increasing_id()), n).cast("int")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], at.alias(salt))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", parts: int | None = None) -> DataFrame:
    """Equi-join on `key`, which both sides have, with each key that is frequent on a side dealt over several tasks.

    The rows of a frequent key get one of its numbers, and the other side's rows of that key a copy for each number; keys
    frequent on both sides are dealt on both, and blocks of rows meet blocks.  `how` is `inner` or `left`; in a left join
    only the left side is dealt, as a copied row could stay without a partner in several places.  Null keys join nothing.
    Other columns that both sides have must be renamed before.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no spread join of kind {how!r}")
    of_left = heavy_keys(left, key, parts)
    a, b = _salted(left, of_left, key, "glyphmill_a", False), _salted(right, of_left, key, "glyphmill_a", True)
    on = [key, "glyphmill_a"]
    if how == "inner":
        of_right = heavy_keys(right, key, parts)
        a, b = _salted(a, of_right, key, "glyphmill_b", True), _salted(b, of_right, key, "glyphmill_b", False)
        on.append("glyphmill_b")
    return a.join(b, on, how).drop(*on[1:])


def key_classes(df: DataFrame, column: str, key: Callable[[Column], Column]) -> Classes:
    """Classes of the rows whose texts have an equal `key`; a class is named by its smallest text.

    Keys are made of distinct texts, and equal texts are never paired, so a text that a third of all rows hold costs a count.
    Rows with a null text have a null `class_id`; empty texts are texts; a column named `class_id` is replaced; repeated
    rows all come back; an empty table has no classes.
    """
    kept = [c for c in df.columns if c != "class_id"]
    texts = df.groupBy(F.col(f"`{column}`").cast("string").alias("glyphmill_text")).agg(F.count("*").alias("n")).filter("glyphmill_text is not null")
    keyed = write_table(texts.withColumn("key", F.sha2(key(F.col("glyphmill_text")).cast("binary"), 256)))
    classes = keyed.groupBy("key").agg(F.min("glyphmill_text").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"))
    classes = write_table(classes.select("class_id", "key", "n_texts", "n_rows"))
    named = keyed.join(classes, "key").select("glyphmill_text", "class_id")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias("glyphmill_text"))
    return Classes(classes, spread_join(rows, named, "glyphmill_text", "left").drop("glyphmill_text"))


def collation_classes(df: DataFrame, column: str, locale: str = "en_US", strength: str | None = None) -> Classes:
    """Classes of rows whose texts a collation of that strength takes for equal."""
    return key_classes(df, column, lambda c: matching.sort_key(c, locale, strength))


def skeleton_classes(df: DataFrame, column: str) -> Classes:
    """Classes of rows whose texts look alike: their confusable skeletons are equal."""
    return key_classes(df, column, text.skeleton)


def collation_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, locale: str = "en_US", strength: str | None = None) -> ClassPairs:
    """Rows of two tables whose texts a collation takes for equal, as pairs of classes and membership.

    `pairs` has a row for each key of both sides: `(left_class, right_class, left_texts, right_texts, left_rows,
    right_rows)`; the joined rows are left_rows x right_rows of them, which `expanded` lists.  The join compares 256-bit
    digests of sort keys, so no sort key is shuffled.  Null texts are equal to nothing.
    """
    a, b = collation_classes(left, left_on, locale, strength), collation_classes(right, right_on, locale, strength)
    named = [c.classes.select("key", *[F.col(n).alias(f"{side}_{n.removeprefix('n_').removesuffix('_id')}") for n in ("class_id", "n_texts", "n_rows")]) for side, c in (("left", a), ("right", b))]
    pairs = named[0].join(named[1], "key").select("left_class", "right_class", "left_texts", "right_texts", "left_rows", "right_rows")
    return ClassPairs(pairs, a.members, b.members)


def expanded(found: ClassPairs, prefix: str = "right_") -> DataFrame:
    """All pairs of rows of a join by classes: the left columns, and the right ones with a prefix."""
    right = found.right.select(*[F.col(f"`{c}`").alias("class" if c == "class_id" else f"{prefix}{c}") for c in found.right.columns])
    of = write_table(found.pairs.select("left_class", "right_class"))
    left = found.left.join(of, F.col("class_id") == F.col("left_class")).drop("left_class", "class_id").withColumnRenamed("right_class", "class")
    return spread_join(left, right, "class").drop("class")


def near_texts(texts: DataFrame, column: str) -> Classes:
    """Distinct texts at an edit distance of exactly one (a character put in, left out or changed), without a row per pair.

    `classes(clique, kind, size)` and `members(text, clique, kind)`.  Texts of one clique of kind `changed` differ in one
    place, each from each; in one of kind `longer` the first text is the others without one of their characters: its row
    has `base` set.  Every two texts at distance one share exactly one clique, so links are counted, and listed, from sizes.

    Each text has one key for each of its characters, the digest of the text without it and its place, so the work grows
    with the square of a text's length: this is for names and hosts.  A clique of kind `changed` has at most one text for
    each code point, so there are no hot keys.  Nulls and repeated texts are left out; empty texts are texts.
    """
    t = F.col("text")
    once = write_table(texts.select(F.col(f"`{column}`").cast("string").alias("text")).filter("text is not null").distinct())
    without = lambda k: F.concat(F.substr(t, F.lit(1), k - 1), F.substr(t, k + 1, F.length(t)))
    cut = F.transform(F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.md5(without(k).cast("binary")).alias("rest"), k.alias("place")))
    cuts = once.select("text", F.inline(cut)).select("text", "rest", "place")
    changed = cuts.select("text", F.concat_ws(":", "rest", "place").alias("clique"), F.lit("changed").alias("kind"), F.lit(False).alias("base"))
    bases = once.select("text", F.md5(t.cast("binary")).alias("rest"))
    shorter = cuts.select("text", "rest").distinct().join(bases.select("rest"), "rest", "left_semi")
    longer = shorter.select("text", F.col("rest").alias("clique"), F.lit("longer").alias("kind"), F.lit(False).alias("base"))
    heads = bases.join(shorter.select("rest").distinct(), "rest", "left_semi").select("text", F.col("rest").alias("clique"), F.lit("longer").alias("kind"), F.lit(True).alias("base"))
    rows = write_table(changed.union(longer).union(heads))
    sizes = rows.groupBy("clique", "kind").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = write_table(sizes)
    members = rows.join(sizes.select("clique", "kind"), ["clique", "kind"], "left_semi")
    return Classes(sizes, members.select("text", "clique", "kind", "base"))


def near_counts(found: Classes) -> DataFrame:
    """`(text, n_near)` of the texts that have others at distance one."""
    links = F.when(F.col("kind") == "changed", F.col("size") - 1).when(F.col("base"), F.col("size") - 1).otherwise(1)
    return found.members.join(found.classes, ["clique", "kind"]).groupBy("text").agg(F.sum(links).alias("n_near"))


def look_alikes(df: DataFrame, column: str) -> DataFrame:
    """The rows with `class_id`, the smallest text whose skeleton is that of the row's, and `n_near`, the number of other
    classes whose skeletons are at an edit distance of one: look-alikes in another sense.  Nulls have neither."""
    found = skeleton_classes(df, column)
    named = write_table(found.classes.select("class_id", text.skeleton(F.col("class_id")).alias("skeleton")))
    counts = near_counts(near_texts(named, "skeleton"))
    of_class = named.join(counts, F.col("skeleton") == F.col("text"), "left").select(F.col("class_id").alias("class_id"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    rows = found.members.drop("n_near")
    return spread_join(rows, of_class, "class_id", "left")
