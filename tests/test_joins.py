"""Joins on derived keys and ranges against brute force, with frequent keys, nulls, repeated rows and empty tables."""

from __future__ import annotations

import itertools
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text
from glyphmill.operators import joins, ranges, tables
from glyphmill.plans import catalogue


def near(a, b):
    """Whether two different texts are one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1 :])


HOSTS = [
    "paypal.com", "pаypal.com", "paypa1.com", "paypall.com", "paypal.co", "paypel.com", "aypal.com", "xpaypal.com", "payppal.com", "a.io", "b.io", "c.io", "ab.io", ".io", "", "x", "xx", "xxx",
    "google.com", "gооgle.com", "g00gle.com", "goggle.com", "modern.org", "rnodern.org", "日本.jp", "日木.jp",
]


def test_look_alikes(spark):
    r = random.Random(1)
    rows = [(k, h) for k, h in enumerate(HOSTS * 3)] + [(1000 + k, "paypal.com") for k in range(600)] + [(2000, None), (2001, None)]
    rows += [(3000 + k, "".join(r.choice("ab") for _ in range(r.randrange(1, 7)))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, host string").withColumns({"n_near": F.lit("x"), "class_id": F.lit(1), "text": F.lit("t")})
    got = joins.look_alikes(df, "host").collect()
    skeleton = {x.host: x.s for x in spark.createDataFrame([(h,) for h in {h for _, h in rows if h is not None}], "host string").select("host", text.skeleton(F.col("host")).alias("s")).collect()}
    assert skeleton["pаypal.com"] == skeleton["paypal.com"] == skeleton["paypa1.com"] and skeleton["rnodern.org"] == skeleton["modern.org"]
    of = {s: min(h for h in skeleton if skeleton[h] == s) for s in skeleton.values()}
    links = {s: sum(near(s, x) for x in of) for s in of}
    want = sorted([(i, h, None, None) if h is None else (i, h, of[skeleton[h]], links[skeleton[h]]) for i, h in rows], key=repr)
    assert sorted(((x.id, x.host, x.class_id, x.n_near) for x in got), key=repr) == want and sum(links.values()) > 100
    assert joins.look_alikes(df.filter("false"), "host").count() == 0


def test_cliques_hold_all_links_once(spark):
    r = random.Random(2)
    texts = sorted({"".join(r.choice("abé🙂") for _ in range(r.randrange(0, 5))) for _ in range(150)})
    found = joins.near_texts(spark.createDataFrame([(t,) for t in texts + texts[:20] + [None]], "t string"), "t")
    cliques: dict = {}
    for m in found.members.collect():
        cliques.setdefault((m.clique, m.kind), []).append((m.text, m.base))
    links = Counter()
    for (_, kind), members in cliques.items():
        pairs = itertools.combinations(members, 2) if kind == "changed" else [(a, b) for a in members for b in members if a[1] and not b[1]]
        links.update(tuple(sorted((a[0], b[0]))) for a, b in pairs)
    assert links == Counter(p for p in itertools.combinations(texts, 2) if near(*p))
    sizes = {(c.clique, c.kind): c["size"] for c in found.classes.collect()}
    assert sizes == {k: len(v) for k, v in cliques.items()}


def test_many_of_one_clique(spark):
    """A thousand hosts that differ in one place: as many rows, not half a million pairs."""
    df = spark.range(1000).select(F.format_string("host-%s.example", F.decode(F.unhex(F.concat(F.lit("0000FEFF0000"), F.hex(F.col("id") + 0x4E00))), "UTF-32")).alias("h"))
    found = joins.near_texts(df, "h")
    assert found.members.count() == 1000 and [r["size"] for r in found.classes.collect()] == [1000]
    assert {r.n_near for r in joins.near_counts(found).collect()} == {999}


def fold(word):
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


def test_collation_join(spark):
    r = random.Random(3)
    words = ["resume", "Résumé", "résume", "naive", "Naïve", "x", "X", "côte", "cote", "coté", "only"]
    left = [(k, r.choice(words[:-1])) for k in range(200)] + [(900 + k, "resume") for k in range(300)] + [(-1, None)]
    right = [(k, r.choice(words[2:])) for k in range(90)] + [(700 + k, "RESUME") for k in range(80)] + [(-2, None)]
    a, b = (spark.createDataFrame(x, "id long, word string").withColumn("class_id", F.lit(0)) for x in (left, right))
    found = joins.collation_join(a, b, "word", "word", strength="primary")
    pairs = found.pairs.collect()
    keys = {fold(w) for _, w in left if w} & {fold(w) for _, w in right if w}
    of = lambda rows, k: [w for _, w in rows if w is not None and fold(w) == k]
    want = [(min(of(left, k)), min(of(right, k)), len(set(of(left, k))), len(set(of(right, k))), len(of(left, k)), len(of(right, k))) for k in keys]
    assert sorted(map(tuple, pairs)) == sorted(want) and len(pairs) == 4
    assert found.left.count() == len(left) and {x.class_id for x in found.left.filter("word is null").collect()} == {None}
    rows = joins.expanded(found).collect()
    assert sorted((x.id, x.right_id) for x in rows) == sorted((i, j) for i, v in left for j, w in right if v and w and fold(v) == fold(w))
    by_case = joins.collation_join(a, b, "word", "word", strength="tertiary").pairs.collect()
    assert sorted(x.left_class for x in by_case) == sorted({w for _, w in left} & {w for _, w in right} - {None})
    assert joins.collation_join(a.filter("false"), b, "word", "word").pairs.count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    r = random.Random(4)
    left = [("hot" if k % 3 else r.choice(["a", "b", "c", None]), k) for k in range(400)] + [("hot", 1), ("hot", 1)]
    right = [("hot" if k % 2 else r.choice(["a", "b", "d", None]), k) for k in range(60)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    got = Counter(map(tuple, joins.spread_join(a, b, "k", how, parts=16).select("k", "x", "y").collect()))
    assert got == Counter(map(tuple, a.join(b, "k", how).select("k", "x", "y").collect()))
    assert {x.k for x in joins.heavy_keys(a, "k", 16).collect()} >= {"hot"} and joins.heavy_keys(a, "k", 16).count() <= 16
    assert joins.spread_join(a.filter("false"), b, "k", how).count() == 0
    with pytest.raises(ValueError):
        joins.spread_join(a, b, "k", "outer")


def test_points_in_ranges(spark):
    r = random.Random(5)
    spans = [(k, low, low + r.choice([0, 1, 3, 100, 5000, -1])) for k in range(80) for low in [r.randrange(-3000, 3000)]] + [(98, 7, 7), (98, 7, 7), (99, None, 3), (100, -(2**60), 2**60)]
    points = [(r.randrange(-4000, 9000),) for _ in range(300)] + [(None,), (2**61,), (7,), (7,)]
    a, b = spark.createDataFrame(points, "p long"), spark.createDataFrame(spans, "k int, low long, high long")
    got = Counter(map(tuple, ranges.interval_join(a, b, "p", "low", "high").drop("low", "high").collect()))
    inside = lambda p: [k for k, low, high in spans if p is not None and low is not None and low <= p <= high]
    assert got == Counter((p, k) for (p,) in points for k in inside(p))
    assert ranges.interval_join(a, b.filter("false"), "p", "low", "high").count() == 0


def test_blocks_of_a_range(spark):
    df = spark.createDataFrame([(1, 1 << 40), (0, (1 << 40) - 1), (5, 5), (3, 12)], "a long, b long")
    blocks = [[(x.level, x.block) for x in r.c] for r in df.select(ranges._covered(F.col("a"), F.col("b")).alias("c")).collect()]
    for (a, b), parts in zip([(1, 1 << 40), (0, (1 << 40) - 1), (5, 5), (3, 12)], blocks, strict=True):
        spans = sorted((block << level, (block + 1 << level) - 1) for level, block in parts)
        assert spans[0][0] == a and spans[-1][1] == b and all(x[1] + 1 == y[0] for x, y in itertools.pairwise(spans)) and len(parts) <= 82


def test_code_point_ranges(spark):
    found = ranges.script_ranges(spark).collect()
    assert sum(r.last - r.first + 1 for r in found) == 0x110000 - 2048
    of = lambda c: next((r.script, r.category) for r in found if r.first <= ord(c) <= r.last)
    assert [of(c) for c in "aÉя中﻿ 5€"] == [("Latin", "Ll"), ("Latin", "Lu"), ("Cyrillic", "Ll"), ("Han", "Lo"), ("Common", "Cf"), ("Common", "Zs"), ("Common", "Nd"), ("Common", "Sc")]
    df = spark.createDataFrame([(1, "aaÉ🙂"), (1, "a"), (2, ""), (3, None), (None, "я")], "id int, text string")
    got = sorted(map(tuple, ranges.character_profile(df, "text", "id").collect()), key=repr)
    assert got == sorted([(1, "Latin", "Ll", 3), (1, "Latin", "Lu", 1), (1, "Common", "So", 1), (None, "Cyrillic", "Ll", 1)], key=repr)


def test_first_seen(spark):
    r = random.Random(6)
    words = ["côte", "Cote", "COTE", "x", "X", "", None, "ß", "ss"]
    rows = [(k // 2 if k % 50 else None, r.choice(words), r.random()) for k in range(600)]
    df = spark.createDataFrame(rows, "at int, word string, v double")
    for strength, key in (("primary", lambda w: w and fold(w)), ("identical", lambda w: w)):
        best = {}
        for row in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or "", x[2])):
            best.setdefault(key(row[1]), row)
        got = tables.unique_first(df, "word", "at", strength=strength)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(best.values(), key=repr)
    assert tables.unique_first(df.filter("false"), "word", "at").count() == 0


def test_first_seen_of_texts_alone(spark):
    """A text and a packed ordinal are reduced by hashing, before any row is sorted; ordinals keep their order and their parts."""
    r = random.Random(7)
    numbers = [None, -(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    rows = [(r.choice(numbers), r.choice([0, 1, 2, 2**31 - 1]), r.choice(["côte", "Cote", "x", "X", "", None, "ß", "ss"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "id long, pos int, word string")
    best = {}
    for row in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is not None, x[2] or "")):
        best.setdefault(row[2] and fold(row[2]), row)
    packed = df.select("word", tables.ordinal_of(F.col("id"), F.col("pos")).alias("at"))
    first = tables.unique_first(packed, "word", "at", strength="primary")
    got = first.select(*tables.ordinal_parts(F.col("at")), "word")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(best.values(), key=repr)
    found = [tuple(x) for x in packed.select(*tables.ordinal_parts(F.col("at"))).distinct().collect()]
    assert sorted(found, key=repr) == sorted({x[:2] for x in rows}, key=repr)


def test_query_of_first_seen_hashes_before_it_sorts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = catalogue.collation_first_seen(docs)._jdf.queryExecution().executedPlan().toString()
    deepest = [x for x in plan.split("\n") if "Aggregate(" in x][-1]
    assert "HashAggregate(" in deepest  # of the words as they are read: a SortAggregate would sort and spill them all
