"""Places against sorted lists, with keys that share a beginning, keys that many rows share, nulls and repeated rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import matching
from glyphmill.operators import ordering, tables


def test_shared_beginning(spark):
    df = spark.range(20_000).select(F.format_string("customer number %09d of all", (F.col("id") * 7919) % 20_000).alias("name"))
    got = tables.ranked(df, matching.sort_key(F.col("name")), "name").collect()
    assert {r.name: r["rank"] for r in got} == {n: k + 1 for k, n in enumerate(sorted(r.name for r in df.collect()))}


@pytest.mark.parametrize("key", ["concat('shared beginning of keys ', id)", "if(id % 3 = 0, 'hot', concat('k', id))", "'hot'"])
def test_no_task_has_more_than_its_share(spark, key):
    df = spark.range(40_000).select(F.expr(key).alias("k"))  # two thirds and all of these rows repeat in the last two
    parts = ordering.dealt(df, "k", parts=16).groupBy(F.shiftright("glyphmill_at", 33)).count().collect()
    assert sum(r["count"] for r in parts) == 40_000 and max(r["count"] for r in parts) <= 2 * 40_000 / 16


def test_places(spark):
    rows = [(None if k % 11 == 0 else f"k{k % 5}", k % 7, k % 2) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, place int")
    got = ordering.placed(df.drop("place"), "k", "v").collect()
    at = sorted(got, key=lambda r: r.place)
    low = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert [r.place for r in at] == list(range(1, 501)) and [low(r) for r in at] == sorted(map(low, rows))
    assert ordering.placed(df, "k").columns == ["k", "v", "place"]
    for k, group in Counter(r[0] for r in rows).items():
        mine = sorted((r.place, r.v) for r in ordering.placed(df, "v", within=("k",)).filter(F.col("k").eqNullSafe(F.lit(k))).collect())
        assert [p for p, _ in mine] == list(range(1, group + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)
    assert {(r.k, r.place) for r in ordering.densely_placed(df, "k").collect()} == {(None, 1), *((f"k{j}", j + 2) for j in range(5))}
    assert ordering.placed(df.limit(0), "k").count() == 0
    down = ordering.placed(df, F.col("v").desc()).collect()
    assert [r.v for r in sorted(down, key=lambda r: r.place)] == sorted((r[1] for r in rows), reverse=True)


def test_many_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BROADCAST_GROUPS", 3)
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), F.col("id"))
    got = ordering.placed(df, F.col("id").desc(), within=("g",)).collect()
    assert all(r.place == 20 - r.id // 50 for r in got) and len(got) == 1000


def test_a_rank_column_is_replaced(spark):
    df = spark.createDataFrame([("b", 9), ("a", 8)], "name string, rank int")
    assert sorted(map(tuple, tables.ranked(df, F.col("name")).collect())) == [("a", 1), ("b", 2)]
