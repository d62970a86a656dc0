"""Streams against batches and brute force: a growing index, windows and late rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from glyphmill import streaming
from glyphmill.functions import matching
from glyphmill.streaming import index


def _plain(df):
    return {r.bucket: (r.records, list(r.names)) for r in index.names_of(df).collect()}


def test_index_in_any_parts_equals_batch(spark, tmp_path):
    pick = random.Random(9)
    # one bucket holds most names; repeated names, accents, digits, empty and null names
    names = [pick.choice(["Anna", "äpfel", "Ábel", "zoo", "9 lives", "Bob", "bob", "Émile", "", None, *[f"ann{k}" for k in range(200)]]) for _ in range(900)]
    keys = spark.createDataFrame([(n,) for n in sorted({n for n in names if n is not None})], "text string")
    of = {r.text: (r.b, bytes(r.k)) for r in keys.select("text", matching.index_bucket(F.col("text")).alias("b"), matching.sort_key(F.col("text")).alias("k")).collect()}
    want = defaultdict(list)
    for n in names:
        if n is not None:
            want[of[n][0]].append(n)
    want = {b: (len(ns), sorted(ns, key=lambda n: (of[n][1], n))[:3]) for b, ns in want.items()}
    whole = spark.createDataFrame([(n,) for n in names], "text string")
    assert _plain(index.index_of(whole)) == want
    pick.shuffle(names)
    path, seen, parts = str(tmp_path / "index"), str(tmp_path / "seen"), str(tmp_path / "in")
    for a, b in ((0, 10), (10, 500), (500, 900)):  # each a further run from the checkpoint
        spark.createDataFrame([(n,) for n in names[a:b]], "text string").coalesce(2).write.mode("append").parquet(parts)
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(parts)
        index.grow_index(stream, path, seen).awaitTermination()
    grown = index.read_index(spark, path)
    assert _plain(grown) == want
    other = spark.createDataFrame([("Aa",), ("qux",)], "text string")
    merged = _plain(index.merge_indexes(index.index_of(other), grown))
    assert merged == _plain(index.merge_indexes(grown, index.index_of(other))) == _plain(index.index_of(whole.unionByName(other)))
    assert _plain(index.index_of(whole.limit(0))) == {}


def test_late_rows_are_dropped_as_brute_force_says(spark, tmp_path):
    """A batch a file: a row is late if its window has ended at the watermark of the batch before."""
    pick = random.Random(1)
    start = datetime(2024, 1, 1)
    batches = []
    for k in range(6):
        rows = [(start + timedelta(minutes=30 * k + pick.randrange(60)), pick.choice("ab")) for _ in range(40)]
        rows += [(start + timedelta(minutes=pick.randrange(30)), "late") for _ in range(5)]
        batches.append(rows)
    path, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "seen")
    hour, late = timedelta(hours=1), timedelta(minutes=10)
    floor = lambda t: t.replace(minute=0)
    counts, dropped, mark, previous = Counter(), 0, datetime(1970, 1, 1), datetime(1970, 1, 1)
    for rows in batches:  # each batch runs to its end before the next file comes
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("ts timestamp, kind string").parquet(path)
        streaming.write_stream(streaming.windowed_counts(stream, "ts", "kind"), out, seen, kind="parquet").awaitTermination()
        for t, kind in rows:
            if floor(t) + hour <= mark:
                dropped += 1
            else:
                counts[floor(t), kind] += 1
        mark = max(mark, max(t for t, _ in rows) - late)
    got = {(r.start, r.kind): r.n for r in spark.read.parquet(out).select("window.start", "kind", "n").collect()}
    assert dropped > 0 and got == {k: n for k, n in counts.items() if k[0] + hour <= mark}
