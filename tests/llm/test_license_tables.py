"""License scans with templates that stay a table, against those in the plan and brute force."""

from __future__ import annotations

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from glyphmill.llm import license_scan
from tests.llm.test_operators import ODD, brute_templates


def _rows(found):
    plain = lambda m: (m.line, m.label, m.containment)
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score), Counter(map(plain, r.blocks))) for r in found.collect())


def _compare(spark, monkeypatch, docs, templates):
    """All columns are the same; blocks are some of those in the plan, with the best of each label."""
    docs = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    monkeypatch.setattr(license_scan, "PLAN_TEMPLATES", 1000)
    in_plan = _rows(license_scan.scan_licenses(docs, templates=templates))
    monkeypatch.setattr(license_scan, "PLAN_TEMPLATES", 0)
    joined = _rows(license_scan.scan_licenses(docs, templates=templates))
    assert [r for r, _ in in_plan] == [r for r, _ in joined]
    best = lambda blocks: {label: max(c for _, of, c in blocks if of == label) for _, label, _ in blocks}
    for (_, all_of), (_, some) in zip(in_plan, joined, strict=True):
        assert some <= all_of and best(some) == best(all_of)
    return sum(some.total() for _, some in joined)


def test_equal_to_templates_in_the_plan(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(40)]
    templates = [(f"t{k % 50}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for k in range(80)] + [("t1", "v1 v2"), ("t1", "v1 v2"), (None, "v1"), ("none", " ,"), ("null", None)]
    made = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "\n", "\n\n", "\n# ", "\n-\n"]) for _ in range(rng.randint(1, 70))) for _ in range(120)]
    rows = [*ODD, (None, None), (50, ""), (51, "\n"), (51, "\n"), (52, "v1\nv2"), *((100 + k, t) for k, t in enumerate(made))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _compare(spark, monkeypatch, docs, templates) > 200
    assert license_scan.scan_licenses(docs.limit(0), templates=templates).count() == 0
    assert _compare(spark, monkeypatch, docs, spark.createDataFrame(templates, "label string, text string").filter("label = 'none'")) == 0


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "1 as rid", "'x' as blocks", "2 as l")
    assert _compare(spark, monkeypatch, docs, license_scan.TEMPLATES) > 0


def test_many_templates_and_one_of_6000_words(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30_000)]
    long = rng.sample(words, 6000)
    templates = [(f"t{k}", " ".join(rng.sample(words, rng.randint(2, 12)))) for k in range(20_000)] + [("long", " ".join(long))]
    near = [x for x in long if rng.random() < 0.95]  # a copy with gaps, wrapped, between other words
    rows = [(1, "\n".join(" ".join(near[k : k + 9]) for k in range(0, len(near), 9))), (2, " ".join(long[:5000])), (3, "\n".join(long)), (4, None), (5, "mit license")]
    rows += [(10 + k, "some\n" + t.replace(" ", rng.choice([" ", "\n", "\n# "]), 3) + "\nother words") for k, (_, t) in enumerate(rng.sample(templates[:-1], 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.monotonic()
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs, templates=templates).collect()}
    took = time.monotonic() - started
    sets = [(label, set(t.split())) for label, t in templates]
    for i, t in rows:
        # only templates that the whole text holds enough of can be in one of its blocks
        held = set((t or "").split())
        near_ones = [(label, s) for (label, s), (_, ws) in zip(templates, sets, strict=True) if 10 * len(held & ws) >= 9 * len(ws)]
        want = brute_templates(t, near_ones, 6000) if near_ones else set()
        assert got[i][0] == ",".join(sorted(want | ({"mit"} if i == 5 else set())))
    assert "long" in got[1][0].split(",") and "long" in got[3][0].split(",") and "long" not in got[2][0].split(",")
    assert took < 120
