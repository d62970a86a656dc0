"""The pipeline's stages against brute-force versions of themselves, and on odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from glyphmill.llm import piece_dropout  # noqa: E402
from glyphmill.llm.queries import piece_model  # noqa: E402
from tests.llm.test_operators import ODD, brute_components, brute_contained, brute_spans  # noqa: E402

SF = "/root/testdata/sf0.001"
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")


def brute_mask(text, spans):
    out, done, end = "", 0, -1
    for start, kind, stop in spans:
        if start >= end:
            out += text[max(done, end) if end > 0 else done : start] + MARKS[kind]
            end = stop
        end = max(end, stop)
        done = end
    return out + text[done:]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    judged = [i for i in rows if labels.get(i) in (0, 1)]
    assert sum((i in ids) == (labels[i] == 1) for i in judged) > 0.95 * len(judged)

    groups = brute_components([(i, rows[i]) for i in sorted(ids)], 5, 80, 100)
    unique = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} == {i for i, _, c in groups if i == c}
    ids = {i for i, _, c in groups if i == c}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, *_ in brute_contained([(i, rows[i]) for i in ids], items)}
    clean = corpus_pipeline.decontamination(spark, unique, SF)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == ids - held

    order = sorted(ids - held)
    want = {i: brute_mask(rows[i] or "", s) for i, s in zip(order, brute_spans([rows[i] or "" for i in order]), strict=True)}
    masked = corpus_pipeline.personal_data(spark, clean, SF)
    found = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == docs.columns and {i: r.text for i, r in found.items()} == want and all(r.n_chars == len(r.text) for r in found.values())

    encoder = piece_dropout.DropoutEncoder(piece_model())
    coded = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(coded) == set(want) and all(r.lossless for r in coded.values())
    for i in order[:40]:
        assert coded[i].ids == encoder.encode_many([want[i]], [i])[0].tolist() and coded[i].n_tokens == len(coded[i].ids)


@pytest.fixture(scope="module")
def odd(spark):
    extra = "id long, sig long, rid long, key_a string, spans int, label int, glyphmill_id string, term string, comp int"
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, 2, 3, "a", 4, 5, "b", "c", 6) for i, t in ODD], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SF)
    want = list(corpus_pipeline.COLUMNS) if name != "tokens" else ["doc_id", "ids", "n_tokens", "lossless"]
    assert got.columns == want
    n = got.count()
    if name in ("personal_data", "tokens", "decontamination"):
        assert n == len(ODD)
    if name == "near_duplicates":
        assert n == len(ODD) and got.filter("text is null").count() == 1  # the repeated row has the kept id, so both stay
    assert stage(spark, odd.filter("false"), SF).count() == 0
    nulls = odd.select(*[F.lit(None).cast(t).alias(c) for c, t in odd.dtypes]).limit(3)
    assert stage(spark, nulls, SF).count() in ((0, 3) if name == "quality" else (3,))
