"""Tokens by windows against the tokens of whole texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import tables, windows
from glyphmill.plans.catalogue import QUERIES

KINDS = ["word", "sentence", "line", "grapheme"]
ODD = [
    None, "", " ", "\n", "a", "\n\n\r\n", "é" * 90, "One. Two! three? Four. é Five", "x́ ý ́z. Á B", "日本語の文章です。次の文。 And so. On", "1,000.5 a-b c'd e.f g:h \U0001f468‍\U0001f469 ok",
    "no safe break" .replace(" ", " ") * 20, "สวัสดีครับ ผมชื่อ John Smith", "a\r\nb\rc d", "\U0001f1e6\U0001f1e7\U0001f1e8 a \U0001f1e6 b", "Mr. Smith (etc.) \"Quoted.\" Then. 3 more? yes! No",
]


def _texts():
    pick = random.Random(5)
    made = ["".join(pick.choice(["a", "B", " ", ". ", "\n", "é", "́", "'", "-", "1", ",", "世", "\U0001f468", "‍", "! ", "(", ")", "the ", "\r"]) for _ in range(pick.randrange(1, 200))) for _ in range(150)]
    return list(enumerate(ODD + made))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("window", [1, 40])
def test_equal_to_whole_texts(spark, kind, window):
    df = spark.createDataFrame(_texts(), "id int, t string").repartition(4)
    got = sorted(map(tuple, windows.long_tokens(df, "t", kind, window=window).select("id", "position", "token").collect()))
    assert got == sorted(map(tuple, tables.tokens(df, "t", kind).select("id", "position", "token").collect()))


def test_documents_and_clashing_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("position"), F.lit("x").alias("token"))
    for kind in KINDS:
        got, want = windows.long_tokens(docs, "text", kind, window=500, spread=4), tables.tokens(docs, "text", kind)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert windows.long_tokens(docs.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        windows.long_tokens(docs, "text", "page")


def test_parts_are_the_text(spark):
    df = spark.createDataFrame(_texts(), "id int, t string").select("t", windows.windows(F.col("t"), "word", 16).alias("p"))
    for r in df.collect():
        assert (r.t is None and r.p is None) or "".join(r.p) == r.t


def test_long_text(spark):
    """A text of 12 MB in one row: parts stay short, and the places of its tokens go on from part to part."""
    df = spark.range(1).select(F.expr("repeat('some words of a long text, and more.\n', 330000)").alias("t"))
    parts = df.select(F.explode(windows.windows(F.col("t"))).alias("p")).agg(F.count("*").alias("n"), F.max(F.length("p")).alias("most")).first()
    assert parts.n > 150 and parts.most <= 2 * windows.WINDOW
    found = windows.long_tokens(df, "t").agg(F.count("*").alias("n"), F.countDistinct("position").alias("places"), F.max("position").alias("last")).first()
    assert found.n == found.places == found["last"] + 1 == 330000 * 10


def test_query_of_words_leaves_the_texts_behind(spark):
    """Each word once with its place: a text beside each of its words would be the square of its length."""
    sf = "/root/testdata/sf0.001"
    got, docs = QUERIES["word_windows"](spark, sf), spark.read.parquet(f"{sf}/documents.parquet")
    assert got.columns == ["doc_id", "position", "token"]
    want = tables.tokens(docs.select("doc_id", "text"), "text").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
