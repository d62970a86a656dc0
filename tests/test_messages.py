"""Compiled message patterns against the library's own formatter."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import formatting as fmt
from glyphmill.functions import messages

MESSAGES = [
    "plain text", "it''s '{quoted}' and a lone ' one", "{who} and {who}", "{n}", "{n, number}", "{n, number, percent}", "{n, number, integer}",
    "{n, plural, one {# item} other {# items}}", "{n, plural, =0 {none} =1 {a single one} one {# item} other {# of {who}'s items}}",
    "{n, plural, offset:1 =0 {nobody} =1 {{who}} one {{who} and # other} other {{who} and # others}}",
    "{n, selectordinal, one {#st} two {#nd} few {#rd} other {#th}}", "{who, select, me {I} Ann {she} other {they}} said so",
    "{who, select, me {I have {n, plural, =0 {nothing} one {one # thing} other {# things}}} other {{who}: # {n}}}", "{missing} and {n, plural, other {'#' is #}}",
]


@pytest.mark.parametrize("locale", ["en_US", "de_DE", "ru_RU", "ar_EG"])
def test_compiled_messages(spark, locale):
    rows = spark.createDataFrame([(n, w) for n in (0, 1, 2, 3, 5, 11, 21, 1234567) for w in ("me", "Ann", "", None)], "n int, who string")
    args, types = {"n": F.col("n"), "who": F.col("who")}, {"n": "number"}
    for pattern in MESSAGES:
        both = rows.select("n", "who", messages.compile_message(pattern, args, locale, types).alias("made"), fmt.format_message(pattern, args, locale, types).alias("told"))
        assert [r for r in both.collect() if r.made != r.told] == [], pattern


def test_messages_without_calls(spark):
    made = messages.compile_message("{k, select, a {first} other {{n, plural, =0 {no {k}} other {some}}}}", {"k": F.col("k"), "n": F.col("n")})
    df = spark.createDataFrame([("a", 1), ("b", 0), ("b", 2), (None, 2), ("b", None)], "k string, n int").select(made.alias("m"))
    assert [r.m for r in df.collect()] == ["first", "no b", "some", "some", None]
    assert "glyphmill_text" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("pattern", ["{", "}", "{n", "{n, plural}", "{n, plural, one {x}}", "{n, plural, =x {y} other {z}}", "{n, select, a b}", "{x, plural, other {y}}", "{n, plural, offset:a other {y}}", "{}"])
def test_wrong_messages(pattern):
    with pytest.raises(ValueError):
        messages.compile_message(pattern, {"n": F.lit(1)})
