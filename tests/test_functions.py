"""Column functions against the values that the reference's behaviour fixes."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import formatting as fmt
from glyphmill.functions import locales as loc
from glyphmill.functions import matching as m
from glyphmill.functions import text as t
from glyphmill.operators import tables
from glyphmill.sources import catalogues as cat
from glyphmill.sources import files


@pytest.fixture(scope="module")
def value(spark):
    """The value of a column expression over one literal text."""

    def of(expression, text=""):
        return spark.createDataFrame([(text,)], "x string").select(expression.alias("v")).first().v

    return of


X = None


@pytest.fixture(scope="module", autouse=True)
def _column(spark):
    """The column under test; columns need a session."""
    global X
    X = F.col("x")


@pytest.mark.parametrize(("form", "text", "want"), [("NFKC", "ﬁ", "fi"), ("NFKD", "①", "1"), ("nfc", "e\u0301", "\u00e9"), ("NFD", "\u00e9", "e\u0301"), ("NFC", None, None)])
def test_normalize(value, form, text, want):
    assert value(t.normalize(X, form), text) == want


def test_normalization_form_is_checked(spark):
    with pytest.raises(ValueError):
        t.normalize(X, "INVALID")


def test_is_normalized(value):
    assert value(t.is_normalized(X), "caf\u00e9") and not value(t.is_normalized(X), "cafe\u0301")


def test_characters(value):
    info = value(t.char_info(X), "α")
    assert (info.codepoint, info.name, info.category, info.script) == ("U+03B1", "GREEK SMALL LETTER ALPHA", "Ll", "Greek")
    assert [value(t.char_category(X), c) for c in "Aa5 !"] == ["Lu", "Ll", "Nd", "Zs", "Po"]
    assert value(t.char_info(X), "ab") is None and value(t.codepoint(X), "🙂") == "U+1F642"


def test_scripts(value):
    assert value(t.detect_script(X), "") == "Unknown" and value(t.detect_script(X), "123abc") == "Common"
    assert value(t.detect_scripts(X), "Hello 世界 Привет") == ["Latin", "Han", "Cyrillic"] and value(t.detect_scripts(X), "") == []
    assert value(t.is_rtl(X), "שלום") and not value(t.is_rtl(X), "") and value(t.char_script(X), "ab") is None


def test_bidi(value):
    assert value(t.bidi_info(X), "Hello שלום").direction == "mixed" and value(t.bidi_info(X), "12345").direction == "neutral"
    assert value(t.strip_bidi_controls(X), "a\u202eb\u202cc\u200fd") == "abcd" and value(t.bidi_info(X), "a\u202eb").bidi_control_count == 1


def test_breaks(value):
    assert value(t.break_sentences(X), "Hello world. How are you?") == ["Hello world. ", "How are you?"]
    assert value(t.break_words(X), "Hello, world!") == ["Hello", ",", "world", "!"]
    assert value(t.break_words(X, skip_punctuation=True), "Hello, world!") == ["Hello", "world"]
    assert "".join(value(t.break_lines(X), "one two-three four")) == "one two-three four"
    assert value(t.break_graphemes(X), "é👨‍👩‍👧") == ["é", "👨‍👩‍👧"] and value(t.break_words(X), "") == []
    assert value(t.tokenize_sentences(X), "Hi there. Bye.") == [["Hi", "there", "."], ["Bye", "."]]


def test_transliteration(value):
    assert value(t.transliterate(X, "Latin-Cyrillic"), "hello") == "хелло" and value(t.remove_accents(X), "café résumé") == "cafe resume"
    assert value(t.to_title(X), "hello world") == "Hello World" and value(t.transliterate(X, "no-such"), "a") is None
    assert value(t.transliterate_rules(X, "a > b;"), "abc") == "bbc"


def test_spoofing(value):
    info = value(t.confusable_info(F.lit("paypal"), F.lit("pаypal")))
    assert info.confusable and "mixed_script" in info.type_names and info.same_skeleton and info.skeleton1 == "paypal"
    assert value(t.are_confusable(F.lit("a"), F.lit("a"))) and not value(t.are_confusable(F.lit("hello"), F.lit("world")))
    assert value(t.check_string(X), "pаypal").is_suspicious


def test_domains(value):
    assert value(t.idna_encode(X), "münchen.de") == "xn--mnchen-3ya.de" and value(t.idna_decode(X), "xn--mnchen-3ya.de") == "münchen.de"
    assert value(t.idna_encode_label(X), "münchen") == "xn--mnchen-3ya" and value(t.idna_encode(X), "example.com") == "example.com"
    assert value(t.idna_encode(X), "a..b") is None and value(t.is_ascii(X), "abc") and not value(t.is_ascii(X), "é")


@pytest.mark.parametrize(("style", "want"), [("u", "\\u0041\\u00e9"), ("U", "\\U00000041\\U000000e9"), ("x", "\\x41\\xc3\\xa9"), ("uplus", "U+0041 U+00E9")])
def test_escapes(value, style, want):
    assert value(t.escape_encode(X, style), "Aé") == want
    assert value(t.escape_decode(F.lit("\\u0041\\U000000e9 U+0042 \\x43"))) == "Aé B C"


def test_regex(value):
    assert [r.text for r in value(m.regex_find_all(X, r"\p{IsHan}+"), "Hello 世界 and 你好")] == ["世界", "你好"]
    first = value(m.regex_find(X, r"(\d)(\d+)", start=7), "abc123def456")
    assert (first.text, first.start, first.end, first.groups) == ("456", 9, 12, {1: "4", 2: "56"})
    assert value(m.regex_replace(X, r"\d+", "X", limit=2), "a1b2c3d4") == "aXbXc3d4" and value(m.regex_replace(X, r"(a)(b)", "$2$1"), "abab") == "baba"
    assert value(m.regex_split(X, ",", limit=2), "a,b,c,d") == ["a", "b", "c,d"] and value(m.regex_split(X, ","), "a,,b,") == ["a", "", "b", ""]
    assert value(m.regex_match(X, "a|ab"), "ab") and not value(m.regex_match(X, "a"), "ab") and value(m.regex_search(X, "É", m.CASE_INSENSITIVE), "é")
    assert m.escape("a.b*c|d") == r"a\.b\*c\|d" and value(m.sed(X, "s#A#b#gi"), "aAa") == "bbb" and value(m.sed(X, r"s/(a)(b)/\2\1/"), "abab") == "baab"
    assert value(m.regex_find_all(X, r"\w+"), "") == [] and value(m.regex_find(X, "z"), "abc") is None


def test_collation(spark, value):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate("öoz")], "k int, x string")
    assert [r.x for r in tables.sort_table(rows, "x", "sv_SE", ordinal="k").collect()] == ["o", "z", "ö"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["a", "A", "b"])], "k int, x string")
    assert [r.x for r in tables.sort_table(rows, "x", case_first="upper").collect()] == ["A", "a", "b"]
    assert [r.x for r in tables.sort_table(rows, "x", strength="primary", reverse=True, ordinal="k").collect()] == ["b", "a", "A"]
    assert value(m.compare(F.lit("cafe"), F.lit("café"))) == -1 and value(m.compare(F.lit("cafe"), F.lit("café"), strength="primary")) == 0
    assert value(m.compare(F.lit("cafe"), F.lit("café"), strength="secondary")) != 0 and value(m.sort_key(F.lit("apple"))) < value(m.sort_key(F.lit("banana")))
    assert [r.x for r in tables.unique_sorted(spark.createDataFrame([("b",), ("a",), ("b",)], "x string"), "x").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        m.compare(X, X, strength="odd")


def test_search(value):
    found = value(m.search_first(X, "cafe"), "The cafe is here")
    assert (found.start, found.end, found.text) == (4, 8, "cafe")
    assert value(m.search_count(X, "cafe", strength="primary"), "café Cafe CAFE") == 3 and value(m.search_count(X, "cafe", strength="secondary"), "cafe Cafe café") == 2
    assert value(m.search_replace(X, "a", "X", count=2), "abracadabra") == "XbrXcadabra" and value(m.search_all(X, "a"), "") == [] and value(m.search_all(X, ""), "abc") == []
    assert value(m.search_first(X, "b"), "🙂ab").start == 2


def test_index(spark):
    rows = spark.createDataFrame([(n,) for n in ("Zebra", "Alice", "Bob", "Amanda", "Carol", "Anna")], "x string")
    found = {r.bucket: r.names for r in tables.index_buckets(rows, "x").collect()}
    assert found == {"A": ["Alice", "Amanda", "Anna"], "B": ["Bob"], "C": ["Carol"], "Z": ["Zebra"]}


def test_numbers(value):
    n = F.lit(1234567.891)
    assert value(fmt.format_number(n)) == "1,234,567.891" and value(fmt.format_number(n, "de_DE")) == "1.234.567,891" and value(fmt.format_percent(F.lit(0.5))) == "50%"
    assert value(fmt.format_compact(F.lit(1234567))) == "1.2M" and value(fmt.format_compact(F.lit(1234567), style="LONG")) == "1.2 million"
    assert value(fmt.format_currency(F.lit(1234.5))) == "$1,234.50" and value(fmt.format_currency(F.lit(1.5), "en_US", "EUR")) == "€1.50"
    assert value(fmt.format_spellout(F.lit(42))) == "forty-two" and value(fmt.format_ordinal(F.lit(3))) == "3rd" and value(fmt.format_scientific(F.lit(12345))) == "1.2345E4"


@pytest.mark.parametrize(("text", "locale", "want"), [("1,234.56", "en_US", 1234.56), ("1.234.567,89", "de_DE", 1234567.89), ("-1,234", "en_US", -1234.0), ("", "en_US", None), ("x", "en_US", None)])
def test_parse_numbers(value, text, locale, want):
    assert value(fmt.parse_number(X, locale), text) == want


def test_parse_others(value):
    assert value(fmt.parse_percent(X), "125%") == 1.25
    assert tuple(value(fmt.parse_currency(X), "$5.25")) == (5.25, "USD")


def test_plurals(value):
    assert [value(fmt.plural_category(F.lit(n))) for n in (0, 1, 2, 5)] == ["other", "one", "other", "other"]
    assert [value(fmt.plural_category(F.lit(n), "ru_RU")) for n in (1, 21, 2, 22, 0, 5, 11)] == ["one", "one", "few", "few", "many", "many", "many"]
    assert [value(fmt.ordinal_category(F.lit(n))) for n in (1, 2, 3, 4, 11)] == ["one", "two", "few", "other", "other"]


def test_measures(value):
    assert value(fmt.convert_units(F.lit(100), "celsius", "fahrenheit")) == 212.0 and value(fmt.convert_units(F.lit(5), "meter", "meter")) == 5.0
    assert value(fmt.format_measure(F.lit(5), "kilometer")) == "5 kilometers" and value(fmt.format_measure(F.lit(5), "kilometer", width="SHORT")) == "5 km"
    assert value(fmt.format_measures([(F.lit(5), "foot"), (F.lit(10), "inch")])) == "5 feet 10 inches"
    assert value(fmt.format_measure_range(F.lit(5), F.lit(10), "kilometer")) == "5–10 kilometers"
    with pytest.raises(ValueError):
        fmt.convert_units(F.lit(1), "meter", "liter")


def test_durations(value):
    assert value(fmt.format_duration(F.lit(3661))) == "1 hour 1 minute 1 second" and value(fmt.format_duration(F.lit(0))) == "0 seconds"
    parts = value(fmt.parse_iso_duration(X), "P1Y2M3W4DT5H6M7S")
    assert tuple(parts) == (1, 2, 3, 4, 5, 6, 7) and value(fmt.parse_iso_duration(X), "2DT3H") is None and value(fmt.parse_iso_duration(X), "PT1.5H").hours == 1.5
    assert value(fmt.format_iso_duration(X), "P2W") == "2 weeks"


def test_lists_and_messages(value):
    items = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(fmt.format_list(items("a", "b", "c"))) == "a, b, and c" and value(fmt.format_list(items("a", "b"), style="or")) == "a or b"
    assert value(fmt.format_list(items("a"))) == "a" and value(fmt.format_list(items())) == ""
    pattern = "{n, plural, =0 {none} one {# item} other {# items}} for {who}"
    got = [value(fmt.format_message(pattern, {"n": F.lit(n), "who": F.lit("me")}, types={"n": "number"})) for n in (0, 1, 5)]
    assert got == ["none for me", "1 item for me", "5 items for me"]


def test_dates(value):
    ts = F.lit(datetime.datetime(2024, 1, 15, 14, 30)).cast("timestamp_ntz")
    assert value(fmt.format_datetime(ts, pattern="ISO_DATE")) == "2024-01-15" and value(fmt.format_datetime(ts, pattern="HH:mm")) == "14:30"
    assert value(fmt.format_datetime(ts, date_style="LONG", time_style="NONE")) == "January 15, 2024" and "5784" in value(fmt.format_datetime(ts, calendar="hebrew", style="LONG"))
    assert value(fmt.parse_datetime(F.lit("2024-01-15"), pattern="yyyy-MM-dd").cast("timestamp_ntz")) == datetime.datetime(2024, 1, 15)
    assert value(fmt.parse_datetime(F.lit("1/15/24")).cast("timestamp_ntz")) == datetime.datetime(2024, 1, 15) and value(fmt.parse_datetime(F.lit("no date"))) is None
    span = value(fmt.format_interval(ts, ts + F.expr("INTERVAL 5 DAYS")))
    assert "15" in span and "20" in span
    assert [value(fmt.format_relative(F.lit(s))) for s in (-86_400, 7_200, 30, 5_400)] == ["1 day ago", "in 2 hours", "in 30 seconds", "in 1.5 hours"]


def test_locales(value):
    assert value(loc.display_name(F.lit("ja_JP"), "locale")) == "Japanese (Japan)" and value(loc.display_name(F.lit("usd"), "symbol")) == "$" and value(loc.display_name(F.lit("zzzz"), "currency")) == "ZZZZ"
    assert value(loc.add_likely_subtags(F.lit("zh"))) == "zh_Hans_CN" and value(loc.canonicalize(F.lit("iw"))) == "he" and value(loc.parse_locale(F.lit("sr_Latn_RS"))).script == "Latn"
    assert value(loc.is_valid_locale(F.lit("en_US"))) and not value(loc.is_valid_locale(F.lit("xx_YY"))) and value(loc.timezone_offset(F.lit("America/New_York"))) == -5.0
    assert value(loc.timezone_info(F.lit("Nowhere/City"))) is None


def test_catalogues(spark):
    assert cat.locales(spark).count() > 800 and cat.regions(spark).count() > 200 and cat.timezones(spark).count() > 600 and cat.scripts(spark).count() > 50 and cat.calendars(spark).count() >= 17
    us = cat.regions(spark).filter("code = 'US'").first()
    assert (us.numeric_code, us.name, us.containing_region) == (840, "United States", "021") and cat.regions(spark, "continent").count() == 5
    assert cat.units(spark, "length").filter("identifier = 'kilometer'").count() == 1 and cat.transliterators(spark).count() > 300 and cat.categories(spark).count() == 30
    assert cat.exemplars(spark, "el_GR").filter("char = 'α'").count() == 1 and cat.characters(spark, "[:block=Arrows:]").count() == 112 and cat.bidi_controls(spark).count() == 12
    assert [r.label for r in cat.index_labels(spark).orderBy("ordinal").collect()][:3] == ["A", "B", "C"] and cat.equivalent_timezones(spark, "Asia/Kolkata").filter("id = 'Asia/Calcutta'").count() == 1
    assert cat.blocks(spark).filter("name = 'BASIC_LATIN' AND start = 0 AND end = 127").count() == 1 and cat.collation_types(spark).filter("type = 'standard'").count() == 1
    assert cat.collator_info(spark, "sv_SE").first().has_tailoring and cat.plural_info(spark, "en_US", ordinal=True).count() == 4 and cat.properties(spark).count() > 30


def test_selectors_and_fan_out(spark):
    rows = spark.createDataFrame([("Latin",), ("Greek",), ("Han",)], "x string")
    pick = lambda s: [r.x for r in rows.filter(tables.selected(F.col("x"), s, ["Latin", "Han"])).collect()]
    assert pick("latin, HAN") == ["Latin", "Han"] and pick("any") == ["Latin", "Greek", "Han"] and pick("major") == ["Latin", "Han"] and pick("gr.*") == ["Greek"] and pick("none") == []
    assert [r.result for r in tables.transliterate_all(spark.createDataFrame([("hello",)], "x string"), "x", ["Latin-Cyrillic", "bad"]).collect()] == ["хелло", None]


def test_files_and_streams(spark, tmp_path):
    from glyphmill import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello 世界\n\nПривет\n", encoding="utf-8")
    assert files.read_lines(spark, str(tmp_path / "in")).count() == 2 and files.read_whole(spark, str(tmp_path / "in")).count() == 1
    out = streaming.apply_to_stream(files.stream_lines(spark, str(tmp_path / "in")), {"scripts": t.detect_scripts, "latin": t.to_latin})
    streaming.write_stream(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.latin for r in spark.read.json(str(tmp_path / "out")).collect()) == ["Hello shì jiè", "Privet"]
    rows = spark.createDataFrame([(1, True, ["a", "b"], None), (2, False, [], "")], "n int, b boolean, a array<string>, s string")
    assert [r.line for r in files.as_tsv(rows).orderBy("line").collect()] == ["1\tyes\ta,b\t-", "2\tno\t-\t-"]
    assert files.as_sections(spark.createDataFrame([("x", "b"), ("x", "a")], "g string, i string"), "g", "i").first().line == "x:\na\nb"
