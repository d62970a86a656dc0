"""Registered queries over the driver tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import formatting as fmt
from glyphmill.functions import locales as loc
from glyphmill.functions import matching as m
from glyphmill.functions import messages
from glyphmill.functions import text as t
from glyphmill.operators import joins, ranges, tables, windows
from glyphmill.sources import catalogues as cat
from glyphmill.sources import files
from glyphmill.sources.scratch import new_path
from glyphmill.streaming import index, windowed_counts, write_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(table: str | None = None, sql: str | None = None):
    """Register a query under its function's name; with `table`, it takes that table."""

    def add(f):
        name = f.__name__
        QUERIES[name] = (lambda spark, sf: f(spark.read.parquet(f"{sf}/{table}.parquet"))) if table else f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- regular expressions ------------------------------------------------------------------------------------------


@_query("documents", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{Lu}\p{Ll}+')) AS INTEGER) AS n FROM documents")
def regex_count(docs):
    return docs.select("doc_id", m.regex_count(F.col("text"), r"\p{Lu}\p{Ll}+").alias("n"))


@_query("pages", r"SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 2) AS host FROM pages")
def regex_groups(pages):
    found = m.regex_find(F.col("url"), r"^(https?)://([^/]+)/?(.*)$")
    return pages.select("page_id", F.coalesce(found["groups"][1], F.lit("")).alias("scheme"), F.coalesce(found["groups"][2], F.lit("")).alias("host"))


@_query("conversations", r"SELECT conv_id, turn, strpos(text, regexp_extract(text, '\p{Lu}\p{Ll}+')) - 1 AS first_start, CAST(len(regexp_extract_all(text, '\p{Lu}\p{Ll}+')) AS BIGINT) AS n FROM conversations WHERE regexp_matches(text, '\p{Lu}\p{Ll}+')")
def regex_find_offsets(conv):
    found = m.regex_find_all(F.col("text"), r"\p{Lu}\p{Ll}+")
    out = conv.select("conv_id", "turn", found.alias("f")).filter(F.size("f") > 0)
    return out.select("conv_id", "turn", F.col("f")[0]["start"].cast("long").alias("first_start"), F.size("f").cast("long").alias("n"))


@_query("pages", r"SELECT page_id, regexp_replace(url, '([a-z]+)\.([a-z]+)', '\2.\1', 'g') AS swapped, regexp_replace(url, '[aeiou]', '_') AS once FROM pages")
def regex_replace(pages):
    return pages.select("page_id", m.regex_replace(F.col("url"), r"([a-z]+)\.([a-z]+)", "$2.$1").alias("swapped"), m.regex_replace(F.col("url"), "[aeiou]", "_", limit=1).alias("once"))


@_query("documents", r"SELECT doc_id, CAST(len(string_split_regex(text, '[.!?]\s*')) AS INTEGER) AS parts FROM documents")
def regex_split(docs):
    return docs.select("doc_id", F.size(m.regex_split(F.col("text"), r"[.!?]\s*")).alias("parts"))


@_query("part", r"SELECT p_partkey, regexp_full_match(p_name, '[a-z]+( [a-z]+)*') AS matched, regexp_matches(p_brand, '#1') AS found FROM part")
def regex_match_search(part):
    return part.select("p_partkey", m.regex_match(F.col("p_name"), "[a-z]+( [a-z]+)*").alias("matched"), m.regex_search(F.col("p_brand"), "#1").alias("found"))


@_query("customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N') AS sed_once, regexp_replace(c_name, '[aeiou]', '', 'gi') AS sed_all FROM customer")
def regex_sed(customer):
    return customer.select("c_custkey", m.sed(F.col("c_name"), "s/[0-9]+/N/").alias("sed_once"), m.sed(F.col("c_name"), "s|[aeiou]||gi").alias("sed_all"))


@_query("part", "SELECT p_partkey, contains(p_type, 'A') AS escaped, len(regexp_extract_all(p_type, '(?i)o')) AS n_o FROM part")
def regex_escape_flags(part):
    return part.select("p_partkey", m.regex_search(F.col("p_type"), m.escape("A")).alias("escaped"), m.regex_count(F.col("p_type"), "o", m.CASE_INSENSITIVE).cast("long").alias("n_o"))


# --- normalization and characters ---------------------------------------------------------------------------------


@_query("documents", "SELECT doc_id, md5(nfc_normalize(text)) AS nfc, nfc_normalize(text) = text AS is_nfc FROM documents")
def normalize_nfc(docs):
    return docs.select("doc_id", F.md5(t.normalize(F.col("text")).cast("binary")).alias("nfc"), t.is_normalized(F.col("text")).alias("is_nfc"))


@_query("documents", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def remove_accents(docs):
    return docs.select("doc_id", F.md5(t.remove_accents(F.col("text")).cast("binary")).alias("plain"))


@_query(sql="SELECT * FROM (VALUES (1, 'fi', 'ﬁ', 'NFKC'), (2, '1', '①', 'NFKD'), (3, 'é', 'é', 'NFC'), (4, '가', '가', 'NFKC')) v(id, normal, text, form)")
def normalize_forms(spark, _):
    rows = [(1, "ﬁ", "NFKC"), (2, "①", "NFKD"), (3, "é", "NFC"), (4, "가", "NFKC")]
    df = _literals(spark, rows, "id int, text string, form string")
    return df.withColumn("normal", F.coalesce(*[F.when(F.col("form") == f, t.normalize(F.col("text"), f)) for f in t.FORMS]))


@_query("conversations", "SELECT conv_id, turn, length_grapheme(text) AS graphemes FROM conversations")
def grapheme_length(conv):
    return conv.select("conv_id", "turn", F.size(t.break_graphemes(F.col("text"))).cast("long").alias("graphemes"))


@_query(
    "documents",
    r"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(c, '\p{Lu}') THEN 'Lu' WHEN regexp_matches(c, '\p{Ll}') THEN 'Ll' WHEN regexp_matches(c, '\p{Nd}') THEN 'Nd'
        WHEN regexp_matches(c, '\p{Zs}') THEN 'Zs' WHEN regexp_matches(c, '\p{Po}') THEN 'Po' WHEN regexp_matches(c, '\p{Sm}') THEN 'Sm' WHEN regexp_matches(c, '\p{Sc}') THEN 'Sc'
        WHEN regexp_matches(c, '\p{Cc}') THEN 'Cc' ELSE 'other' END AS category FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '') GROUP BY 1""",
)
def char_category_histogram(docs):
    chars = docs.select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    kind = t.char_category(F.col("c"))
    named = chars.select(F.when(kind.isin("Lu", "Ll", "Nd", "Zs", "Po", "Sm", "Sc", "Cc"), kind).otherwise("other").alias("category"), "n")
    return named.groupBy("category").agg(F.sum("n").alias("n"))


@_query("customer", "SELECT c_custkey, printf('U+%04X', unicode(c_name)) AS point, c_mktsegment AS seg, printf('U+%04X', unicode(c_mktsegment)) AS seg_point FROM customer")
def char_codepoint(customer):
    return customer.select("c_custkey", t.codepoint(F.col("c_name")).alias("point"), F.col("c_mktsegment").alias("seg"), t.codepoint(F.col("c_mktsegment")).alias("seg_point"))


@_query(sql="""SELECT * FROM (VALUES ('α', 'U+03B1', 'GREEK SMALL LETTER ALPHA', 'Ll', 'Greek', true, true), ('A', 'U+0041', 'LATIN CAPITAL LETTER A', 'Lu', 'Latin', true, false),
    ('5', 'U+0035', 'DIGIT FIVE', 'Nd', 'Common', false, false), (' ', 'U+0020', 'SPACE', 'Zs', 'Common', false, false), ('!', 'U+0021', 'EXCLAMATION MARK', 'Po', 'Common', false, false))
    v(c, codepoint, name, category, script, is_letter, is_lower)""")
def char_info(spark, _):
    df = _literals(spark, [(c,) for c in "αA5 !"], "c string").select("c", t.char_info(F.col("c")).alias("i"))
    return df.select("c", "i.codepoint", "i.name", "i.category", "i.script", "i.is_letter", "i.is_lower")


# --- scripts, direction, look-alikes, domains ---------------------------------------------------------------------


@_query("documents", r"SELECT doc_id, CASE WHEN regexp_matches(left(text, 1), '\p{Latin}') THEN 'Latin' ELSE 'Common' END AS script, CAST(regexp_matches(text, '\p{Latin}') AS INTEGER) AS n_scripts FROM documents")
def script_detect(docs):
    return docs.select("doc_id", t.detect_script(F.col("text")).alias("script"), F.size(t.detect_scripts(F.col("text"))).alias("n_scripts"))


@_query(sql="""SELECT * FROM (VALUES ('Hello', 'Latin', false, 'ltr'), ('Ελληνικά', 'Greek', false, 'ltr'), ('你好', 'Han', false, 'ltr'), ('مرحبا', 'Arabic', true, 'rtl'), ('Привет', 'Cyrillic', false, 'ltr'),
    ('שלום', 'Hebrew', true, 'rtl'), ('12345', 'Common', false, 'neutral'), ('', 'Unknown', false, 'neutral')) v(text, script, rtl, direction)""")
def script_literals(spark, _):
    rows = [(x,) for x in ("Hello", "Ελληνικά", "你好", "مرحبا", "Привет", "שלום", "12345", "")]
    df = _literals(spark, rows, "text string")
    return df.select("text", t.detect_script(F.col("text")).alias("script"), t.is_rtl(F.col("text")).alias("rtl"), t.bidi_info(F.col("text"))["direction"].alias("direction"))


@_query("conversations", r"SELECT conv_id, turn, false AS has, length(text) AS n, CASE WHEN regexp_matches(text, '\p{L}') THEN 'ltr' ELSE 'neutral' END AS base FROM conversations")
def bidi_controls(conv):
    # a control is put into each text and taken out again
    marked = F.concat(F.lit("‏"), F.col("text"), F.lit("‬"))
    clean = t.strip_bidi_controls(marked)
    return conv.select("conv_id", "turn", t.has_bidi_controls(clean).alias("has"), F.length(clean).cast("long").alias("n"), t.base_direction(clean).alias("base"))


@_query(sql="SELECT * FROM (VALUES ('paypal', 'pаypal', true, 'paypal'), ('hello', 'world', false, 'world'), ('pool', 'pool', true, 'pool')) v(a, b, confusable, skeleton)")
def spoof_compare(spark, _):
    df = _literals(spark, [("paypal", "pаypal"), ("hello", "world"), ("pool", "pool")], "a string, b string")
    return df.select("a", "b", t.are_confusable(F.col("a"), F.col("b")).alias("confusable"), t.skeleton(F.col("b")).alias("skeleton"))


@_query("nation", "SELECT n_nationkey, contains(n_name, 'A') AS mixed, true AS alike FROM nation")
def spoof_check(nation):
    """Names with a Cyrillic letter put in the place of A: those that have one mix scripts."""
    name = F.translate("n_name", "A", "А")
    mixed = t.check_string(F.lower(name))["flags"] != t.check_string(F.lower("n_name"))["flags"]
    return nation.select("n_nationkey", mixed.alias("mixed"), t.are_confusable(name, F.col("n_name")).alias("alike"))


@_query("pages", r"SELECT page_id, regexp_extract(url, '://([^/:]+)', 1) AS host, true AS ascii FROM pages")
def idna_hosts(pages):
    host = F.regexp_extract("url", "://([^/:]+)", 1)
    return pages.select("page_id", t.idna_decode(t.idna_encode(host)).alias("host"), t.is_ascii(t.idna_encode(host)).alias("ascii"))


@_query(sql="SELECT * FROM (VALUES ('münchen.de', 'xn--mnchen-3ya.de', 'münchen.de'), ('example.com', 'example.com', 'example.com'), ('bücher.example', 'xn--bcher-kva.example', 'bücher.example')) v(domain, encoded, decoded)")
def idna_literals(spark, _):
    df = _literals(spark, [("münchen.de",), ("example.com",), ("bücher.example",)], "domain string")
    return df.select("domain", t.idna_encode(F.col("domain")).alias("encoded"), t.idna_decode(t.idna_encode(F.col("domain"))).alias("decoded"))


# --- segmentation -------------------------------------------------------------------------------------------------


@_query(
    "documents",
    r"""SELECT lang, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank FROM (SELECT lang, word, count(*) AS n FROM
        (SELECT lang, unnest(regexp_extract_all(strip_accents(lower(text)), '\p{L}+')) AS word FROM documents) GROUP BY 1, 2)) WHERE rank <= 10""",
)
def top_words_by_language(docs):
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # accents go after the first aggregation: once for each distinct word
    plain = counts.groupBy("lang", t.remove_accents(F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    ranked = plain.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word")))
    return ranked.filter("rank <= 10")


@_query("documents")
def break_words(docs):
    words = F.filter(t.break_words(F.col("text"), skip_punctuation=True), lambda w: F.regexp_like(w, F.lit(r"\p{L}")))
    return docs.select("doc_id", F.size(words).cast("long").alias("words"))


@_query("conversations")
def break_sentences(conv):
    return conv.select("conv_id", "turn", F.size(t.break_sentences(F.col("text"))).alias("sentences"), F.size(t.tokenize_sentences(F.col("text"), skip_punctuation=True)).alias("with_words"))


@_query("conversations", "SELECT conv_id, turn, md5(text) AS joined FROM conversations")
def break_lines(conv):
    return conv.select("conv_id", "turn", F.md5(F.array_join(t.break_lines(F.col("text")), "").cast("binary")).alias("joined"))


@_query("conversations")
def break_words_rows(conv):
    return tables.tokens(conv.select("conv_id", "turn", "text"), "text", "word").groupBy("token").agg(F.count("*").alias("n"))


# --- transliteration and escapes ----------------------------------------------------------------------------------


@_query(sql="SELECT * FROM (VALUES ('Привет мир', 'Privet mir'), ('café résumé', 'cafe resume'), ('Ελλάδα', 'Ellada')) v(text, ascii)")
def transliterate_ascii(spark, _):
    df = _literals(spark, [("Привет мир",), ("café résumé",), ("Ελλάδα",)], "text string")
    return df.select("text", t.to_ascii(F.col("text")).alias("ascii"))


@_query("part", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part")
def transliterate_case(part):
    return part.select("p_partkey", t.to_upper(F.col("p_name")).alias("up"), t.to_lower(F.col("p_type")).alias("low"))


@_query("nation")
def transliterate_fan_out(nation):
    return tables.transliterate_all(nation.select("n_nationkey", "n_name"), "n_name", ["Latin-Cyrillic", "Latin-Greek", "no-such-id"])


@_query("nation", "SELECT n_nationkey, replace(replace(n_name, 'A', '4'), 'E', '3') AS leet FROM nation")
def transliterate_rules(nation):
    return nation.select("n_nationkey", t.transliterate_rules(F.col("n_name"), "A > 4; E > 3;").alias("leet"))


@_query(
    "conversations",
    r"""SELECT conv_id, turn, md5(text) AS back, CASE WHEN regexp_matches(text, '[^\x20-\x7E]') THEN NULL ELSE text END AS plain FROM conversations""",
)
def escape_round_trip(conv):
    coded = t.escape_encode(F.col("text"), "u")
    plain = F.when(~F.regexp_like("text", F.lit(r"[^\x20-\x7E]")), t.escape_decode(t.escape_encode(F.col("text"), "x")))
    return conv.select("conv_id", "turn", F.md5(t.escape_decode(coded).cast("binary")).alias("back"), plain.alias("plain"))


# --- collation and search -----------------------------------------------------------------------------------------


@_query("part", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_name COLLATE de, p_partkey) AS INTEGER) AS rank FROM part")
def collation_sort(part):
    return tables.ranked(part.select("p_partkey", "p_name"), m.sort_key(F.col("p_name"), "de_DE"), "p_partkey").select("p_partkey", "rank")


@_query("documents", r"SELECT word, rank FROM (SELECT word, CAST(dense_rank() OVER (ORDER BY icu_sort_key(word, 'de')) AS INTEGER) AS rank FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}]+')) AS word FROM documents))")
def collation_unique_sorted(docs):
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word")).distinct()
    return tables.ranked(words, m.sort_key(F.col("word"), "de_DE"), dense=True)


@_query("nation", "SELECT a.n_nationkey, CAST(CASE WHEN icu_sort_key(a.n_name, 'en') < icu_sort_key('Japan', 'en') THEN -1 WHEN icu_sort_key(a.n_name, 'en') > icu_sort_key('Japan', 'en') THEN 1 ELSE 0 END AS INTEGER) AS sign FROM nation a")
def collation_compare(nation):
    return nation.select("n_nationkey", m.compare(F.col("n_name"), F.lit("Japan")).alias("sign"))


@_query(
    "documents",
    r"SELECT count(DISTINCT replace(replace(replace(lower(strip_accents(word)), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS word FROM documents)",
)
def collation_primary_groups(docs):
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word")).distinct()
    return words.select(m.sort_key(F.col("word"), "en_US", "primary").alias("k")).agg(F.countDistinct("k").alias("n"))


@_query("documents", "SELECT doc_id, (length(p) - length(replace(p, 'tion', ''))) // 4 AS n FROM (SELECT doc_id, lower(strip_accents(text)) AS p FROM documents)")
def search_count(docs):
    return docs.select("doc_id", m.search_count(F.col("text"), "TION", "en_US", "primary").cast("long").alias("n"))


@_query("part", "SELECT p_partkey, replace(p_type, 'STEEL', 'x') AS replaced, contains(lower(p_type), 'steel') AS has FROM part")
def search_replace(part):
    return part.select("p_partkey", m.search_replace(F.col("p_type"), "STEEL", "x", strength="tertiary").alias("replaced"), m.search_contains(F.col("p_type"), "steel", strength="primary").alias("has"))


@_query(sql="SELECT 'The cafe is here' AS text, 4 AS start, 8 AS \"end\", 'cafe' AS match")
def search_first(spark, _):
    df = _literals(spark, [("The cafe is here",)], "text string").select("text", m.search_first(F.col("text"), "cafe").alias("f"))
    return df.select("text", "f.start", "f.end", F.col("f.text").alias("match"))


@_query("nation", "SELECT upper(left(n_name, 1)) AS bucket, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def index_buckets(nation):
    return tables.index_rows(nation, "n_name").groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("n_name", "place").alias("first"))


# --- numbers, plurals, measures, durations -------------------------------------------------------------------------


@_query("orders", "SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS en FROM orders")
def format_number_en(orders):
    return orders.select("o_orderkey", fmt.format_number(F.col("o_totalprice")).alias("en"))


@_query("orders", "SELECT o_orderkey, replace(replace(replace(regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), ',', '_'), '.', ','), '_', '.') AS de FROM orders")
def format_number_de(orders):
    return orders.select("o_orderkey", fmt.format_number(F.col("o_totalprice"), "de_DE").alias("de"))


@_query("orders", "SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS usd FROM orders")
def format_currency(orders):
    return orders.select("o_orderkey", fmt.format_currency(F.col("o_totalprice")).alias("usd"))


@_query("lineitem", "SELECT l_discount, CAST(round(l_discount * 100) AS INTEGER) || '%' AS pct, count(*) AS n FROM lineitem GROUP BY 1")
def format_percent(lineitem):
    counts = lineitem.groupBy("l_discount").agg(F.count("*").alias("n"))
    return counts.select("l_discount", fmt.format_percent(F.col("l_discount")).alias("pct"), "n")


@_query(sql="SELECT * FROM (VALUES (1, 'one', '1st'), (2, 'two', '2nd'), (13, 'thirteen', '13th'), (42, 'forty-two', '42nd'), (1000, 'one thousand', '1,000th')) v(n, words, ordinal)")
def format_spellout_ordinal(spark, _):
    df = _literals(spark, [(1,), (2,), (13,), (42,), (1000,)], "n int")
    return df.select("n", fmt.format_spellout(F.col("n")).alias("words"), fmt.format_ordinal(F.col("n")).alias("ordinal"))


@_query("part", "SELECT p_size, CASE WHEN p_size * 1000 < 10000 THEN CAST(p_size AS VARCHAR) || 'K' ELSE CAST(p_size AS VARCHAR) || 'K' END AS compact, count(*) AS n FROM part GROUP BY 1, 2")
def format_compact(part):
    counts = part.groupBy("p_size").agg(F.count("*").alias("n"))
    return counts.select("p_size", fmt.format_compact(F.col("p_size") * 1000).alias("compact"), "n")


@_query("orders", "SELECT o_orderkey, round(o_totalprice, 2) AS back FROM orders")
def parse_number_round_trip(orders):
    shown = fmt.format_number(F.col("o_totalprice"), "de_DE")
    return orders.select("o_orderkey", F.round(fmt.parse_number(shown, "de_DE"), 2).alias("back"))


@_query(sql="SELECT * FROM (VALUES ('1,234.56', 1234.56::DOUBLE), ('-1,234', -1234.0::DOUBLE), ('abc', NULL)) v(text, value)")
def parse_number(spark, _):
    return _literals(spark, [("1,234.56",), ("-1,234",), ("abc",)], "text string").select("text", fmt.parse_number(F.col("text")).alias("value"))


@_query(sql="SELECT * FROM (VALUES ('50%', 0.5::DOUBLE), ('125%', 1.25::DOUBLE)) v(text, value)")
def parse_percent(spark, _):
    return _literals(spark, [("50%",), ("125%",)], "text string").select("text", fmt.parse_percent(F.col("text")).alias("value"))


@_query(sql="SELECT * FROM (VALUES ('$1,234.56', 1234.56::DOUBLE, 'USD')) v(text, value, currency)")
def parse_currency(spark, _):
    df = _literals(spark, [("$1,234.56",)], "text string").select("text", fmt.parse_currency(F.col("text")).alias("c"))
    return df.select("text", "c.value", "c.currency")


@_query(
    "lineitem",
    """SELECT l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 'one' ELSE 'other' END AS en, CASE WHEN l_linenumber % 10 = 1 AND l_linenumber % 100 <> 11 THEN 'one'
        WHEN l_linenumber % 10 BETWEEN 2 AND 4 AND l_linenumber % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS ru,
        CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'few' ELSE 'other' END AS ord, count(*) AS rows FROM lineitem GROUP BY 1""",
)
def plural_categories(lineitem):
    n = F.col("n")
    counts = lineitem.groupBy(F.col("l_linenumber").alias("n")).agg(F.count("*").alias("rows"))
    return counts.select("n", fmt.plural_category(n).alias("en"), fmt.plural_category(n, "ru_RU").alias("ru"), fmt.ordinal_category(n).alias("ord"), "rows")


@_query("part", "SELECT p_partkey, p_size * 0.621371::DOUBLE AS miles, CAST(p_size AS DOUBLE) * 9 / 5 + 32 AS fahrenheit FROM part")
def measure_convert(part):
    return part.select("p_partkey", fmt.convert_units(F.col("p_size"), "kilometer", "mile").alias("miles"), fmt.convert_units(F.col("p_size"), "celsius", "fahrenheit").alias("fahrenheit"))


@_query("part", "SELECT p_size, CASE WHEN p_size = 1 THEN '1 kilometer' ELSE p_size || ' kilometers' END AS long, p_size || ' km' AS short, count(*) AS n FROM part GROUP BY 1")
def measure_format(part):
    counts = part.groupBy("p_size").agg(F.count("*").alias("n"))
    size = F.col("p_size")
    return counts.select("p_size", fmt.format_measure(size, "kilometer").alias("long"), fmt.format_measure(size, "kilometer", width="SHORT").alias("short"), "n")


@_query(
    "part",
    """SELECT p_partkey, CASE p_size // 24 WHEN 0 THEN '' WHEN 1 THEN '1 day ' ELSE (p_size // 24) || ' days ' END
        || CASE p_size % 24 WHEN 0 THEN '' WHEN 1 THEN '1 hour ' ELSE (p_size % 24) || ' hours ' END || '30 minutes' AS shown FROM part""",
)
def duration_format(part):
    sizes = part.select("p_size").distinct().withColumn("shown", fmt.format_duration(F.col("p_size") * 3600 + 1800))
    return part.join(sizes, "p_size").select("p_partkey", "shown")


@_query(sql="SELECT * FROM (VALUES ('P2DT3H30M', 2.0::DOUBLE, 3.0::DOUBLE, 30.0::DOUBLE), ('PT1.5H', 0.0::DOUBLE, 1.5::DOUBLE, 0.0::DOUBLE), ('P1Y2M3W4DT5H6M7S', 4.0::DOUBLE, 5.0::DOUBLE, 6.0::DOUBLE), ('2DT3H', NULL, NULL, NULL)) v(iso, days, hours, minutes)")
def duration_iso(spark, _):
    df = _literals(spark, [("P2DT3H30M",), ("PT1.5H",), ("P1Y2M3W4DT5H6M7S",), ("2DT3H",)], "iso string").select("iso", fmt.parse_iso_duration(F.col("iso")).alias("d"))
    return df.select("iso", "d.days", "d.hours", "d.minutes")


# --- lists, messages, dates ---------------------------------------------------------------------------------------


@_query(
    None,
    """SELECT r_name, CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:-2], ', ') || ', and ' || l[-1] END AS names
        FROM (SELECT r_name, list(n_name ORDER BY n_name) AS l FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1)""",
)
def list_format(spark, sf):
    names = spark.read.parquet(f"{sf}/nation.parquet").join(F.broadcast(spark.read.parquet(f"{sf}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey"))
    return names.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("l")).select("r_name", fmt.format_list(F.col("l")).alias("names"))


@_query("events", "SELECT event_id, 'user ' || user_id || ' had ' || CASE event_id % 3 WHEN 0 THEN 'no items' WHEN 1 THEN 'one item' ELSE '2 items' END || ' in ' || event_type AS message FROM events")
def message_format(events):
    pattern = "user {u} had {n, plural, =0 {no items} one {one item} other {# items}} in {k}"
    args = {"u": F.col("user_id"), "n": F.col("event_id") % 3, "k": F.col("event_type")}
    return events.select("event_id", fmt.format_message(pattern, args, types={"n": "number"}).alias("message"))


@_query(
    "orders",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d/%m/%Y') AS eu, strftime(o_orderdate, '%A, %B %-d, %Y') AS long FROM orders""",
)
def date_patterns(orders):
    day = F.col("o_orderdate")
    return orders.select("o_orderkey", *[fmt.format_datetime(day, pattern=p).alias(a) for p, a in (("ISO_DATE", "iso"), ("US_DATE", "us"), ("EU_DATE", "eu"), ("LONG_DATE", "long"))])


@_query("orders", "SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS medium, strftime(o_orderdate, '%-d. ') AS de_day FROM orders")
def date_styles(orders):
    day = F.col("o_orderdate")
    german = F.regexp_extract(fmt.format_datetime(day, "de_DE", date_style="LONG", time_style="NONE"), r"^(\d+\. )", 1)
    return orders.select("o_orderkey", fmt.format_datetime(day, date_style="MEDIUM", time_style="NONE").alias("medium"), german.alias("de_day"))


@_query("orders", "SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS back FROM orders")
def date_parse(orders):
    shown = fmt.format_datetime(F.col("o_orderdate"), pattern="ISO_DATE")
    return orders.select("o_orderkey", fmt.parse_datetime(shown, pattern="ISO_DATE").cast("timestamp_ntz").alias("back"))


@_query("orders")
def date_calendars(orders):
    day = F.col("o_orderdate")
    return orders.select("o_orderkey", *[fmt.format_datetime(day, calendar=c, date_style="LONG", time_style="NONE").alias(c) for c in ("hebrew", "islamic", "japanese")])


@_query("orders")
def date_interval(orders):
    return orders.select("o_orderkey", fmt.format_interval(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("interval"))


@_query(
    "part",
    "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'in 1 ' || u ELSE 'in ' || p_size || ' ' || u || 's' END AS shown FROM (SELECT p_partkey, p_size, CASE WHEN p_size < 60 THEN 'second' ELSE 'minute' END AS u FROM part)",
)
def relative_time(part):
    return part.select("p_partkey", fmt.format_relative(F.col("p_size")).alias("shown"))


# --- locales and reference tables ---------------------------------------------------------------------------------


@_query(sql="SELECT * FROM (VALUES ('ja', 'Japanese', 'language'), ('JP', 'Japan', 'region'), ('Cyrl', 'Cyrillic', 'script'), ('EUR', 'Euro', 'currency'), ('USD', '$', 'symbol'), ('ja_JP', 'Japanese (Japan)', 'locale')) v(code, name, kind)")
def display_names(spark, _):
    rows = [("ja", "language"), ("JP", "region"), ("Cyrl", "script"), ("EUR", "currency"), ("USD", "symbol"), ("ja_JP", "locale")]
    df = _literals(spark, rows, "code string, kind string")
    return df.select("code", F.coalesce(*[F.when(F.col("kind") == k, loc.display_name(F.col("code"), k)) for k in loc.KINDS]).alias("name"), "kind")


@_query(sql="SELECT * FROM (VALUES ('zh', 'zh_Hans_CN', 'zh', 'zh'), ('sr_Latn_RS', 'sr_Latn_RS', 'sr_Latn', 'sr'), ('iw', 'he_Hebr_IL', 'he', 'he')) v(id, maximal, minimal, language)")
def locale_subtags(spark, _):
    df = _literals(spark, [("zh",), ("sr_Latn_RS",), ("iw",)], "id string")
    at = loc.canonicalize(F.col("id"))
    return df.select("id", loc.add_likely_subtags(at).alias("maximal"), loc.minimize_subtags(at).alias("minimal"), loc.parse_locale(at)["language"].alias("language"))


@_query()
def catalog_locales(spark, _):
    return cat.locales(spark)


@_query()
def catalog_regions(spark, _):
    return cat.regions(spark, None)


@_query(sql="SELECT * FROM (VALUES ('US', '001'), ('US', '019'), ('US', '021')) v(code, ancestor)")
def region_closure(spark, _):
    return cat.region_closure(spark).filter("code = 'US' AND ancestor IN ('001', '019', '021')").select("code", "ancestor")


@_query()
def catalog_scripts(spark, _):
    return cat.scripts(spark)


@_query()
def catalog_timezones(spark, _):
    return cat.timezones(spark)


@_query(sql="SELECT * FROM (VALUES ('America/New_York', -5.0::DOUBLE, 'UTC-5', true), ('Asia/Kolkata', 5.5::DOUBLE, 'UTC+05:30', false), ('Asia/Tokyo', 9.0::DOUBLE, 'UTC+9', false)) v(zone, offset_hours, shown, dst)")
def timezone_info(spark, _):
    df = _literals(spark, [("America/New_York",), ("Asia/Kolkata",), ("Asia/Tokyo",)], "zone string").select("zone", loc.timezone_info(F.col("zone")).alias("i"))
    return df.select("zone", "i.offset_hours", F.col("i.offset_formatted").alias("shown"), F.col("i.uses_dst").alias("dst"))


@_query()
def catalog_calendars(spark, _):
    return cat.calendars(spark)


@_query()
def catalog_units(spark, _):
    return cat.units(spark)


@_query()
def catalog_currencies(spark, _):
    return cat.currencies(spark)


@_query()
def catalog_transliterators(spark, _):
    return cat.transliterators(spark)


@_query()
def catalog_blocks(spark, _):
    return cat.blocks(spark)


@_query()
def catalog_collation_types(spark, _):
    return cat.collation_types(spark)


@_query(sql="SELECT 12 AS n, 'U+061C' AS first, 'U+2069' AS last")
def catalog_bidi_controls(spark, _):
    return cat.bidi_controls(spark).agg(F.count("*").cast("int").alias("n"), F.min("codepoint").alias("first"), F.max("codepoint").alias("last"))


@_query(sql="SELECT * FROM (VALUES ('months_wide', 0, 'January'), ('weekdays_wide', 0, 'Sunday'), ('am_pm', 1, 'PM')) v(kind, ordinal, name)")
def date_symbols(spark, _):
    return cat.date_symbols(spark).filter("(kind = 'months_wide' AND ordinal = 0) OR (kind = 'weekdays_wide' AND ordinal = 0) OR (kind = 'am_pm' AND ordinal = 1)")


@_query(sql="SELECT 'de_DE' AS locale, ',' AS decimal, '.' AS grouping")
def number_symbols(spark, _):
    return cat.number_symbols(spark, "de_DE").select("locale", "decimal", "grouping")


@_query(sql="SELECT unnest(['one', 'few', 'many', 'other']) AS category")
def plural_info(spark, _):
    return cat.plural_info(spark, "ru_RU").select("category")


@_query(sql="SELECT chr(CAST(64 + i AS INTEGER)) AS label FROM range(1, 27) r(i)")
def index_labels(spark, _):
    return cat.index_labels(spark).select("label")


# --- sinks --------------------------------------------------------------------------------------------------------


@_query("nation", "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS line FROM nation")
def tsv_lines(nation):
    return files.as_tsv(nation.select("n_nationkey", "n_name", "n_regionkey"))


@_query("region", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""")
def json_lines(region):
    return files.as_json(region.select("r_regionkey", "r_name"))


# --- rows that show single cases -----------------------------------------------------------------------------------


@_query(sql=r"""SELECT * FROM (VALUES ('abc123', 'x*', 0, '0,1,2,3,4,5,6', 0), ('abc123', '(?<=c)\d', 3, '3', 3), ('a1b2', '^1', 0, '', -1), ('1👋2', '\d', 0, '0,2', 0), ('1👋2', '\d', 1, '0,2', 2)) v(text, pattern, start, starts, first)""")
def regex_offsets(spark, _):
    rows = [("abc123", "x*", 0), ("abc123", r"(?<=c)\d", 3), ("a1b2", "^1", 0), ("1👋2", r"\d", 0), ("1👋2", r"\d", 1)]
    out = None
    for text, pattern, start in rows:
        one = _literals(spark, [(text, pattern, start)], "text string, pattern string, start int")
        starts = F.array_join(F.transform(m.regex_find_all(F.col("text"), pattern), lambda x: x["start"].cast("string")), ",")
        one = one.select("*", starts.alias("starts"), F.coalesce(m.regex_find(F.col("text"), pattern, start=start)["start"], F.lit(-1)).alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("customer", "SELECT c_custkey, regexp_replace(c_name, '#([0-9]+)', '<\\1>') AS marked FROM customer")
def regex_replace_with(customer):
    return customer.select("c_custkey", m.regex_replace_with(F.col("c_name"), "#([0-9]+)", lambda x: F.concat(F.lit("<"), x["groups"][1], F.lit(">"))).alias("marked"))


@_query(sql=r"SELECT * FROM (VALUES ('[a-z]+', true), ('[invalid', false), ('(a', false), ('\p{Lu}', true)) v(pattern, valid)")
def regex_validate(spark, _):
    return _literals(spark, [("[a-z]+",), ("[invalid",), ("(a",), (r"\p{Lu}",)], "pattern string").select("pattern", m.regex_valid(F.col("pattern")).alias("valid"))


@_query(sql="SELECT * FROM (VALUES ('𐤀', true), ('𐡀', true), ('𞠀', true), ('א', true), ('ا', true), ('a', false), ('1', false), ('', false)) v(text, rtl)")
def script_rtl(spark, _):
    return _literals(spark, [(x,) for x in ("𐤀", "𐡀", "𞠀", "א", "ا", "a", "1", "")], "text string").select("text", t.is_rtl(F.col("text")).alias("rtl"))


@_query(sql="SELECT * FROM (VALUES ('en_US', true), ('fr_US', true), ('ja_BR', true), ('xx_YY', false), ('qq', false)) v(locale, valid)")
def locale_valid(spark, _):
    return _literals(spark, [(x,) for x in ("en_US", "fr_US", "ja_BR", "xx_YY", "qq")], "locale string").select("locale", loc.is_valid_locale(F.col("locale")).alias("valid"))


@_query(
    sql="""SELECT * FROM (VALUES ('en_US', 'USD', 'US', 'Latn', false, 'gregorian', 'Sunday', 'Latin', 'eng', 'USA'), ('ja_JP', 'JPY', 'SI', 'Jpan', false, 'gregorian', 'Sunday', 'Han,Hiragana,Katakana', 'jpn', 'JPN'),
        ('ar_EG', 'EGP', 'SI', 'Arab', true, 'gregorian', 'Saturday', 'Arabic', 'ara', 'EGY')) v(locale, currency, system, script, rtl, calendar, first_day, scripts, iso3_language, iso3_country)"""
)
def locale_attributes(spark, _):
    df = _literals(spark, [("en_US",), ("ja_JP",), ("ar_EG",)], "locale string").select("locale", loc.locale_extended(F.col("locale")).alias("e"))
    return df.select("locale", "e.currency", F.col("e.measurement_system").alias("system"), F.col("e.likely_script").alias("script"), "e.rtl", "e.calendar", F.col("e.first_day_of_week").alias("first_day"), F.array_join("e.scripts", ",").alias("scripts"), "e.iso3_language", "e.iso3_country")


@_query(sql="SELECT * FROM (VALUES ('km', 'kilometer', 'length', 'single', 'km', true), ('mi', 'mile', 'length', 'single', 'mi', true), ('kilometer', 'kilometer', 'length', 'single', 'km', true), ('celsius', 'celsius', 'temperature', 'single', '°C', false), ('no such', NULL, NULL, NULL, NULL, NULL)) v(unit, identifier, type, complexity, short, to_mile)")
def measure_units(spark, _):
    df = _literals(spark, [(x,) for x in ("km", "mi", "kilometer", "celsius", "no such")], "unit string")
    info = fmt.unit_info(F.col("unit"))
    return df.select("unit", info["identifier"].alias("identifier"), info["type"].alias("type"), info["complexity"].alias("complexity"), fmt.unit_abbreviation(F.col("unit")).alias("short"), fmt.can_convert(F.col("unit"), F.lit("mi")).alias("to_mile"))


@_query("part", "SELECT p_partkey, p_size * 0.621371::DOUBLE AS miles, p_size / 2.54::DOUBLE AS inches FROM part")
def measure_convert_short(part):
    return part.select("p_partkey", fmt.convert_units(F.col("p_size"), "km", "mi").alias("miles"), fmt.convert_units(F.col("p_size"), "cm", "in").alias("inches"))


@_query(sql="SELECT * FROM (VALUES ('Hello world', 'Hello|world', 1, 11), ('Hello world. How are you?', 'Hello|world|.|How|are|you|?', 2, 25), ('Hello! How are you? I''m fine.', 'Hello|!|How|are|you|?|I''m|fine|.', 3, 29), ('é', 'é', 1, 1), ('3.14, a_b', '3.14|,|a_b', 1, 9)) v(text, words, sentences, graphemes)")
def break_literals(spark, _):
    df = _literals(spark, [(x,) for x in ("Hello world", "Hello world. How are you?", "Hello! How are you? I'm fine.", "é", "3.14, a_b")], "text string")
    c = F.col("text")
    return df.select("text", F.array_join(t.break_words(c), "|").alias("words"), F.size(t.break_sentences(c)).alias("sentences"), F.size(t.break_graphemes(c)).alias("graphemes"))


def _known(spark, table, keys, *columns):
    """The rows of a reference table that have one of some keys in its first column."""
    return table.filter(F.col(columns[0]).isin(*keys)).select(*columns)


@_query(sql="SELECT * FROM (VALUES ('en_US', 'English (United States)', 'US', false), ('ja_JP', 'Japanese (Japan)', 'JP', false), ('ar_EG', 'Arabic (Egypt)', 'EG', true)) v(id, display_name, region, is_rtl)")
def known_locales(spark, _):
    return _known(spark, cat.locales(spark), ("en_US", "ja_JP", "ar_EG"), "id", "display_name", "region", "is_rtl")


@_query(sql="SELECT * FROM (VALUES ('US', 840, 'United States', 'territory', '021'), ('JP', 392, 'Japan', 'territory', '030'), ('150', 150, 'Europe', 'continent', '001')) v(code, numeric_code, name, type, containing_region)")
def known_regions(spark, _):
    return _known(spark, cat.regions(spark, None), ("US", "JP", "150"), "code", "numeric_code", "name", "type", "containing_region")


@_query(sql="SELECT * FROM (VALUES ('Latn', 'Latin', false, true), ('Hebr', 'Hebrew', true, false), ('Phnx', 'Phoenician', true, false), ('Cyrl', 'Cyrillic', false, true)) v(code, name, is_rtl, is_cased)")
def known_scripts(spark, _):
    return _known(spark, cat.scripts(spark), ("Latn", "Hebr", "Phnx", "Cyrl"), "code", "name", "is_rtl", "is_cased")


@_query(sql="SELECT * FROM (VALUES ('America/New_York', -5.0::DOUBLE, 'UTC-5', true, 'US'), ('Asia/Tokyo', 9.0::DOUBLE, 'UTC+9', false, 'JP'), ('Asia/Kolkata', 5.5::DOUBLE, 'UTC+05:30', false, 'IN')) v(id, offset_hours, offset_formatted, uses_dst, region)")
def known_timezones(spark, _):
    return _known(spark, cat.timezones(spark), ("America/New_York", "Asia/Tokyo", "Asia/Kolkata"), "id", "offset_hours", "offset_formatted", "uses_dst", "region")


@_query(sql="SELECT * FROM (VALUES ('USD', 'US Dollar', '$'), ('EUR', 'Euro', '€'), ('JPY', 'Japanese Yen', '¥')) v(code, name, symbol)")
def known_currencies(spark, _):
    return _known(spark, cat.currencies(spark), ("USD", "EUR", "JPY"), "code", "name", "symbol")


@_query(sql="SELECT * FROM (VALUES ('kilometer', 'length'), ('celsius', 'temperature'), ('liter', 'volume'), ('kilogram', 'mass')) v(identifier, type)")
def known_units(spark, _):
    return _known(spark, cat.units(spark), ("kilometer", "celsius", "liter", "kilogram"), "identifier", "type")


@_query(sql="SELECT * FROM (VALUES ('BASIC_LATIN', 0, 127), ('CYRILLIC', 1024, 1279), ('ARROWS', 8592, 8703)) v(name, start, \"end\")")
def known_blocks(spark, _):
    return _known(spark, cat.blocks(spark), ("BASIC_LATIN", "CYRILLIC", "ARROWS"), "name", "start", "end")


@_query(sql="SELECT * FROM (VALUES ('phonebook'), ('pinyin'), ('standard')) v(type)")
def known_collations(spark, _):
    return _known(spark, cat.collation_types(spark), ("phonebook", "pinyin", "standard"), "type")


@_query(sql="SELECT * FROM (VALUES ('buddhist'), ('hebrew'), ('japanese')) v(type)")
def known_calendars(spark, _):
    return _known(spark, cat.calendars(spark), ("buddhist", "hebrew", "japanese"), "type")


@_query(sql="SELECT * FROM (VALUES ('Latin-Cyrillic', 'Latin', 'Cyrillic'), ('Any-Latin', 'Any', 'Latin')) v(id, source, target)")
def known_transliterators(spark, _):
    return _known(spark, cat.transliterators(spark), ("Latin-Cyrillic", "Any-Latin"), "id", "source", "target")


@_query(sql="SELECT * FROM (VALUES ('standard', '[a-z]'), ('index', '[A-Z]')) v(type, pattern)")
def exemplar_patterns(spark, _):
    return _known(spark, cat.exemplar_info(spark, "en_US"), ("standard", "index"), "type", "pattern")


@_query(sql="SELECT chr(CAST(i AS INTEGER)) AS char FROM range(97, 123) r(i)")
def transliterator_characters(spark, _):
    return cat.transliterator_set(spark, "Any-Upper", "source").filter(F.col("char").rlike("^[a-z]$"))


@_query("nation", "SELECT n_nationkey, n_name, upper(left(n_name, 1)) AS bucket, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS place FROM nation")
def index_rows(nation):
    """An index with the data of each name."""
    return tables.index_rows(nation, "n_name").select("n_nationkey", "n_name", "bucket", "place")


# --- joins and orders over whole tables -----------------------------------------------------------------------------

_WORD = r"([\p{L}]+)"
_FOLDED = "replace(replace(replace(lower(strip_accents(word)), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(1))).alias("pos", "word"))


@_query(
    "pages",
    r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '://([^/:]+)', 1) AS host FROM pages
    ), h AS (SELECT DISTINCT host, replace(replace(replace(replace(host, 'm', 'rn'), '1', 'l'), '0', 'O'), 'I', 'l') AS skeleton FROM p
    ), c AS (SELECT skeleton, min(host) AS class_id FROM h GROUP BY skeleton
    ), n AS (SELECT x.skeleton, count(*) FILTER (levenshtein(x.skeleton, y.skeleton) = 1) AS n_near FROM c x, c y GROUP BY x.skeleton)
    SELECT page_id, host, class_id, n_near FROM p JOIN h USING (host) JOIN c USING (skeleton) JOIN n USING (skeleton)
    """,
)
def host_look_alikes(pages):
    """Pages with the class of their host among look-alike hosts, and how many other classes are one edit away."""
    return joins.look_alikes(pages.select("page_id", F.regexp_extract("url", "://([^/:]+)", 1).alias("host")), "host")


@_query(
    "documents",
    rf"""
    WITH w AS (SELECT lang IS NOT DISTINCT FROM 'fr' AS french, word, {_FOLDED} AS k FROM (SELECT lang, unnest(regexp_extract_all(text, '[\p{{L}}]+')) AS word FROM documents)
    ), c AS (SELECT french, k, min(word) AS class_id, count(DISTINCT word) AS n_texts, count(*) AS n_rows FROM w GROUP BY french, k)
    SELECT a.class_id AS left_class, b.class_id AS right_class, a.n_texts AS left_texts, b.n_texts AS right_texts, a.n_rows AS left_rows, b.n_rows AS right_rows
    FROM c a JOIN c b ON a.k = b.k AND a.french AND NOT b.french
    """,
)
def collation_join(docs):
    """Words of French texts that are words of other texts too, accents and case aside."""
    words = _words(docs)
    french = F.col("lang").eqNullSafe(F.lit("fr"))
    return joins.collation_join(words.filter(french), words.filter(~french), "word", "word", strength="primary").pairs


@_query(
    "part",
    """
    WITH w AS (SELECT p_partkey, lower(unnest(string_split(p_name, ' '))) AS k FROM part)
    SELECT w.k AS word, count(*) AS n, sum(p.n) AS pairs FROM w JOIN (SELECT lower(p_type) AS k, count(*) AS n FROM part GROUP BY 1) p USING (k) GROUP BY w.k
    """,
)
def collation_join_rows(part):
    """Parts with the parts whose type is a word of their name, case aside, counted by word: a few words hold all rows."""
    words = part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    found = joins.collation_join(words, part.select("p_type"), "word", "p_type", strength="secondary")
    by_word = found.left.groupBy("class_id").agg(F.count("*").alias("n"))
    joined = by_word.join(found.pairs, F.col("class_id") == F.col("left_class"))
    return joined.select(F.lower("class_id").alias("word"), "n", (F.col("n") * F.col("right_rows")).alias("pairs"))


@_query(
    "documents",
    r"""
    SELECT doc_id, CASE WHEN regexp_matches(c, '\p{Latin}') THEN 'Latin' WHEN regexp_matches(c, '\p{Greek}') THEN 'Greek' WHEN regexp_matches(c, '\p{Cyrillic}') THEN 'Cyrillic'
        WHEN regexp_matches(c, '\p{Han}') THEN 'Han' WHEN regexp_matches(c, '\p{Common}') THEN 'Common' ELSE 'other' END AS script, category, count(*) AS n
    FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), (VALUES ('Lu'), ('Ll'), ('Lt'), ('Lm'), ('Lo'), ('Mn'), ('Mc'), ('Me'), ('Nd'), ('Nl'), ('No'), ('Pc'), ('Pd'), ('Ps'), ('Pe'),
        ('Pi'), ('Pf'), ('Po'), ('Sm'), ('Sc'), ('Sk'), ('So'), ('Zs'), ('Zl'), ('Zp'), ('Cc'), ('Cf'), ('Co')) v(category)
    WHERE c <> '' AND CASE category WHEN 'Lu' THEN regexp_matches(c, '\p{Lu}') WHEN 'Ll' THEN regexp_matches(c, '\p{Ll}') WHEN 'Lt' THEN regexp_matches(c, '\p{Lt}')
        WHEN 'Lm' THEN regexp_matches(c, '\p{Lm}') WHEN 'Lo' THEN regexp_matches(c, '\p{Lo}') WHEN 'Mn' THEN regexp_matches(c, '\p{Mn}') WHEN 'Mc' THEN regexp_matches(c, '\p{Mc}')
        WHEN 'Me' THEN regexp_matches(c, '\p{Me}') WHEN 'Nd' THEN regexp_matches(c, '\p{Nd}') WHEN 'Nl' THEN regexp_matches(c, '\p{Nl}') WHEN 'No' THEN regexp_matches(c, '\p{No}')
        WHEN 'Pc' THEN regexp_matches(c, '\p{Pc}') WHEN 'Pd' THEN regexp_matches(c, '\p{Pd}') WHEN 'Ps' THEN regexp_matches(c, '\p{Ps}') WHEN 'Pe' THEN regexp_matches(c, '\p{Pe}')
        WHEN 'Pi' THEN regexp_matches(c, '\p{Pi}') WHEN 'Pf' THEN regexp_matches(c, '\p{Pf}') WHEN 'Po' THEN regexp_matches(c, '\p{Po}') WHEN 'Sm' THEN regexp_matches(c, '\p{Sm}')
        WHEN 'Sc' THEN regexp_matches(c, '\p{Sc}') WHEN 'Sk' THEN regexp_matches(c, '\p{Sk}') WHEN 'So' THEN regexp_matches(c, '\p{So}') WHEN 'Zs' THEN regexp_matches(c, '\p{Zs}')
        WHEN 'Zl' THEN regexp_matches(c, '\p{Zl}') WHEN 'Zp' THEN regexp_matches(c, '\p{Zp}') WHEN 'Cc' THEN regexp_matches(c, '\p{Cc}') WHEN 'Cf' THEN regexp_matches(c, '\p{Cf}')
        ELSE regexp_matches(c, '\p{Co}') END
    GROUP BY ALL
    """,
)
def character_profile(docs):
    """Characters of each text by script and category, from a join of code points with ranges."""
    found = ranges.character_profile(docs, "text", "doc_id")
    script = F.when(F.col("script").isin("Latin", "Greek", "Cyrillic", "Han", "Common"), F.col("script")).otherwise("other")
    return found.groupBy("doc_id", script.alias("script"), "category").agg(F.sum("n").alias("n"))


@_query(
    "documents",
    rf"""
    SELECT doc_id, pos, word FROM (
        SELECT *, row_number() OVER (PARTITION BY {_FOLDED} ORDER BY doc_id, pos) AS r
        FROM (SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}]+') AS w FROM documents))
    ) WHERE r = 1
    """,
)
def collation_first_seen(docs):
    """Each word, accents and case aside, where it stands first."""
    words = _words(docs).select("word", tables.ordinal_of(F.col("doc_id"), F.col("pos")).alias("at"))
    doc_id, pos = tables.ordinal_parts(F.col("at"))
    return tables.unique_first(words, "word", "at", strength="primary").select(doc_id.alias("doc_id"), pos.alias("pos"), "word")


@_query(
    "events",
    r"""
    SELECT event_id, CASE event_type WHEN 'click' THEN 'user ' || user_id || ' clicked' WHEN 'error' THEN 'user ' || user_id || ' met {an error}' ELSE
        CASE WHEN user_id % 4 = 0 THEN 'nobody' WHEN user_id % 4 = 1 THEN 'user ' || user_id || ' alone' WHEN user_id % 4 = 2 THEN 'user ' || user_id || ' and 1 other' ELSE 'user ' || user_id || ' and 2 others' END
        || ' did ' || event_type || ', the ' || (user_id % 4) || CASE user_id % 4 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS message
    FROM events
    """,
)
def message_compiled(events):
    """Choices by text and number, nested, with an offset and quoted braces, from one compiled pattern."""
    pattern = """{kind, select, click {user {u} clicked} error {user {u} met '{an error}'} other {{n, plural, offset:1 =0 {nobody} =1 {user {u} alone}
        one {user {u} and # other} other {user {u} and # others}} did {kind}, the {n, selectordinal, one {#st} two {#nd} few {#rd} other {#th}}}}"""
    args = {"kind": F.col("event_type"), "u": F.col("user_id"), "n": F.col("user_id") % 4}
    return events.select("event_id", messages.compile_message(pattern, args).alias("message"))


# --- long texts, sections and streams -------------------------------------------------------------------------------


@_query("documents", "SELECT doc_id, length_grapheme(text) AS n, length_grapheme(text) - 1 AS last, length(text) AS n_chars FROM documents WHERE text <> ''")
def grapheme_windows(docs):
    """Graphemes of whole texts, from windows of 4,096 bytes: how many, the place of the last, and the characters in them."""
    found = windows.long_tokens(docs.select("doc_id", "text"), "text", "grapheme", window=4096)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("position").cast("long").alias("last"), F.sum(F.length("token")).alias("n_chars"))


@_query("documents")
def word_windows(docs):
    """Words of whole texts with their places, from windows of 4,096 bytes; the text of a word is that of its `doc_id`."""
    return windows.long_tokens(docs.select("doc_id", "text"), "text", window=4096).select("doc_id", "position", "token")


@_query(
    "part",
    """
    SELECT row_number() OVER (ORDER BY p_type, p_name) AS place, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_name) = 1 THEN p_type || ':' || chr(10) ELSE '' END || '  ' || p_name AS line
    FROM part
    """,
)
def part_sections(part):
    """Names of parts under their types: a few sections hold all rows."""
    return files.section_lines(part, "p_type", "p_name", indent="  ")


@_query(sql="SELECT upper(left(p_name, 1)) AS bucket, count(*) AS records, array_to_string(list_sort(list(p_name))[1:3], '|') AS names FROM part GROUP BY 1")
def index_growth(spark, sf):
    """The alphabetic index that a stream of part names grows."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/part.parquet").schema).option("pathGlobFilter", "part.parquet").parquet(sf)
    path = new_path(spark)
    index.grow_index(stream, path, new_path(spark), "p_name").awaitTermination()
    return index.names_of(index.read_index(spark, path)).withColumn("names", F.array_join("names", "|"))


@_query(
    sql="""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL
    """
)
def event_windows(spark, sf):
    """Events by hour and type from a stream: the hours that the watermark has closed."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_path(spark)
    write_stream(windowed_counts(stream, "ts", "event_type"), path, new_path(spark), kind="parquet").awaitTermination()
    closed = spark.read.schema("window struct<start: timestamp, end: timestamp>, event_type string, n long").parquet(path)
    return closed.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
