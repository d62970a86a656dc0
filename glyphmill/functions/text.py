"""Normalization, characters, scripts, direction, segmentation, transliteration, domain names, look-alikes, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill import jvm

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
#: The twelve bidirectional controls.
BIDI_CONTROLS = "\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
CONFUSABLE_TYPES = {"single_script": 1, "mixed_script": 2, "whole_script": 4}


def _form(form: str) -> str:
    if form.upper() not in FORMS:
        raise ValueError(f"unknown normalization form {form!r}")
    return form.upper()


def normalize(text: Column, form: str = "NFC") -> Column:
    return jvm.text("normalize", _form(form), text)


def is_normalized(text: Column, form: str = "NFC") -> Column:
    return jvm.text("is_normalized", _form(form), text).cast("boolean")


def remove_accents(text: Column) -> Column:
    """Decompose, drop non-spacing marks, compose."""
    return normalize(F.regexp_replace(normalize(text, "NFD"), r"\p{Mn}+", ""), "NFC")


def char_info(char: Column) -> Column:
    """Properties of a single character; null unless the text is one character long."""
    names = ("char", "codepoint", "name", "category", "script", "block")
    flags = ("is_letter", "is_digit", "is_upper", "is_lower", "is_whitespace")
    found = jvm.array("char_info", F.when(F.length(char) == 1, char))
    fields = [found[k].alias(n) for k, n in enumerate(names)] + [found[len(names) + k].cast("boolean").alias(n) for k, n in enumerate(flags)]
    return F.when(found.isNotNull(), F.struct(*fields, found[11].cast("int").alias("direction"), found[12].cast("int").alias("combining_class")))


def char_name(char: Column) -> Column:
    return char_info(char)["name"]


def char_category(char: Column) -> Column:
    return char_info(char)["category"]


def codepoint(char: Column) -> Column:
    """`U+XXXX` of the first character, without leaving Spark's own functions."""
    point = F.conv(F.hex(F.encode(F.substring(char, 1, 1), "UTF-32")), 16, 16)
    return F.when(F.length(char) > 0, F.concat(F.lit("U+"), F.when(F.length(point) < 4, F.lpad(point, 4, "0")).otherwise(point)))


def detect_script(text: Column) -> Column:
    """Script of the first character; an empty text is `Unknown`."""
    return F.when(text == "", F.lit("Unknown")).otherwise(jvm.text("script_of", text))


def detect_scripts(text: Column) -> Column:
    """Scripts in the order of their first characters, without the common and inherited ones."""
    return jvm.array("scripts_of", text)


def char_script(char: Column) -> Column:
    return F.when(F.length(char) == 1, jvm.text("script_of", char))


def is_rtl(text: Column) -> Column:
    """Whether the first character's script runs from right to left."""
    return F.when(text == "", F.lit(False)).otherwise(F.coalesce(jvm.text("is_rtl", text).cast("boolean"), F.lit(False)))


def bidi_info(text: Column) -> Column:
    found = jvm.array("bidi", text)
    return F.struct(
        found[0].alias("direction"), found[1].alias("base_direction"), found[2].cast("boolean").alias("has_rtl"), found[3].cast("boolean").alias("has_ltr"), found[4].cast("int").alias("bidi_control_count")
    )


def base_direction(text: Column) -> Column:
    return jvm.array("bidi", text)[1]


def strip_bidi_controls(text: Column) -> Column:
    return F.regexp_replace(text, f"[{BIDI_CONTROLS}]", "")


def has_bidi_controls(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"[{BIDI_CONTROLS}]"))


def break_sentences(text: Column, locale: str = "en_US", skip_empty: bool = True) -> Column:
    found = jvm.array("break", "sentence", locale, text)
    return F.filter(found, lambda s: F.regexp_like(s, F.lit(r"(?U)\S"))) if skip_empty else found


def _tokens(found: Column, skip_whitespace: bool, skip_punctuation: bool) -> Column:
    if skip_whitespace:
        found = F.filter(found, lambda w: F.regexp_like(w, F.lit(r"(?U)\S")))
    if skip_punctuation:
        found = F.filter(found, lambda w: ~F.regexp_like(w, F.lit(r"^\p{P}+$")))
    return found


def break_words(text: Column, locale: str = "en_US", skip_whitespace: bool = True, skip_punctuation: bool = False) -> Column:
    return _tokens(jvm.array("break", "word", locale, text), skip_whitespace, skip_punctuation)


def break_lines(text: Column, locale: str = "en_US") -> Column:
    return jvm.array("break", "line", locale, text)


def break_graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))


def grapheme_report(text: Column) -> Column:
    return F.transform(break_graphemes(text), lambda g: F.struct(g.alias("grapheme"), F.length(g).alias("length")))


def tokenize_sentences(text: Column, locale: str = "en_US", skip_whitespace: bool = True, skip_punctuation: bool = False) -> Column:
    words = F.transform(break_sentences(text, locale), lambda s: break_words(s, locale, skip_whitespace, skip_punctuation))
    return F.filter(words, lambda w: F.size(w) > 0)


def transliterate(text: Column, transliterator: str, reverse: bool = False) -> Column:
    return jvm.text("transliterate", transliterator, str(reverse).lower(), text)


def transliterate_rules(text: Column, rules: str, reverse: bool = False) -> Column:
    return jvm.text("transliterate_rules", rules, str(reverse).lower(), text)


def to_ascii(text: Column) -> Column:
    return transliterate(text, "Any-Latin; Latin-ASCII")


def to_latin(text: Column) -> Column:
    return transliterate(text, "Any-Latin")


def to_upper(text: Column) -> Column:
    return transliterate(text, "Upper")


def to_lower(text: Column) -> Column:
    return transliterate(text, "Lower")


def to_title(text: Column) -> Column:
    return transliterate(text, "Title")


def idna_encode(domain: Column) -> Column:
    """ASCII form of a domain; null where it is not a valid one."""
    return F.when(is_ascii(domain) & ~F.contains(domain, F.lit("xn--")) & F.regexp_like(domain, F.lit(r"^[a-z0-9]+([-.][a-z0-9]+)*$")), domain).otherwise(jvm.text("idna", "encode", domain))


def idna_decode(domain: Column) -> Column:
    return jvm.text("idna", "decode", domain)


def idna_encode_label(label: Column) -> Column:
    return jvm.text("idna", "encode_label", label)


def idna_decode_label(label: Column) -> Column:
    return jvm.text("idna", "decode_label", label)


def is_ascii(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))


def skeleton(text: Column) -> Column:
    return jvm.text("skeleton", text)


def confusable_type(a: Column, b: Column) -> Column:
    """Sum of the bits in CONFUSABLE_TYPES, 0 where the texts cannot be confused."""
    return jvm.text("confusable", a, b).cast("int")


def are_confusable(a: Column, b: Column) -> Column:
    return confusable_type(a, b) != 0


def confusable_info(a: Column, b: Column) -> Column:
    kind = confusable_type(a, b)
    names = F.array_compact(F.array(*[F.when(kind.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in CONFUSABLE_TYPES.items()]))
    return F.struct(
        (kind != 0).alias("confusable"), kind.alias("type"), names.alias("type_names"), skeleton(a).alias("skeleton1"), skeleton(b).alias("skeleton2"), (skeleton(a) == skeleton(b)).alias("same_skeleton")
    )


def check_string(text: Column) -> Column:
    flags = jvm.text("suspicious", text).cast("int")
    bit = lambda n: flags.bitwiseAND(n) != 0
    return F.struct(
        flags.alias("flags"), (flags != 0).alias("is_suspicious"), bit(2).alias("mixed_script"), bit(4).alias("whole_script"), bit(16).alias("restriction_level"), bit(32).alias("invisible"), bit(128).alias("mixed_numbers")
    )


def _units(text: Column, charset: str, width: int, prefix: str) -> Column:
    return F.regexp_replace(F.lower(F.hex(F.encode(text, charset))), f"(.{{{width}}})", f"{prefix}$1")


def escape_encode(text: Column, style: str = "u") -> Column:
    """Code points as `u` (UTF-16 units), `U` (eight digits), `x` (UTF-8 bytes) or `uplus` (U+XXXX, spaced)."""
    match style:
        case "u":
            return _units(text, "UTF-16BE", 4, r"\\u")
        case "U":
            return _units(text, "UTF-32", 8, r"\\U")
        case "x":
            return _units(text, "UTF-8", 2, r"\\x")
        case "uplus":
            return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), codepoint), " ")
    raise ValueError(f"unknown escape style {style!r}")


def escape_decode(text: Column) -> Column:
    """Characters of `U+X…`, `\\uXXXX`, `\\UXXXXXXXX` and `\\xXX` escapes; all else stays."""
    return jvm.text("transliterate", "Hex-Any/Unicode; Hex-Any/Java; Hex-Any/C", "false", F.regexp_replace(text, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1"))
