"""Unicode regular expressions, collation, and collation-aware search."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill import jvm

CASE_INSENSITIVE, MULTILINE, DOTALL, COMMENTS = 2, 8, 32, 4
_FLAGS = ((CASE_INSENSITIVE, "iu"), (MULTILINE, "m"), (DOTALL, "s"), (COMMENTS, "x"))
STRENGTHS = ("primary", "secondary", "tertiary", "quaternary", "identical")


def flagged(pattern: str, flags: int = 0) -> str:
    """The pattern with its flags inline, Unicode classes on."""
    letters = "".join(letter for bit, letter in _FLAGS if flags & bit)
    classes = "U" if re.search(r"\\[wWdDsSbB]", pattern) else ""
    return f"(?{letters}{classes}){pattern}" if letters or classes else pattern


def escape(text: str) -> str:
    return re.sub(r"([\\.^$*+?{}\[\]()|])", r"\\\1", text)


def _groups(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)(?:\\\\)*\((?!\?(?:[:=!>]|<[=!]|[a-zA-Z-]*[:)]))", pattern))


def _matches(text: Column, pattern: str, flags: int, start: int, most: int) -> Column:
    """Matches as `(text, start, end, groups)`, all offsets from one pass over the text."""
    n = _groups(pattern)
    found = jvm.array("regex_offsets", flagged(pattern, flags), start, most, text)

    def part(fields: Column, k: int) -> Column:
        begin, end = F.get(fields, F.lit(2 * k)), F.get(fields, F.lit(2 * k + 1))
        return F.when(begin != "", F.substr(text, begin.cast("int") + 1, end.cast("int") - begin.cast("int")))

    def match(record: Column) -> Column:
        fields = F.split(record, "\u001f")
        keys = F.array(*[F.lit(k) for k in range(1, n + 1)]) if n else F.array().cast("array<int>")
        groups = F.array(*[part(fields, k) for k in range(1, n + 1)]) if n else F.array().cast("array<string>")
        bounds = [F.get(fields, F.lit(k)).cast("int").alias(name) for k, name in enumerate(("start", "end"))]
        return F.struct(part(fields, 0).alias("text"), *bounds, F.map_from_arrays(keys, groups).alias("groups"))

    return F.transform(found, match)


def regex_find_all(text: Column, pattern: str, flags: int = 0) -> Column:
    """All matches as `(text, start, end, groups)`; offsets in code points; a group without a match is null."""
    return _matches(text, pattern, flags, 0, -1)


def regex_find(text: Column, pattern: str, flags: int = 0, start: int = 0) -> Column:
    """First match at or after `start` in the whole text, or null."""
    return F.get(_matches(text, pattern, flags, start, 1), F.lit(0))


def regex_valid(pattern: Column, flags: int = 0) -> Column:
    """Whether a pattern can be compiled."""
    letters = "".join(letter for bit, letter in _FLAGS if flags & bit)
    return jvm.text("regex_valid", F.concat(F.lit(f"(?{letters})"), pattern) if letters else pattern).cast("boolean")


def regex_replace_with(text: Column, pattern: str, replacement: Callable[[Column], Column], flags: int = 0) -> Column:
    """Replace each match by what `replacement` makes of its struct `(text, start, end, groups)`; a null stands for nothing."""
    found = regex_find_all(text, pattern, flags)
    ends = F.concat(F.array(F.lit(0)), F.transform(found, lambda x: x["end"]))
    pieces = lambda x, k: F.concat(F.substr(text, F.get(ends, k) + 1, x["start"] - F.get(ends, k)), F.coalesce(replacement(x), F.lit("")))
    return F.concat(F.array_join(F.transform(found, pieces), ""), F.substr(text, F.element_at(ends, -1) + 1, F.length(text)))


def regex_count(text: Column, pattern: str, flags: int = 0) -> Column:
    return F.regexp_count(text, F.lit(flagged(pattern, flags)))


def regex_search(text: Column, pattern: str, flags: int = 0) -> Column:
    return F.regexp_like(text, F.lit(flagged(pattern, flags)))


def regex_match(text: Column, pattern: str, flags: int = 0) -> Column:
    """Whether the whole text matches."""
    return F.regexp_like(text, F.lit(flagged(f"^(?:{pattern})\\z", flags)))


def regex_replace(text: Column, pattern: str, replacement: str, flags: int = 0, limit: int = -1) -> Column:
    """Replace all matches, or the first `limit`; `$1` names a group."""
    whole = flagged(pattern, flags)
    if limit < 0:
        return F.regexp_replace(text, whole, replacement)
    if limit == 0:
        return text
    parts = F.split(text, whole, limit + 1)
    rest = F.when(F.size(parts) > limit, F.element_at(parts, -1)).otherwise(F.lit(""))
    head = F.substr(text, F.lit(1), F.length(text) - F.length(rest))
    return F.when(F.size(parts) <= limit, F.regexp_replace(text, whole, replacement)).otherwise(F.concat(F.regexp_replace(head, whole, replacement), rest))


def sed(text: Column, expression: str) -> Column:
    """`s/pattern/replacement/flags` with any delimiter; `g` for all matches, `i` to ignore case."""
    if len(expression) < 4 or expression[0] != "s":
        raise ValueError("expected s/pattern/replacement/flags")
    parts = re.split(rf"(?<!\\){re.escape(expression[1])}", expression[2:])
    if len(parts) != 3:
        raise ValueError("expected s/pattern/replacement/flags")
    pattern, replacement, flags = parts
    return regex_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", replacement), CASE_INSENSITIVE if "i" in flags else 0, -1 if "g" in flags else 1)


def regex_split(text: Column, pattern: str, flags: int = 0, limit: int = -1) -> Column:
    """Parts between matches; with a limit at most so many splits, the rest stays as the last part."""
    return F.split(text, flagged(pattern, flags), limit + 1 if limit > 0 else -1)


def _strength(strength: str | None) -> str:
    if strength and strength.lower() not in STRENGTHS:
        raise ValueError(f"unknown strength {strength!r}")
    return (strength or "").lower()


def collated(text: Column, locale: str = "en_US", strength: str | None = None) -> Column:
    """The text under Spark's own collation of the locale's language (up to tertiary strength)."""
    suffix = {"": "", "tertiary": "", "secondary": "_CI", "primary": "_CI_AI"}[_strength(strength)]
    return F.collate(text, ("UNICODE" if locale.startswith("en") else locale.split("_")[0]) + suffix)


def sort_key(text: Column, locale: str = "en_US", strength: str | None = None, case_first: str | None = None) -> Column:
    """Binary key whose byte order is the collation order, for any strength and case order."""
    return jvm.binary("sort_key", locale, _strength(strength), case_first or "", text)


def compare(a: Column, b: Column, locale: str = "en_US", strength: str | None = None) -> Column:
    """-1, 0 or 1."""
    return jvm.text("compare", locale, _strength(strength), a, b).cast("int")


def search_all(text: Column, pattern: Column | str, locale: str = "en_US", strength: str | None = None) -> Column:
    """Non-overlapping matches under a collation as `(start, end, text)`, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = jvm.array("search", locale, _strength(strength), pattern, text)

    def match(record: Column) -> Column:
        start, end = (F.split_part(record, F.lit("\u001f"), F.lit(k)).cast("int") for k in (1, 2))
        return F.struct(start.alias("start"), end.alias("end"), F.substr(text, start + 1, end - start).alias("text"))

    return F.transform(found, match)


def search_first(text: Column, pattern: Column | str, locale: str = "en_US", strength: str | None = None) -> Column:
    return F.get(search_all(text, pattern, locale, strength), F.lit(0))


def search_count(text: Column, pattern: Column | str, locale: str = "en_US", strength: str | None = None) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.size(jvm.array("search", locale, _strength(strength), pattern, text))


def search_contains(text: Column, pattern: Column | str, locale: str = "en_US", strength: str | None = None) -> Column:
    return search_count(text, pattern, locale, strength) > 0


def search_replace(text: Column, pattern: Column | str, replacement: str, locale: str = "en_US", strength: str | None = None, count: int = 0) -> Column:
    """Replace all matches, or the first `count`."""
    found = search_all(text, pattern, locale, strength)
    found = F.slice(found, 1, count) if count > 0 else found
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, m: F.struct(m["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, m["start"] - a["at"]), F.lit(replacement)).alias("out"))
    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def index_bucket(name: Column, locale: str = "en_US") -> Column:
    """Label of the name's bucket in the locale's alphabetic index."""
    return jvm.text("index_bucket", locale, name)
