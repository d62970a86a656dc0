"""Tokens of texts of any length: a long text is cut at safe breaks, and only the tokens of one window stand at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text

WINDOW = 1 << 16

#: Where a text may be cut, by kind of token, as patterns over bytes that end at the cut.  A line feed ends a token of every
#: kind.  The other cuts have a space before them and ASCII letters near it, so no rule of segmentation reaches across:
#: a word or grapheme never goes on from a space to a letter; a line may break between two lower-case words; a sentence
#: ends between its mark and a capital.
SAFE = {
    "word": r"\n| (?=[A-Za-z])",
    "grapheme": r"\n| (?=[A-Za-z])",
    "line": r"\n|[a-z] (?=[a-z])",
    "sentence": r"\n|[.?!] (?=[A-Z])",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _cuts(data: Column, kind: str, window: int) -> Column:
    """Byte offsets of the first safe break in each stretch of `window` bytes after the first stretch, in order."""
    # one character a byte: a byte of a character beyond ASCII is none of those that the patterns name
    stretch = lambda k: F.decode(F.substring(data, k * window + 1, F.lit(window + 1)), "ISO-8859-1")
    found = lambda k: F.length(F.regexp_extract(stretch(k), rf"(?s)\A.*?(?:{SAFE[kind]})", 0))
    at = F.transform(F.sequence(F.lit(1), F.floor(F.octet_length(data) / window).cast("int")), lambda k: _let(found(k), lambda n: F.when(n > 0, k * window + n)))
    ends = F.array_distinct(F.array_compact(at))
    return F.when(F.octet_length(data) > window, F.filter(ends, lambda e: e < F.octet_length(data))).otherwise(F.array().cast("array<int>"))


def windows(of: Column, kind: str = "word", window: int = WINDOW) -> Column:
    """The text in consecutive parts that a token of `kind` never spans; null for null, one empty part for an empty text.

    A part is `window` to twice as many bytes where safe breaks are frequent; where there are none it goes on to the next.
    """
    if kind not in SAFE:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(SAFE)}")
    if window < 1:
        raise ValueError("a window has at least one byte")

    def parts(data: Column) -> Column:
        def split(ends: Column) -> Column:
            start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
            return F.transform(ends, lambda end, k: F.decode(F.substring(data, start(k) + 1, end - start(k)), "UTF-8"))

        return _let(F.concat(_cuts(data, kind, window), F.array(F.octet_length(data))), split)

    whole = of.cast("string")
    return F.when(F.octet_length(whole) <= window, F.array(whole)).when(whole.isNotNull(), _let(whole.cast("binary"), parts))


def _tokens(part: Column, kind: str, locale: str) -> Column:
    breaks = {"sentence": text.break_sentences, "word": text.break_words, "line": text.break_lines}
    return text.break_graphemes(part) if kind == "grapheme" else breaks[kind](part, locale)


def long_tokens(df: DataFrame, column: str, kind: str = "word", locale: str = "en_US", window: int = WINDOW, spread: int = 0) -> DataFrame:
    """`tables.tokens` for texts of any length: the same rows, `position` and `token` added, in the place of columns of those names.

    The parts of a text become rows one after another, and each is broken by itself, so the tokens of a whole text never
    stand in an array; a task holds a few copies of the longest text and the tokens of a part.  Only texts of several parts
    are broken twice, to number their tokens.  With `spread`, parts are dealt over so many partitions, so a text that is
    most of the table is broken by many tasks.  Null and empty texts have no tokens.

    All columns stay, so a result that is written with its text holds each text once a token, the square of its length:
    select the columns that name the row instead, and the text is not carried beside its tokens.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("position", "token")]
    count = lambda part: F.size(_tokens(part, kind, locale))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts"))
    add = lambda a, n: F.struct((a["next"] + n).alias("next"), F.concat(a["starts"], F.array(a["next"])).alias("starts"))
    numbered = lambda ps: F.arrays_zip(ps.alias("part"), F.aggregate(F.transform(ps, count), start, add, lambda a: a["starts"]).alias("first"))
    alone = lambda ps: F.arrays_zip(ps.alias("part"), F.array(F.lit(0)).alias("first"))
    kept = "array<struct<part: string, first: int>>"
    parts = _let(windows(F.col(f"`{column}`"), kind, window), lambda ps: F.when(F.size(ps) > 1, numbered(ps).cast(kept)).otherwise(alone(ps).cast(kept)))
    rows = df.select(*others, F.inline(F.coalesce(parts, F.array().cast(kept))).alias("glyphmill_part", "glyphmill_first"))
    if spread:
        rows = rows.repartition(spread)
    found = rows.select(*others, "glyphmill_first", F.posexplode(_tokens(F.col("glyphmill_part"), kind, locale)).alias("glyphmill_at", "token"))
    return found.select(*others, (F.col("glyphmill_first") + F.col("glyphmill_at")).alias("position"), "token")
