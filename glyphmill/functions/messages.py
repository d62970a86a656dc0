"""Message patterns compiled to column expressions: literal text, choices and nesting are Spark's own functions.

The pattern is read once, where the expression is built.  What depends on a locale is asked for at numbers and dates alone,
by the functions of `formatting`, and a plural asks for its category only if no explicit number matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import formatting

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_CHOICES = ("plural", "selectordinal", "select")


@dataclass
class Argument:
    """`{name}` or `{name, kind, style}`; `source` is the text of the argument."""

    name: str
    kind: str = ""
    source: str = ""


@dataclass
class Choice:
    """`{name, plural|selectordinal|select, ..}`: the parts of the message of each selector."""

    name: str
    kind: str
    offset: str = "0"
    cases: dict[str, list] = field(default_factory=dict)


class Hash:
    """The number of the plural around it."""


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def fail(self, what: str):
        raise ValueError(f"{what} at {self.at} of the message pattern {self.text!r}")

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def word(self, stop: str) -> str:
        self.blanks()
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in stop and not self.text[self.at].isspace():
            self.at += 1
        found = self.text[begin : self.at]
        self.blanks()
        return found or self.fail("a name is missing")

    def quoted(self, special: str) -> str:
        """Text behind an apostrophe: itself where it is doubled, what it quotes up to the next one, else an apostrophe."""
        self.at += 1
        following = self.text[self.at : self.at + 1]
        if following == "'":
            self.at += 1
            return "'"
        if not following or following not in special:
            return "'"
        out = []
        while self.at < len(self.text):
            char = self.text[self.at]
            self.at += 1
            if char != "'":
                out.append(char)
            elif self.text[self.at : self.at + 1] == "'":
                out.append("'")
                self.at += 1
            else:
                break
        return "".join(out)

    def message(self, nested: bool, plural: bool) -> list:
        parts: list = []
        held: list[str] = []

        def put(part=None) -> None:
            if held:
                parts.append("".join(held))
                held.clear()
            if part is not None:
                parts.append(part)

        while self.at < len(self.text):
            char = self.text[self.at]
            if char == "'":
                held.append(self.quoted("{}#" if plural else "{}"))
            elif char == "{":
                put(self.argument())
            elif char == "}":
                if nested:
                    break
                self.fail("a brace that was not opened")
            elif char == "#" and plural:
                self.at += 1
                put(Hash())
            else:
                held.append(char)
                self.at += 1
        put()
        return parts

    def argument(self) -> Argument | Choice:
        begin = self.at
        self.at += 1
        name = self.word(",{}'")
        if self.text[self.at : self.at + 1] == "}":
            self.at += 1
            return Argument(name, source=self.text[begin : self.at])
        if self.text[self.at : self.at + 1] != ",":
            self.fail("neither a comma nor a brace")
        self.at += 1
        kind = self.word(",{}'")
        if kind in _CHOICES:
            return self.choice(name, kind)
        depth = 1
        while depth:
            if self.at >= len(self.text):
                self.fail("a brace that is not closed")
            char = self.text[self.at]
            if char == "'":
                self.quoted("{}")
                continue
            depth += (char == "{") - (char == "}")
            self.at += 1
        return Argument(name, kind, self.text[begin : self.at])

    def choice(self, name: str, kind: str) -> Choice:
        out = Choice(name, kind)
        if self.text[self.at : self.at + 1] != ",":
            self.fail("a choice without cases")
        self.at += 1
        self.blanks()
        if kind != "select" and self.text.startswith("offset:", self.at):
            self.at += len("offset:")
            out.offset = self.word("{}")
            if not _NUMBER.fullmatch(out.offset):
                self.fail("an offset that is no number")
        while True:
            self.blanks()
            if self.at >= len(self.text):
                self.fail("a brace that is not closed")
            if self.text[self.at] == "}":
                self.at += 1
                break
            selector = self.word("{}")
            if selector.startswith("=") and (kind == "select" or not _NUMBER.fullmatch(selector[1:])):
                self.fail("a selector that is no number")
            if self.text[self.at : self.at + 1] != "{":
                self.fail("a selector without a message")
            self.at += 1
            parts = self.message(True, kind != "select")
            if self.text[self.at : self.at + 1] != "}":
                self.fail("a brace that is not closed")
            self.at += 1
            out.cases.setdefault(selector, parts)
        if "other" not in out.cases:
            self.fail("a choice without a case `other`")
        return out


def read_pattern(pattern: str) -> list:
    """Parts of a message pattern: texts, `Argument`, `Choice` and, in plurals, `Hash`.  A pattern that is wrong is an error."""
    reader = _Reader(pattern)
    return reader.message(False, False)


def _number(value: Column) -> Column:
    return value.cast("decimal(38,10)")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, however often the use names it."""
    return F.transform(F.array(value), use)[0]


class _Compiler:
    def __init__(self, args: dict[str, Column], locale: str, types: dict[str, str]):
        self.args, self.locale, self.types = args, locale, types

    def parts(self, parts: list, number: Column | None = None) -> Column:
        made = [F.lit(p) if isinstance(p, str) else self.part(p, number) for p in parts]
        return made[0] if len(made) == 1 else F.concat(*made) if made else F.lit("")

    def part(self, part, number: Column | None) -> Column:
        if isinstance(part, Hash):
            return formatting.format_number(number, self.locale)
        if part.name not in self.args:
            if isinstance(part, Choice):
                raise ValueError(f"no argument {part.name!r} to choose by")
            return F.lit("{" + part.name + "}")
        value = self.args[part.name]
        if isinstance(part, Choice):
            return self.select(part, value) if part.kind == "select" else self.plural(part, value)
        if part.kind or self.types.get(part.name) == "date":
            return formatting.format_message(part.source, {part.name: value}, self.locale, {part.name: self.types.get(part.name, "text")})
        if self.types.get(part.name) == "number":
            return formatting.format_number(value, self.locale)
        return F.coalesce(value.cast("string"), F.lit(""))

    def select(self, part: Choice, value: Column) -> Column:
        other = self.parts(part.cases["other"])
        out = None
        for selector, parts in part.cases.items():
            if selector != "other":
                out = (F if out is None else out).when(value.cast("string") == selector, self.parts(parts))
        return other if out is None else out.otherwise(other)

    def plural(self, part: Choice, value: Column) -> Column:
        value = _number(value)
        less = value - F.lit(part.offset).cast("decimal(38,10)") if float(part.offset) else value
        exact = {s[1:]: p for s, p in part.cases.items() if s.startswith("=")}
        named = {s: p for s, p in part.cases.items() if not s.startswith("=") and s != "other"}
        other = self.parts(part.cases["other"], less)
        if named:
            category = formatting.plural_category if part.kind == "plural" else formatting.ordinal_category

            def by_category(c: Column) -> Column:
                out = None
                for selector, parts in named.items():
                    out = (F if out is None else out).when(c == selector, self.parts(parts, less))
                return out.otherwise(other)

            other = _once(category(less, self.locale), by_category)
        out = F.when(value.isNull(), F.lit(None).cast("string"))
        for n, parts in exact.items():
            out = out.when(value == F.lit(n).cast("decimal(38,10)"), self.parts(parts, less))
        return out.otherwise(other)


def compile_message(pattern: str, args: dict[str, Column], locale: str = "en_US", types: dict[str, str] | None = None) -> Column:
    """A message pattern with named arguments, as an expression over them; `types` as in `formatting.format_message`.

    Null texts count as empty; a null number makes the message null; a name without an argument stays in its braces, and is an
    error where the message depends on it, as is a pattern that cannot be read.  In plurals `#` is the number less the
    offset; explicit numbers (`=0`) are compared before it.  Numbers have at most 28 digits before and 10 behind the point.
    """
    return _Compiler(args, locale, types or {}).parts(read_pattern(pattern))
