"""Command line: `python -m glyphmill COMMAND SUBCOMMAND [--option value] [-t TEXT | FILE]`.

Commands and subcommands may be shortened to any unambiguous beginning.  Text commands work on each line of their input;
table commands print reference data.  `-j` prints JSON lines instead of tab-separated ones, `-H` a line of column names
first, `-c a,b` some columns only, `-o` writes to a folder; `-w` takes a file as one text, `-r` reads rules from a file.
The exit code of a command that answers yes or no is 0 if any line's answer is yes, else 1.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill import discover
from glyphmill.functions import formatting as fmt
from glyphmill.functions import locales as loc
from glyphmill.functions import matching as m
from glyphmill.functions import text as t
from glyphmill.operators import tables
from glyphmill.sources import catalogues as cat
from glyphmill.sources import files

Options = dict[str, str]
LOCALE = {"locale": "en_US"}
SEARCH = {"pattern": "", "locale": "en_US", "strength": "tertiary"}
REGEX = {"pattern": "", "flags": "0"}
WIDTH = {"locale": "en_US", "width": "WIDE"}

#: Examples of message patterns.
MESSAGES = [
    ("plain", "Hello, {name}!"), ("number", "{n, number} items"), ("plural", "{n, plural, =0 {none} one {# item} other {# items}}"),
    ("select", "{who, select, female {she} male {he} other {they}}"), ("ordinal", "{n, selectordinal, one {#st} two {#nd} few {#rd} other {#th}}"),
]


def _types(types: str) -> dict[str, str]:
    """`name=kind,...` as a dictionary: the kinds of a message's arguments."""
    return dict(x.split("=", 1) for x in types.split(",") if "=" in x)


def _arguments(line: Column, types: str) -> dict[str, Column]:
    """Arguments of a message from a line of tab-separated cells: named as `types` names them in turn, else by their places."""
    cells = F.split(line, "\t")
    names = [x.split("=")[0] for x in types.split(",") if x] or [str(k) for k in range(10)]
    return {n: F.coalesce(F.get(cells, F.lit(k)), F.lit("")) for k, n in enumerate(names)}


def _sequence(line: Column, o: Options) -> Column:
    """Measures side by side: the numbers of a line, parted by spaces, in the units that are named."""
    cells = F.split(F.trim(line), r"[\s,]+")
    return fmt.format_measures([(F.get(cells, F.lit(k)), u.strip()) for k, u in enumerate(o["units"].split(","))], o["locale"], o["width"])


#: Functions of the text of a line: what to compute, and the options with their defaults.
TEXT: dict[tuple[str, str], tuple[Callable[[Column, Options], Column], Options]] = {
    ("alpha-index", "bucket"): (lambda c, o: m.index_bucket(c, o["locale"]), LOCALE),
    ("bidi", "detect"): (lambda c, o: t.bidi_info(c), {}),
    ("bidi", "strip"): (lambda c, o: t.strip_bidi_controls(c), {}),
    ("bidi", "check"): (lambda c, o: t.has_bidi_controls(c), {}),
    ("break", "sentences"): (lambda c, o: F.transform(t.break_sentences(c, o["locale"]), lambda s: F.trim(s)), LOCALE),
    ("break", "words"): (lambda c, o: t.break_words(c, o["locale"]), LOCALE),
    ("break", "lines"): (lambda c, o: t.break_lines(c, o["locale"]), LOCALE),
    ("break", "graphemes"): (lambda c, o: t.grapheme_report(c), {}),
    ("break", "tokenize"): (lambda c, o: t.tokenize_sentences(c, o["locale"]), LOCALE),
    ("collate", "compare"): (lambda c, o: m.compare(c, F.lit(o["with"]), o["locale"], o["strength"]), {"with": "", "locale": "en_US", "strength": "tertiary"}),
    ("compact", "format"): (lambda c, o: fmt.format_compact(c, o["locale"], o["style"]), {"locale": "en_US", "style": "SHORT"}),
    ("datetime", "format"): (lambda c, o: fmt.format_datetime(F.to_timestamp(c), o["locale"], o["calendar"], pattern=o["pattern"]), {"locale": "en_US", "calendar": "", "pattern": ""}),
    ("datetime", "parse"): (lambda c, o: fmt.parse_datetime(c, o["locale"], pattern=o["pattern"]), {"locale": "en_US", "pattern": ""}),
    ("datetime", "relative"): (lambda c, o: fmt.format_relative(c, o["locale"]), LOCALE),
    ("datetime", "interval"): (lambda c, o: fmt.format_interval(F.to_timestamp(c), F.to_timestamp(F.lit(o["end"])), o["locale"], o["skeleton"]), {"end": "", "locale": "en_US", "skeleton": "yMMMd"}),
    ("duration", "format"): (lambda c, o: fmt.format_duration(c, o["locale"], o["width"]), WIDTH),
    ("duration", "iso"): (lambda c, o: fmt.format_iso_duration(c, o["locale"], o["width"]), WIDTH),
    ("duration", "parse"): (lambda c, o: fmt.parse_iso_duration(c), {}),
    ("idna", "encode"): (lambda c, o: t.idna_encode(c), {}),
    ("idna", "decode"): (lambda c, o: t.idna_decode(c), {}),
    ("listfmt", "format"): (
        lambda c, o: fmt.format_list(F.filter(F.transform(F.split(c, o["separator"]), lambda x: F.trim(x)), lambda x: x != ""), o["locale"], o["style"]),
        {"locale": "en_US", "style": "and", "separator": ","},
    ),
    ("locale", "format"): (lambda c, o: fmt.format_number(c, o["locale"]), LOCALE),
    ("locale", "currency"): (lambda c, o: fmt.format_currency(c, o["locale"], o["currency"]), {"locale": "en_US", "currency": ""}),
    ("locale", "percent"): (lambda c, o: fmt.format_percent(c, o["locale"]), LOCALE),
    ("locale", "scientific"): (lambda c, o: fmt.format_scientific(c, o["locale"]), LOCALE),
    ("locale", "spellout"): (lambda c, o: fmt.format_spellout(c, o["locale"]), LOCALE),
    ("locale", "ordinal"): (lambda c, o: fmt.format_ordinal(c, o["locale"]), LOCALE),
    ("locale", "name"): (lambda c, o: loc.display_name(c, "locale", o["locale"]), LOCALE),
    ("locale", "info"): (lambda c, o: loc.locale_info(c), {}),
    ("locale", "parse"): (lambda c, o: loc.parse_locale(c), {}),
    ("locale", "expand"): (lambda c, o: loc.add_likely_subtags(c), {}),
    ("locale", "minimize"): (lambda c, o: loc.minimize_subtags(c), {}),
    ("locale", "validate"): (lambda c, o: loc.is_valid_locale(c), {}),
    ("locale", "canonicalize"): (lambda c, o: loc.canonicalize(c), {}),
    ("locale", "attrs"): (lambda c, o: loc.locale_attributes(c), {}),
    ("locale", "extended"): (lambda c, o: loc.locale_extended(c), {}),
    ("locale", "scripts"): (lambda c, o: loc.locale_scripts(c), {}),
    ("locale", "compact"): (lambda c, o: fmt.format_compact(c, o["locale"], o["style"]), {"locale": "en_US", "style": "SHORT"}),
    ("locale", "compare"): (lambda c, o: m.compare(c, F.lit(o["with"]), o["locale"], o["strength"]), {"with": "", "locale": "en_US", "strength": "tertiary"}),
    ("message", "format"): (lambda c, o: fmt.format_message(o["pattern"], _arguments(c, o["types"]), o["locale"], _types(o["types"])), {"pattern": "{0}", "types": "", "locale": "en_US"}),
    ("measure", "info"): (lambda c, o: fmt.unit_info(F.trim(c)), {}),
    ("measure", "abbreviation"): (lambda c, o: fmt.unit_abbreviation(F.trim(c), o["locale"]), LOCALE),
    ("measure", "check"): (lambda c, o: fmt.can_convert(F.trim(c), F.lit(o["to"])), {"to": "mile"}),
    ("measure", "usage"): (lambda c, o: fmt.format_for_usage(c, o["unit"], o["locale"], o["usage"], o["width"]), {"unit": "meter", "usage": "default"} | WIDTH),
    ("measure", "sequence"): (lambda c, o: _sequence(c, o), {"units": "foot,inch"} | WIDTH),
    ("regex", "validate"): (lambda c, o: m.regex_valid(c, int(o["flags"])), {"flags": "0"}),
    ("spoof", "info"): (lambda c, o: t.confusable_info(c, F.lit(o["with"])), {"with": ""}),
    ("transliterate", "script"): (lambda c, o: t.transliterate(c, f"Any-{o['to']}"), {"to": "Latin"}),
    ("unicode", "name"): (lambda c, o: F.transform(F.split(c, ""), t.char_name), {}),
    ("unicode", "category"): (lambda c, o: F.transform(F.split(c, ""), t.char_category), {}),
    ("measure", "format"): (lambda c, o: fmt.format_measure(c, o["unit"], o["locale"], o["width"]), {"unit": "meter"} | WIDTH),
    ("measure", "convert"): (lambda c, o: fmt.convert_and_format(c, o["unit"], o["to"], o["locale"], o["width"]), {"unit": "kilometer", "to": "mile"} | WIDTH),
    ("measure", "range"): (lambda c, o: fmt.format_measure_range(c, F.lit(o["high"]), o["unit"], o["locale"], o["width"]), {"high": "1", "unit": "meter"} | WIDTH),
    ("parse", "number"): (lambda c, o: fmt.parse_number(c, o["locale"]), LOCALE),
    ("parse", "currency"): (lambda c, o: fmt.parse_currency(c, o["locale"]), LOCALE),
    ("parse", "percent"): (lambda c, o: fmt.parse_percent(c, o["locale"]), LOCALE),
    ("plural", "select"): (lambda c, o: fmt.plural_category(c, o["locale"]), LOCALE),
    ("plural", "ordinal"): (lambda c, o: fmt.ordinal_category(c, o["locale"]), LOCALE),
    ("regex", "find"): (lambda c, o: m.regex_find_all(c, o["pattern"], int(o["flags"])), REGEX),
    ("regex", "replace"): (lambda c, o: m.regex_replace(c, o["pattern"], o["with"], int(o["flags"]), int(o["limit"])), REGEX | {"with": "", "limit": "-1"}),
    ("regex", "split"): (lambda c, o: m.regex_split(c, o["pattern"], int(o["flags"])), REGEX),
    ("regex", "match"): (lambda c, o: m.regex_match(F.trim(c), o["pattern"], int(o["flags"])), REGEX),
    ("regex", "search"): (lambda c, o: m.regex_search(c, o["pattern"], int(o["flags"])), REGEX),
    ("regex", "script"): (lambda c, o: m.sed(c, o["expression"]), {"expression": "s/a/a/"}),
    ("script", "detect"): (lambda c, o: t.detect_scripts(c), {}),
    ("script", "rtl"): (lambda c, o: t.is_rtl(c), {}),
    ("search", "find"): (lambda c, o: m.search_all(c, o["pattern"], o["locale"], o["strength"]), SEARCH),
    ("search", "first"): (lambda c, o: m.search_first(c, o["pattern"], o["locale"], o["strength"]), SEARCH),
    ("search", "count"): (lambda c, o: m.search_count(c, o["pattern"], o["locale"], o["strength"]), SEARCH),
    ("search", "replace"): (lambda c, o: m.search_replace(c, o["pattern"], o["with"], o["locale"], o["strength"]), SEARCH | {"with": ""}),
    ("search", "contains"): (lambda c, o: m.search_contains(c, o["pattern"], o["locale"], o["strength"]), SEARCH),
    ("spoof", "compare"): (lambda c, o: t.confusable_info(c, F.lit(o["with"])), {"with": ""}),
    ("spoof", "skeleton"): (lambda c, o: t.skeleton(c), {}),
    ("spoof", "check"): (lambda c, o: t.check_string(c), {}),
    ("timezone", "info"): (lambda c, o: loc.timezone_info(c), {}),
    ("transliterate", "name"): (lambda c, o: t.transliterate(c, o["id"]), {"id": "Any-Latin"}),
    ("transliterate", "from"): (lambda c, o: t.transliterate(c, o["id"], reverse=True), {"id": "Any-Latin"}),
    ("transliterate", "rules"): (lambda c, o: t.transliterate_rules(c, o["rules"]), {"rules": ""}),
    ("unicode", "normalize"): (lambda c, o: t.normalize(c, o["form"]), {"form": "NFC"}),
    ("unicode", "check"): (lambda c, o: t.is_normalized(c, o["form"]), {"form": "NFC"}),
    ("unicode", "info"): (lambda c, o: F.transform(F.split(c, ""), t.char_info), {}),
    ("unicode", "encode"): (lambda c, o: t.escape_encode(c, o["style"]), {"style": "u"}),
    ("unicode", "decode"): (lambda c, o: t.escape_decode(c), {}),
} | {("displayname", kind): (lambda c, o, kind=kind: loc.display_name(c, kind, o["locale"]), LOCALE) for kind in loc.KINDS}

#: Tables of reference data.
TABLES: dict[tuple[str, str], tuple[Callable[[SparkSession, Options], DataFrame], Options]] = {
    ("alpha-index", "labels"): (lambda s, o: cat.index_labels(s, o["locale"]), LOCALE),
    ("bidi", "list"): (lambda s, o: cat.bidi_controls(s), {}),
    ("calendar", "list"): (lambda s, o: cat.calendars(s), {}),
    ("calendar", "info"): (lambda s, o: cat.calendar_info(s, o["type"]), {"type": "gregorian"}),
    ("collate", "list"): (lambda s, o: cat.collation_types(s), {}),
    ("collate", "info"): (lambda s, o: cat.collator_info(s, o["locale"]), LOCALE),
    ("datetime", "symbols"): (lambda s, o: cat.date_symbols(s, o["locale"], o["calendar"]), {"locale": "en_US", "calendar": ""}),
    ("datetime", "calendars"): (lambda s, o: cat.calendars(s), {}),
    ("datetime", "months"): (lambda s, o: cat.date_symbols(s, o["locale"], o["calendar"]).filter(F.col("kind").startswith("months")), {"locale": "en_US", "calendar": ""}),
    ("datetime", "weekdays"): (lambda s, o: cat.date_symbols(s, o["locale"], o["calendar"]).filter(F.col("kind").startswith("weekdays")), {"locale": "en_US", "calendar": ""}),
    ("datetime", "eras"): (lambda s, o: cat.date_symbols(s, o["locale"], o["calendar"]).filter(F.col("kind").startswith("eras")), {"locale": "en_US", "calendar": ""}),
    ("datetime", "ampm"): (lambda s, o: cat.date_symbols(s, o["locale"], "").filter(F.col("kind") == "am_pm"), LOCALE),
    ("datetime", "patterns"): (lambda s, o: s.createDataFrame(list(fmt.PATTERNS.items()), "name string, pattern string"), {}),
    ("discover", "all"): (lambda s, o: discover.features_table(s), {}),
    ("discover", "api"): (lambda s, o: discover.features_table(s), {}),
    ("discover", "cli"): (lambda s, o: discover.commands_table(s), {}),
    ("discover", "search"): (lambda s, o: s.createDataFrame(discover.search(o["query"]), "module string, name string, signature string, doc string"), {"query": ""}),
    ("locale", "list"): (lambda s, o: cat.locales(s), {}),
    ("locale", "languages"): (lambda s, o: cat.languages(s), {}),
    ("locale", "exemplars"): (lambda s, o: cat.exemplars(s, o["locale"], o["type"]), {"locale": "en_US", "type": "standard"}),
    ("locale", "symbols"): (lambda s, o: cat.number_symbols(s, o["locale"]), LOCALE),
    ("locale", "default"): (lambda s, o: s.createDataFrame([(loc.default_locale(s),)], "locale string"), {}),
    ("locale", "exemplar-info"): (lambda s, o: cat.exemplar_info(s, o["locale"]), LOCALE),
    ("locale", "exemplar-types"): (lambda s, o: cat.exemplar_types(s), {}),
    ("message", "examples"): (lambda s, o: s.createDataFrame(MESSAGES, "what string, pattern string"), {}),
    ("measure", "units"): (lambda s, o: cat.units(s, o["type"] or None), {"type": ""}),
    ("measure", "types"): (lambda s, o: cat.units(s).groupBy("type").count().orderBy("type"), {}),
    ("plural", "categories"): (lambda s, o: cat.plural_info(s, o["locale"], o["ordinal"] == "yes").select("category"), {"locale": "en_US", "ordinal": "no"}),
    ("plural", "info"): (lambda s, o: cat.plural_info(s, o["locale"]), LOCALE),
    ("regex", "list"): (lambda s, o: cat.properties(s), {}),
    ("region", "list"): (lambda s, o: cat.regions(s, o["type"]), {"type": "territory"}),
    ("region", "info"): (lambda s, o: cat.region_info(s, o["code"]), {"code": "US"}),
    ("region", "types"): (lambda s, o: cat.region_types(s), {}),
    ("region", "contains"): (lambda s, o: cat.region_edges(s).filter(F.col("parent") == o["code"]), {"code": "001"}),
    ("script", "info"): (lambda s, o: cat.script_info(s, o["script"]), {"script": "Latn"}),
    ("script", "list"): (lambda s, o: cat.scripts(s), {}),
    ("timezone", "list"): (lambda s, o: cat.timezones(s, o["country"] or None), {"country": ""}),
    ("timezone", "equiv"): (lambda s, o: cat.equivalent_timezones(s, o["id"]), {"id": "UTC"}),
    ("transliterate", "list"): (lambda s, o: cat.transliterators(s), {}),
    ("transliterate", "info"): (lambda s, o: cat.transliterator_info(s, o["id"]), {"id": "Any-Latin"}),
    ("transliterate", "characters"): (lambda s, o: cat.transliterator_set(s, o["id"], o["side"]), {"id": "Any-Latin", "side": "source"}),
    ("unicode", "list"): (lambda s, o: cat.categories(s), {}),
    ("unicode", "block"): (lambda s, o: cat.characters(s, f"[:block={o['name']}:]"), {"name": "Arrows"}),
    ("unicode", "blocks"): (lambda s, o: cat.blocks(s), {}),
    ("unicode", "categories"): (lambda s, o: cat.categories(s), {}),
    ("unicode", "characters"): (lambda s, o: cat.characters(s, o["set"]), {"set": "[:Lu:]"}),
}

#: Operators on all lines together.
LINES: dict[tuple[str, str], tuple[Callable[[DataFrame, Options], DataFrame], Options]] = {
    ("alpha-index", "buckets"): (lambda d, o: tables.index_buckets(d, "text", o["locale"]), LOCALE),
    ("collate", "sort"): (lambda d, o: tables.sort_table(d, "text", o["locale"], o["reverse"] == "yes", o["strength"]), {"locale": "en_US", "reverse": "no", "strength": "tertiary"}),
    ("locale", "sort"): (lambda d, o: tables.sort_table(d, "text", o["locale"], o["reverse"] == "yes"), {"locale": "en_US", "reverse": "no"}),
    ("sort", "lines"): (lambda d, o: tables.sort_table(d, "text", o["locale"], o["reverse"] == "yes"), {"locale": "en_US", "reverse": "no"}),
    ("sort", "unique"): (lambda d, o: tables.unique_sorted(d, "text", o["locale"], o["reverse"] == "yes"), {"locale": "en_US", "reverse": "no"}),
    ("collate", "unique"): (lambda d, o: tables.unique_sorted(d, "text", o["locale"]), LOCALE),
}


def resolve(word: str, names: list[str]) -> str:
    """The name that a word abbreviates; an exact name wins."""
    found = [n for n in names if n == word] or [n for n in names if n.startswith(word)]
    if len(found) != 1:
        raise SystemExit(f"{'ambiguous' if found else 'unknown'}: {word}; one of {', '.join(found or names)}")
    return found[0]


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    keys = sorted({*TEXT, *TABLES, *LINES})
    if len(argv) < 2:
        raise SystemExit(f"{__doc__}\n" + "\n".join(" ".join(k) for k in keys))
    command = resolve(argv[0], sorted({c for c, _ in keys}))
    key = (command, resolve(argv[1], [s for c, s in keys if c == command]))
    run, defaults = (TEXT | TABLES | LINES)[key]
    parser = argparse.ArgumentParser(prog=" ".join(key))
    for name, default in defaults.items():
        parser.add_argument(f"--{name}", default=default)
    parser.add_argument("-t", "--text")
    parser.add_argument("-j", "--json", action="store_true")
    parser.add_argument("-H", "--header", action="store_true")
    parser.add_argument("-c", "--columns")
    parser.add_argument("-w", "--whole", action="store_true")
    parser.add_argument("-r", "--rules-file")
    parser.add_argument("-o", "--output")
    parser.add_argument("file", nargs="?")
    args = parser.parse_args(argv[2:])
    options = {name: getattr(args, name) for name in defaults}
    if args.rules_file and "rules" in options:
        options["rules"] = Path(args.rules_file).read_text(encoding="utf-8")
    spark = SparkSession.builder.getOrCreate()
    show = _Shown(args, answers=key not in TABLES)
    if key in TABLES:
        show(run(spark, options))
    elif key in LINES:
        if args.file:
            lines = files.read_whole(spark, args.file) if args.whole else files.read_lines(spark, args.file)
        elif args.text is not None:
            lines = spark.createDataFrame([(args.text,)], "text string")
        else:
            lines = spark.read.parquet(files.spool(spark, sys.stdin)).select("text")
        show(run(lines, options))
    else:
        answer = lambda lines: lines.select(run(F.col("text"), options).alias("result"))
        if args.file:
            show(answer(files.read_whole(spark, args.file) if args.whole else files.read_lines(spark, args.file)))
        elif args.text is not None:
            show(answer(spark.createDataFrame([(args.text,)], "text string")))
        elif args.whole:
            show(answer(spark.createDataFrame([(sys.stdin.read(),)], "text string")))
        elif args.output:
            show(answer(spark.read.parquet(files.spool(spark, sys.stdin)).orderBy("n")))
        else:  # lines are answered as they come
            for held in files.in_batches(sys.stdin):
                show(answer(spark.createDataFrame([(x,) for x in held], "text string")))
    if show.answers and not show.yes:
        raise SystemExit(1)


class _Shown:
    """Tables on standard output, or in a folder, and whether any of their answers was yes."""

    def __init__(self, args: argparse.Namespace, answers: bool) -> None:
        self.args, self.may_answer = args, answers
        self.yes = self.answers = self.headed = False

    def __call__(self, out: DataFrame) -> None:
        args = self.args
        columns = args.columns.split(",") if args.columns else None
        if columns and (unknown := set(columns) - set(out.columns)):
            raise SystemExit(f"unknown columns: {', '.join(sorted(unknown))}; one of {', '.join(out.columns)}")
        self.answers = self.may_answer and dict(out.dtypes).get("result") == "boolean"
        shown = files.as_json(out.select(*columns) if columns else out) if args.json else files.as_tsv(out, columns)
        if args.output:
            files.write_lines(shown, args.output)
            self.yes = self.answers and not out.filter("result").isEmpty()
            return
        if args.header and not args.json and not self.headed:
            print(files.tsv_header(out, columns))
        self.headed = True
        for row in shown.toLocalIterator():
            print(row.line, flush=True)
            self.yes = self.yes or row.line in ("yes", '{"result":true}')
