"""Numbers, plurals, measures, durations, lists, messages and dates: formatting and parsing."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glyphmill import jvm

SECONDS = {"YEAR": 31_536_000, "MONTH": 2_592_000, "WEEK": 604_800, "DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}
STYLES = ("FULL", "LONG", "MEDIUM", "SHORT", "NONE")
#: Named date patterns.
PATTERNS = {
    "ISO_DATE": "yyyy-MM-dd", "ISO_TIME": "HH:mm:ss", "ISO_DATETIME": "yyyy-MM-dd'T'HH:mm:ss", "US_DATE": "MM/dd/yyyy",
    "EU_DATE": "dd/MM/yyyy", "LONG_DATE": "EEEE, MMMM d, yyyy", "TIME_12H": "h:mm a", "TIME_24H": "HH:mm",
}
#: The directed conversions, as what is added first, the factor, the divisor, and what is added last.
CONVERSIONS = {
    ("kilometer", "mile"): (0, 0.621371, 1, 0), ("mile", "kilometer"): (0, 1.60934, 1, 0), ("meter", "foot"): (0, 3.28084, 1, 0), ("foot", "meter"): (0, 0.3048, 1, 0),
    ("meter", "yard"): (0, 1.09361, 1, 0), ("yard", "meter"): (0, 0.9144, 1, 0), ("inch", "centimeter"): (0, 2.54, 1, 0), ("centimeter", "inch"): (0, 1, 2.54, 0),
    ("celsius", "fahrenheit"): (0, 9, 5, 32), ("fahrenheit", "celsius"): (-32, 5, 9, 0), ("celsius", "kelvin"): (0, 1, 1, 273.15), ("kelvin", "celsius"): (0, 1, 1, -273.15),
    ("kilogram", "pound"): (0, 2.20462, 1, 0), ("pound", "kilogram"): (0, 0.453592, 1, 0), ("gram", "ounce"): (0, 0.035274, 1, 0), ("ounce", "gram"): (0, 28.3495, 1, 0),
    ("liter", "gallon"): (0, 0.264172, 1, 0), ("gallon", "liter"): (0, 3.78541, 1, 0), ("milliliter", "fluid-ounce"): (0, 0.033814, 1, 0), ("fluid-ounce", "milliliter"): (0, 29.5735, 1, 0),
}
_UNITS = {u for pair in CONVERSIONS for u in pair}
DURATION_FIELDS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")


def _plain(value: Column) -> Column:
    """A number as text that keeps whole values whole."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def format_number(value: Column, locale: str = "en_US") -> Column:
    return jvm.text("format_number", locale, "decimal", value)


def format_currency(value: Column, locale: str = "en_US", currency: str = "") -> Column:
    return jvm.text("format_number", locale, f"currency:{currency}", value)


def format_percent(value: Column, locale: str = "en_US") -> Column:
    return jvm.text("format_number", locale, "percent", value)


def format_scientific(value: Column, locale: str = "en_US") -> Column:
    return jvm.text("format_number", locale, "scientific", value)


def format_spellout(value: Column, locale: str = "en_US") -> Column:
    return jvm.text("format_number", locale, "spellout", value)


def format_ordinal(value: Column, locale: str = "en_US") -> Column:
    return jvm.text("format_number", locale, "ordinal", value)


def format_compact(value: Column, locale: str = "en_US", style: str = "SHORT") -> Column:
    return jvm.text("format_compact", locale, style, value)


def parse_number(text: Column, locale: str = "en_US", lenient: bool = True) -> Column:
    """The number that a text starts with, or null."""
    return jvm.text("parse_number", locale, "decimal", str(lenient).lower(), F.trim(text)).cast("double")


def parse_percent(text: Column, locale: str = "en_US", lenient: bool = True) -> Column:
    return jvm.text("parse_number", locale, "percent", str(lenient).lower(), F.trim(text)).cast("double")


def parse_currency(text: Column, locale: str = "en_US", lenient: bool = True) -> Column:
    found = jvm.array("parse_currency", locale, str(lenient).lower(), F.trim(text))
    return F.when(found.isNotNull(), F.struct(found[0].cast("double").alias("value"), found[1].alias("currency")))


def plural_category(value: Column, locale: str = "en_US") -> Column:
    return jvm.text("plural", locale, "CARDINAL", value)


def ordinal_category(value: Column, locale: str = "en_US") -> Column:
    return jvm.text("plural", locale, "ORDINAL", value)


def resolve_unit(unit: Column) -> Column:
    """Identifier of a unit by its identifier or its English abbreviation; null for an unknown one."""
    return jvm.text("resolve_unit", unit)


def unit_info(unit: Column) -> Column:
    """`(identifier, type, complexity)` of a unit or an abbreviation; null for an unknown one."""
    found = jvm.array("unit_info", unit)
    return F.when(found.isNotNull(), F.struct(*[found[k].alias(n) for k, n in enumerate(("identifier", "type", "complexity"))]))


def unit_abbreviation(unit: Column, locale: str = "en_US") -> Column:
    return jvm.text("unit_abbreviation", unit, locale)


def can_convert(from_unit: Column, to_unit: Column) -> Column:
    """Whether two units or abbreviations are of one type; null if either is unknown."""
    return unit_info(from_unit)["type"] == unit_info(to_unit)["type"]


@lru_cache(maxsize=1024)
def _unit(name: str) -> str:
    if name in _UNITS:
        return name
    found = SparkSession.active().range(1).select(resolve_unit(F.lit(name))).first()[0]
    if found is None:
        raise ValueError(f"unknown unit {name!r}")
    return found


def convert_units(value: Column, from_unit: str, to_unit: str) -> Column:
    """Conversion between the supported pairs of units or abbreviations (other pairs are an error when the plan is built)."""
    value = value.cast("double")
    pair = (_unit(from_unit), _unit(to_unit))
    if pair[0] == pair[1]:
        return value
    if pair not in CONVERSIONS:
        raise ValueError(f"no conversion from {from_unit} to {to_unit}")
    before, factor, divisor, after = CONVERSIONS[pair]
    value = value + before if before else value
    value = value * factor if factor != 1 else value
    value = value / divisor if divisor != 1 else value
    return value + after if after else value


def format_measure(value: Column, unit: str, locale: str = "en_US", width: str = "WIDE") -> Column:
    return jvm.text("format_measure", locale, width, unit, value)


def convert_and_format(value: Column, from_unit: str, to_unit: str, locale: str = "en_US", width: str = "WIDE") -> Column:
    return format_measure(convert_units(value, from_unit, to_unit), to_unit, locale, width)


def format_for_usage(value: Column, unit: str, locale: str = "en_US", usage: str = "default", width: str = "WIDE") -> Column:
    """A measure in its own unit: no unit is preferred for any usage."""
    return format_measure(value, unit, locale, width)


def format_measure_range(low: Column, high: Column, unit: str, locale: str = "en_US", width: str = "WIDE") -> Column:
    """The formatted upper value with the range in the place of its number."""
    shown = format_number(high, locale)
    return F.replace(format_measure(high, unit, locale, width), shown, F.concat(_plain(low), F.lit("–"), _plain(high)))


def format_measures(parts: list[tuple[Column, str]], locale: str = "en_US", width: str = "WIDE") -> Column:
    """Several measures side by side, joined by spaces."""
    return jvm.text("format_measures", locale, width, *[x for value, unit in parts for x in (unit, value)])


def parse_iso_duration(text: Column) -> Column:
    """Fields of an ISO 8601 duration; null unless it starts with P."""
    iso = F.upper(F.trim(text))
    date, time = F.split_part(iso, F.lit("T"), F.lit(1)), F.split_part(iso, F.lit("T"), F.lit(2))
    part = lambda side, letter: F.coalesce(F.nullif(F.regexp_extract(side, rf"([0-9]+(?:\.[0-9]+)?){letter}", 1), F.lit("")).cast("double"), F.lit(0.0))
    values = [part(date, c) for c in "YMWD"] + [part(time, c) for c in "HMS"]
    return F.when(iso.startswith("P"), F.struct(*[v.alias(n) for v, n in zip(values, DURATION_FIELDS, strict=True)]))


def duration_parts(seconds: Column) -> Column:
    """Seconds as years of 365 days, months of 30, weeks, days, hours, minutes and seconds."""
    seconds = seconds.cast("double")
    whole = F.floor(seconds)  # remainders are of whole seconds: one short expression a field, however many come before
    sizes = list(SECONDS.values())
    out = []
    for k, (unit, size) in enumerate(SECONDS.items()):
        rest = reduce(lambda r, larger: F.pmod(r, F.lit(larger)), sizes[:k], whole)
        out.append((F.floor(rest / size) if size > 1 else rest + (seconds - whole)).cast("double").alias(f"{unit.lower()}s"))
    return F.struct(*out)


def format_duration_parts(parts: Column, locale: str = "en_US", width: str = "WIDE") -> Column:
    """The parts that are not zero, joined by spaces; 0 seconds if all are."""
    return F.transform(F.array(parts), lambda p: _shown_parts(p, locale, width))[0]


def _shown_parts(parts: Column, locale: str, width: str) -> Column:
    shown = [F.when(parts[f] != 0, format_measure(_plain(parts[f]), f[:-1], locale, width)) for f in DURATION_FIELDS]
    none = F.coalesce(*[F.when(parts[f] != 0, F.lit(True)) for f in DURATION_FIELDS]).isNull()
    return F.when(none & parts.isNotNull(), format_measure(F.lit("0"), "second", locale, width)).when(parts.isNotNull(), F.concat_ws(" ", *shown))


def format_duration(seconds: Column, locale: str = "en_US", width: str = "WIDE") -> Column:
    return format_duration_parts(duration_parts(seconds), locale, width)


def format_iso_duration(text: Column, locale: str = "en_US", width: str = "WIDE") -> Column:
    return format_duration_parts(parse_iso_duration(text), locale, width)


def format_list(items: Column, locale: str = "en_US", style: str = "and") -> Column:
    """The items of an array in the locale's list pattern: none give an empty text, one stands alone."""
    if style not in ("and", "or", "unit"):
        raise ValueError(f"unknown list style {style!r}")
    jvm.register()
    args = F.concat(F.array(F.lit(locale), F.lit(style)), items)
    return F.when(F.size(items) == 0, F.lit("")).when(F.size(items) == 1, items[0]).otherwise(F.call_function("glyphmill_text", F.lit("format_list"), args))


def format_message(pattern: str, args: dict[str, Column], locale: str = "en_US", types: dict[str, str] | None = None) -> Column:
    """A message pattern with named arguments; `types` names those that are numbers (`number`) or instants (`date`)."""
    kinds = types or {}
    values = [v for name, c in args.items() for v in (name, kinds.get(name, "text"), F.coalesce(_plain(c), F.lit("")))]
    return jvm.text("format_message", locale, pattern, *values)


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _zone() -> Column:
    return F.current_timezone()


def format_datetime(ts: Column, locale: str = "en_US", calendar: str = "", style: str | None = None, date_style: str = "MEDIUM", time_style: str = "MEDIUM", pattern: str = "") -> Column:
    """A named or literal pattern, else one style for both parts, else a style for each; in the session's zone."""
    pattern = PATTERNS.get(pattern, pattern)
    date, time = (style, style) if style else (date_style, time_style)
    if not pattern and not {date, time} <= set(STYLES):
        raise ValueError(f"styles are {', '.join(STYLES)}")
    return jvm.text("format_date", locale, calendar, date, time, pattern, _zone(), _millis(ts))


def parse_datetime(text: Column, locale: str = "en_US", calendar: str = "", pattern: str = "") -> Column:
    """With a pattern by that; else by the styles from short to full, date and time before date alone; null if none fits."""
    return F.timestamp_millis(jvm.text("parse_date", locale, calendar, PATTERNS.get(pattern, pattern), _zone(), text).cast("long"))


def format_interval(start: Column, end: Column, locale: str = "en_US", skeleton: str = "yMMMd") -> Column:
    return jvm.text("format_interval", locale, skeleton, _zone(), _millis(start), _millis(end))


def relative_unit(seconds: Column) -> Column:
    """`(unit, value)` of a time difference: the largest unit that it reaches."""
    s = seconds.cast("double")
    out = F.struct(F.lit("SECOND").alias("unit"), s.alias("value"))
    for unit, size in reversed(SECONDS.items()):
        out = F.when(F.abs(s) >= size, F.struct(F.lit(unit).alias("unit"), (s / size).alias("value"))).otherwise(out)
    return out


def format_relative(seconds: Column, locale: str = "en_US") -> Column:
    unit = relative_unit(seconds)
    return jvm.text("format_relative", locale, unit["unit"], unit["value"])
