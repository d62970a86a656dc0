"""Reference data as small DataFrames of fixed size, made by the JVM library and fit to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill import jvm

#: Two-letter general categories.
CATEGORIES = {
    "Lu": "Uppercase Letter", "Ll": "Lowercase Letter", "Lt": "Titlecase Letter", "Lm": "Modifier Letter", "Lo": "Other Letter", "Mn": "Nonspacing Mark", "Mc": "Spacing Mark", "Me": "Enclosing Mark",
    "Nd": "Decimal Number", "Nl": "Letter Number", "No": "Other Number", "Pc": "Connector Punctuation", "Pd": "Dash Punctuation", "Ps": "Open Punctuation", "Pe": "Close Punctuation",
    "Pi": "Initial Punctuation", "Pf": "Final Punctuation", "Po": "Other Punctuation", "Sm": "Math Symbol", "Sc": "Currency Symbol", "Sk": "Modifier Symbol", "So": "Other Symbol",
    "Zs": "Space Separator", "Zl": "Line Separator", "Zp": "Paragraph Separator", "Cc": "Control", "Cf": "Format", "Cs": "Surrogate", "Co": "Private Use", "Cn": "Unassigned",
}
REGION_TYPES = ("territory", "world", "continent", "subcontinent", "grouping")
EXEMPLAR_TYPES = {"standard": 0, "auxiliary": 1, "index": 2, "punctuation": 4}


def _records(spark: SparkSession, name: str, args: tuple, fields: str) -> DataFrame:
    """Catalogue records as a table; `fields` is a list of names with types."""
    jvm.register(spark)
    columns = [f.split() for f in fields.split(",")]
    rows = spark.range(1).select(F.explode(jvm.array(name, *args)).alias("r")).select(F.split("r", "\u001f").alias("r"))
    return rows.select(*[F.nullif(F.get("r", F.lit(k)), F.lit("")).cast(kind).alias(n) for k, (n, kind) in enumerate(columns)])


def locales(spark: SparkSession) -> DataFrame:
    return _records(spark, "locales", (), "id string,display_name string,language string,script string,region string,variant string,is_rtl boolean").orderBy("id")


def languages(spark: SparkSession) -> DataFrame:
    return _records(spark, "languages", (), "code string,name string").orderBy("code")


def regions(spark: SparkSession, region_type: str | None = "territory") -> DataFrame:
    if region_type is not None and region_type not in REGION_TYPES:
        raise ValueError(f"unknown region type {region_type!r}")
    out = _records(spark, "regions", (), "code string,numeric_code int,name string,type string,containing_region string,contained string")
    out = out.withColumn("contained_regions", F.when(F.col("contained").isNotNull(), F.split("contained", ",")).otherwise(F.array().cast("array<string>"))).drop("contained")
    return (out.filter(F.col("type") == region_type) if region_type else out).orderBy("code")


def region_edges(spark: SparkSession) -> DataFrame:
    """Direct containment as `(parent, child)`."""
    return regions(spark, None).select(F.col("code").alias("parent"), F.explode("contained_regions").alias("child"))


def region_closure(spark: SparkSession) -> DataFrame:
    """All containment, direct or not, as `(ancestor, code)`; the hierarchy is five levels deep."""
    edges = region_edges(spark)
    out = level = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("code"))
    for _ in range(4):
        level = level.join(F.broadcast(edges), F.col("code") == F.col("parent")).select("ancestor", F.col("child").alias("code"))
        out = out.unionByName(level)
    return out.distinct()


def scripts(spark: SparkSession) -> DataFrame:
    return _records(spark, "scripts", (), "code string,name string,is_rtl boolean,is_cased boolean,usage string,sample_char string").orderBy("name")


def timezones(spark: SparkSession, country: str | None = None) -> DataFrame:
    fields = "id string,display_name string,offset_hours double,offset_formatted string,uses_dst boolean,dst_savings_hours double,region string,canonical_id string,windows_id string"
    out = _records(spark, "timezones", (), fields)
    return (out.filter(F.col("region") == country.upper()) if country else out).orderBy("id")


def equivalent_timezones(spark: SparkSession, zone: str) -> DataFrame:
    return _records(spark, "equivalent_timezones", (zone,), "id string")


def calendars(spark: SparkSession) -> DataFrame:
    return _records(spark, "calendars", (), "type string,icu_type string,description string").orderBy("type")


def collation_types(spark: SparkSession) -> DataFrame:
    return _records(spark, "collation_types", (), "type string").orderBy("type")


def collator_info(spark: SparkSession, locale: str) -> DataFrame:
    return _records(spark, "collator_info", (locale,), "locale string,actual_locale string,strength int,has_tailoring boolean,rules_length int")


def transliterators(spark: SparkSession) -> DataFrame:
    return _records(spark, "transliterators", (), "id string,source string,target string,variant string,display_name string").orderBy("id")


def units(spark: SparkSession, unit_type: str | None = None) -> DataFrame:
    out = _records(spark, "units", (), "identifier string,type string,subtype string,abbreviation string")
    return (out.filter(F.col("type") == unit_type) if unit_type else out).orderBy("type", "identifier")


def currencies(spark: SparkSession) -> DataFrame:
    return _records(spark, "currencies", (), "code string,name string,symbol string").orderBy("code")


def blocks(spark: SparkSession) -> DataFrame:
    return _records(spark, "blocks", (), "name string,start int,end int").orderBy("start")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "code string, description string")


def properties(spark: SparkSession) -> DataFrame:
    return _records(spark, "properties", (), "name string").orderBy("name")


def characters(spark: SparkSession, unicode_set: str, limit: int = 0x110000) -> DataFrame:
    """Characters of a set pattern such as `[:block=Arrows:]` or `[:Lu:]`."""
    return _records(spark, "characters", (unicode_set, limit), "char string")


def bidi_controls(spark: SparkSession) -> DataFrame:
    return _records(spark, "bidi_controls", (), "char string,codepoint string,name string").orderBy("codepoint")


def number_symbols(spark: SparkSession, locale: str = "en_US") -> DataFrame:
    names = "decimal grouping percent permille plus minus exponential infinity nan currency currency_code zero_digit".split()
    return _records(spark, "number_symbols", (locale,), ",".join(f"{n} string" for n in names)).withColumn("locale", F.lit(locale))


def exemplars(spark: SparkSession, locale: str = "en_US", exemplar_type: str = "standard") -> DataFrame:
    return _records(spark, "exemplars", (locale, EXEMPLAR_TYPES[exemplar_type]), "char string")


def date_symbols(spark: SparkSession, locale: str = "en_US", calendar: str = "") -> DataFrame:
    """`(kind, ordinal, name)`: months, weekdays (Sunday first), eras, am_pm, and the locale's first day of the week."""
    return _records(spark, "date_symbols", (locale, calendar), "kind string,ordinal int,name string")


def plural_info(spark: SparkSession, locale: str = "en_US", ordinal: bool = False) -> DataFrame:
    return _records(spark, "plural_info", (locale, "ORDINAL" if ordinal else "CARDINAL"), "category string,examples string,rule string")


def index_labels(spark: SparkSession, locale: str = "en_US") -> DataFrame:
    jvm.register(spark)
    return spark.range(1).select(F.posexplode(jvm.array("index_labels", locale)).alias("ordinal", "label"))


def exemplar_info(spark: SparkSession, locale: str = "en_US") -> DataFrame:
    """`(type, pattern)`: the set pattern of each kind of exemplar characters."""
    names = F.create_map(*[x for name, k in EXEMPLAR_TYPES.items() for x in (F.lit(k), F.lit(name))])
    found = _records(spark, "exemplar_info", (locale,), "k int,pattern string")
    return found.select(names[F.col("k")].alias("type"), F.coalesce("pattern", F.lit("")).alias("pattern"))


def transliterator_set(spark: SparkSession, transliterator: str, side: str = "source") -> DataFrame:
    """Characters (and strings) that a transliterator can convert, or with `target` those that it can make."""
    if side not in ("source", "target"):
        raise ValueError(f"unknown side {side!r}")
    return _records(spark, "transliterator_set", (transliterator, side), "char string")


def named(table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of a reference table whose key is a value, whatever its case: none for an unknown one."""
    return table.filter(F.lower(key) == value.lower())


def calendar_info(spark: SparkSession, calendar: str) -> DataFrame:
    return named(calendars(spark), "type", calendar)


def is_valid_calendar(spark: SparkSession, calendar: str) -> bool:
    return not calendar_info(spark, calendar).isEmpty()


def region_info(spark: SparkSession, code: str) -> DataFrame:
    return named(regions(spark, None), "code", code)


def region_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in REGION_TYPES], "type string")


def exemplar_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in EXEMPLAR_TYPES], "type string")


def script_info(spark: SparkSession, script: str) -> DataFrame:
    """A script by its code or its name."""
    return scripts(spark).filter(F.lit(script.lower()).isin(F.lower("code"), F.lower("name")))


def transliterator_info(spark: SparkSession, transliterator: str) -> DataFrame:
    return named(transliterators(spark), "id", transliterator)
