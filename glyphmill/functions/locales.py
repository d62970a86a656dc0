"""Locale identifiers, display names and time zones of columns of codes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glyphmill import jvm

KINDS = ("language", "script", "region", "currency", "symbol", "locale")


def display_name(code: Column, kind: str, display_locale: str = "en_US") -> Column:
    """Name of a code in a display locale; unknown currencies give their upper-cased code."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    found = jvm.text("display_name", kind, code, display_locale)
    return F.coalesce(found, F.upper(code)) if kind in ("currency", "symbol") else found


def canonicalize(locale: Column) -> Column:
    return jvm.text("locale", "canonicalize", locale)


def add_likely_subtags(locale: Column) -> Column:
    return jvm.text("locale", "maximize", locale)


def minimize_subtags(locale: Column) -> Column:
    return jvm.text("locale", "minimize", locale)


def is_valid_locale(locale: Column) -> Column:
    """Whether language and country of a locale are known codes."""
    return jvm.text("locale", "valid", locale).cast("boolean")


def parse_locale(locale: Column) -> Column:
    found = jvm.array("locale", "parse", locale)
    names = ("language", "script", "region", "variant", "base_name", "bcp47")
    return F.when(found.isNotNull(), F.struct(*[F.nullif(found[k], F.lit("")).alias(n) for k, n in enumerate(names)]))


def locale_info(locale: Column) -> Column:
    found = jvm.array("locale", "info", locale)
    names = ("id", "display_name", "language", "script", "region", "variant", "direction")
    return F.when(found.isNotNull(), F.struct(*[found[k].alias(n) for k, n in enumerate(names)]))


def locale_scripts(locale: Column) -> Column:
    """Names of the scripts that the locale's standard characters belong to."""
    return jvm.array("locale", "scripts", locale)


ATTRIBUTES = (
    "id language script region display_name display_language display_region likely_script likely_region rtl calendar first_day_of_week min_days_in_first_week currency"
    " measurement_system paper_height paper_width quote_start quote_end alt_quote_start alt_quote_end iso3_language iso3_country bcp47"
).split()
_TYPED = {"rtl": "boolean", "min_days_in_first_week": "int", "paper_height": "int", "paper_width": "int"}


def locale_attributes(locale: Column) -> Column:
    """Names, likely subtags, calendar, currency, measures, paper, quotes and codes of a locale."""
    found = jvm.array("locale", "attributes", locale)
    fields = [F.nullif(found[k], F.lit("")).cast(_TYPED.get(n, "string")).alias(n) for k, n in enumerate(ATTRIBUTES)]
    return F.when(found.isNotNull(), F.struct(*fields))


def locale_extended(locale: Column) -> Column:
    """`locale_attributes` with the scripts of the locale and the labels of its alphabetic index."""
    return locale_attributes(locale).withField("scripts", locale_scripts(locale)).withField("index_labels", jvm.array("index_labels", locale))


def default_locale(spark: SparkSession) -> str:
    """The locale of the driver's JVM."""
    return spark._jvm.java.util.Locale.getDefault().toString()


def timezone_info(zone: Column) -> Column:
    """Null for an unknown zone; `offset_hours` is the standard offset."""
    found = jvm.array("timezone", zone)
    return F.when(
        found.isNotNull(),
        F.struct(
            found[0].alias("id"), found[1].alias("display_name"), found[2].cast("double").alias("offset_hours"), found[3].alias("offset_formatted"), found[4].cast("boolean").alias("uses_dst"),
            found[5].cast("double").alias("dst_savings_hours"), found[6].alias("region"), found[7].alias("canonical_id"), found[8].alias("windows_id"),
        ),
    )


def timezone_offset(zone: Column) -> Column:
    return timezone_info(zone)["offset_hours"]
