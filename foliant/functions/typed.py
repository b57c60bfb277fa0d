"""Printed text to typed values, as column expressions that stay in the JVM.

A value that is not recognised is null, never a guess. Rates stay in percent. Amounts are
DECIMAL(31,4), rates DECIMAL(20,6); numbers too large or with too many places for them are null, never
rounded. White space is Unicode's, so that no-break spaces count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.textnorm import WS, once

#: Unit words, what a percentage is, index names of floating rates, and how dates are printed.
UNITS = {"thousand": 1_000, "million": 1_000_000, "mm": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000}
MONEY = r"(?iU)(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(thousand|million|billion|mm|bn)?\b"
PERCENT = r"(?iU)(-?\d+(?:\.\d+)?)\s*(?:%|percent\b|per\s*cent\b)"
FLOATING = r"(?i)\b(SOFR|LIBOR|EURIBOR|SONIA|ESTR|BBSW|CDOR|prime rate|treasury|index|benchmark|floating rate)\b"
SPREAD = r"(?iU)\s*(?:\+|\bplus\b)\s*"
MONTH_DATE = r"(?U)\b([A-Z][a-z]{2,8})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
SLASH_DATE = r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
ISO_DATE = r"(?U)\b(\d{4}-\d{2}-\d{2})\b"
YEARS = r"(\d+(?:\.\d+)?)"
FREQUENCIES = [
    ("semi_annual", r"(?i)\bsemi-?annual|twice a year|every six months\b"),
    ("quarterly", r"(?i)\bquarter"),
    ("annual", r"(?i)\bannual(ly)?\b|once a year"),
    ("monthly", r"(?i)\bmonth"),
]
CLASS = r"(?iU)\bclass\s+([A-Z0-9][A-Z0-9\-]*(?:\([^)\s]*\))?)"
FOOTNOTE = r"\(\d+\)|\(\d+$"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def to_decimal(c: Column, kind: str = "decimal(20,6)") -> Column:
    """A number printed with or without thousands separators; null if it is none or has more places than the type."""
    places = int(kind.rstrip(")").split(",")[1])
    return once(F.regexp_replace(c, ",", ""), lambda plain: F.when(F.length(F.regexp_extract(plain, r"\.(\d*?)0*$", 1)) <= places, plain.try_cast(kind)))


def parse_money(c: Column) -> Column:
    """The first amount with thousands separators or a unit word, times its unit."""
    numbers = F.regexp_extract_all(c, F.lit(MONEY), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(MONEY), F.lit(2))
    pairs = F.arrays_zip(numbers.alias("number"), units.alias("unit"))
    first = F.get(F.filter(pairs, lambda p: F.contains(p["number"], F.lit(",")) | (p["unit"] != "")), F.lit(0))

    def scaled(p: Column) -> Column:
        scale = F.lit(1)
        for word, by in UNITS.items():
            scale = F.when(F.lower(p["unit"]) == word, F.lit(by)).otherwise(scale)
        exact = to_decimal(p["number"], "decimal(27,10)") * scale.cast("decimal(10,0)")
        return once(exact, lambda x: once(x.try_cast("decimal(31,4)"), lambda amount: F.when(amount == x, amount)))

    return once(first, scaled)


def parse_percent(c: Column) -> Column:
    """The first percentage, in percent."""
    return to_decimal(found(c, PERCENT))


def parse_percents(c: Column) -> Column:
    """All percentages in order; null text has none."""
    every = F.transform(F.regexp_extract_all(c, F.lit(PERCENT), F.lit(1)), lambda x: to_decimal(x))
    return F.coalesce(F.filter(every, lambda x: x.isNotNull()), F.array().cast("array<decimal(20,6)>"))


def percent_texts(c: Column) -> Column:
    """The percentages' numbers as printed."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(PERCENT), F.lit(1)), F.array().cast("array<string>"))


def parse_coupon(c: Column) -> Column:
    """struct(kind, fixed_rate_pct, index_name, margin_pct): floating if an index is named, else fixed if a percentage is, else null."""
    parts = F.split(c, SPREAD, 2)
    none = F.lit(None).cast("decimal(20,6)")
    floating = F.struct(
        F.lit("floating").alias("kind"),
        none.alias("fixed_rate_pct"),
        F.nullif(F.btrim(parts[0], F.lit(" ,;")), F.lit("")).alias("index_name"),
        F.when(F.size(parts) == 2, parse_percent(F.get(parts, F.lit(1)))).alias("margin_pct"),
    )
    fixed = lambda p: F.when(p.isNotNull(), F.struct(F.lit("fixed").alias("kind"), p.alias("fixed_rate_pct"), F.lit(None).cast("string").alias("index_name"), none.alias("margin_pct")))
    return F.when(c.rlike(FLOATING), floating).otherwise(once(parse_percent(c), fixed))


def parse_date(c: Column) -> Column:
    """The first printed date: a month's name (or its first three letters) with day and year, else M/D/YYYY, else ISO.

    An impossible date with a month's name leaves the numeric forms to be tried; an impossible M/D/YYYY is null.
    """
    month, day, year = (F.regexp_extract(c, MONTH_DATE, g) for g in (1, 2, 3))
    full = F.try_to_date(F.concat_ws(" ", month, day, year), "MMMM d yyyy")
    short = F.try_to_date(F.concat_ws(" ", F.substring(month, 1, 3), day, year), "MMM d yyyy")
    named = F.when(c.rlike(MONTH_DATE), F.coalesce(full, short))
    slash = F.try_to_date(F.concat_ws("/", *[F.regexp_extract(c, SLASH_DATE, g) for g in (1, 2, 3)]), "M/d/yyyy")
    iso = F.try_to_date(found(c, ISO_DATE), "yyyy-MM-dd")
    return F.coalesce(named, F.when(c.rlike(SLASH_DATE), slash).otherwise(iso))


def parse_years(c: Column) -> Column:
    """The first number."""
    return to_decimal(found(c, YEARS))


def parse_frequency(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FREQUENCIES):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def clean_class_name(c: Column) -> Column:
    """A class name without footnote markers."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, FOOTNOTE, ""), WS, " "))


def class_key(c: Column) -> Column:
    """A comparable key: what follows "class", else the first word, in upper case; empty for an empty name."""
    return once(clean_class_name(c), lambda plain: F.upper(F.coalesce(found(plain, CLASS), F.split(plain, " ")[0])))
