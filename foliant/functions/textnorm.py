"""Text normalisation and title rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space; both ends are stripped."""
    return F.btrim(F.regexp_replace(c, WS, " "))


def citation_key(c: Column) -> Column:
    """The form in which quotes and blocks are compared: typographic quotes, dashes and spaces folded, no space
    after a currency sign or before a percent sign, white space collapsed, lower case."""
    folded = F.translate(c, "’‘“”–— ", "''\"\"-- ")
    folded = F.regexp_replace(folded, r"(?U)([$€£])\s+", "$1")
    return F.lower(collapse(F.regexp_replace(folded, r"(?U)\s+%", "%")))


#: Section names by title, checked in this order.
SECTION_RULES: list[tuple[str, str]] = [
    ("post_acceleration_priority_of_payments", r"^(?=.*(post[- ]?acceleration|after (an )?(acceleration|event of default)))(?=.*(priority|payments|distributions))"),
    (
        "priority_of_payments",
        r"priority of (payments|distributions)|order of (priority|distributions)"
        r"|application of (available funds|collections|available collections)"
        r"|application of .*\b(amounts|funds|collections)$"
        r"|distributions? of available funds|payments? and distributions|^distributions?$",
    ),
    ("trigger_events", r"trigger|(early )?amortization events?|pay ?out events?|early redemption events?"),
    ("events_of_default", r"events? of default"),
    ("description_of_notes", r"description of the (offered )?(notes|certificates|securities)"),
    ("credit_enhancement", r"credit enhancement"),
]


def section_name(title: Column) -> Column:
    """The known section that a heading opens, or null."""
    plain = F.btrim(F.regexp_replace(title, WS, " "), F.lit(" .:—-"))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTION_RULES):
        out = F.when(plain.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


def heading_level(text: Column, level: Column) -> Column:
    """1 for a heading whose letters are all upper case, else at least 2, one below the given level (null: 1). Letters without case are not upper case."""
    shout = text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")
    return F.when(shout, F.lit(1)).otherwise(F.greatest(F.lit(2), F.coalesce(level, F.lit(1)) + 1)).cast("int")


#: What a printed page number looks like, and glyphs that mark list items without numbering them.
PAGE_LABEL = r"(?i)^(?:[A-Z]{1,3}-)?\d{1,4}$|^[ivxlcdm]{1,7}$"
BULLETS = ["", "-", "*", "o", "·", "•", "●", "○", "▪", "■", "–", "—"]


def is_page_label(c: Column) -> Column:
    return c.rlike(PAGE_LABEL)


def list_marker(c: Column) -> Column:
    """A list item's marker; null for bullets."""
    plain = F.btrim(c)
    return F.when(~plain.isin(BULLETS), plain)


def contains_either(a: Column, b: Column) -> Column:
    """Whether one name contains the other, ignoring case and spacing."""
    x, y = F.lower(collapse(a)), F.lower(collapse(b))
    return F.contains(x, y) | F.contains(y, x)


def probes_in_order(text: Column, probes: Column) -> Column:
    """Which of the probes do not occur in text after the one before them, as an array. A probe that is missing does not move the place."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("missing"))

    def step(state: Column, probe: Column) -> Column:
        hit = F.call_function("locate", probe, text, state["at"] + 1)
        return F.struct(
            F.when(hit > 0, hit).otherwise(state["at"]).cast("int").alias("at"),
            F.when(hit > 0, state["missing"]).otherwise(F.concat(state["missing"], F.array(probe))).alias("missing"),
        )

    return F.aggregate(probes, start, step, lambda s: s["missing"])


def fill(template: Column, **values: Column) -> Column:
    """A template with each ``{name}`` replaced; an error where a placeholder is left without a value."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    asked = F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_]\w*)\}"), F.lit(1))
    left = F.array_join(F.array_except(asked, F.array(*map(F.lit, values)).cast("array<string>")), ", ")
    return F.when(left == "", out).otherwise(F.raise_error(F.concat(F.lit("no value for "), left)).cast("string"))
