"""Masking of personal data in text, nested columns and maps, without leaving the JVM."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.textnorm import once

TOKEN = "[REDACTED]"
MAX_DEPTH = 20
#: What is masked in text, in this order, and parts of names that mark a field as personal.
PATTERNS = {
    "email": r"(?U)\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"(?U)\b\d{3}-\d{2}-\d{4}\b",
    "iban": r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "keyed": r"(?iU)\b(?:account|acct|loan|card|policy|customer|member)\s*(?:no\.?|number|num|id|#)?\s*[:#]?\s*[A-Z]{0,4}-?\d[\d -]{4,}\d",
    "phone": r"(?U)(?<![\w.])\+\d[\d ().-]{7,}\d(?![\w.])",
}
KEY_HINTS = [
    "borrower", "obligor", "ssn", "social_security", "national_id", "passport", "account_number", "acct_number", "loan_number", "loan_id",
    "email", "phone", "address", "postcode", "zip_code", "date_of_birth", "dob",
]
GROUPED = r"(?U)\b\d{2,6}(?:[ -]\d{2,6}){2,}\b"
#: The same as SQL on RE2 reads it: letters, digits and white space are ASCII (a long s and a Kelvin sign are still s and k in other case), and a
#: phone number takes the signs beside it, so that of two with a single sign between them the second stays.
ASCII_PATTERNS = {
    "email": r"(?:(?<!\w)(?=\w)|(?<=\w)(?=[.%+-]))[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}(?!\w)",
    "ssn": r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)",
    "keyed": r"(?i)(?<!\w)(?:account|acct|loan|card|policy|cu[sſ]tomer|member)[\t\n\f\r ]*(?:no\.?|number|num|id|#)?[\t\n\f\r ]*[:#]?[\t\n\f\r ]*[A-ZſK]{0,4}-?\d[\d -]{4,}\d",
    "phone": r"(^|[^\p{L}\p{N}_.])\+\d[\d ().-]{7,}\d(\z|[^\p{L}\p{N}_.])",
}
ASCII_GROUPED = r"(?<!\w)\d{2,6}(?:[ -]\d{2,6}){2,}(?!\w)"
DATE_LIKE = r"^(19|20)\d{2}[ -]\d{1,2}[ -]\d{1,2}$"
MIN_DIGITS = 10


def is_identifier(c: Column) -> Column:
    """Whether a grouped run of digits is long enough for an account number and no date."""
    return (F.length(F.regexp_replace(c, r"(?U)\D", "")) >= MIN_DIGITS) & ~c.rlike(DATE_LIKE)


def mask_text(c: Column, token: str = TOKEN, *, ascii_only: bool = False) -> Column:
    """Text with e-mail addresses, social security numbers, IBANs, keyed identifiers, phone numbers and grouped account numbers replaced.

    ascii_only: by ASCII_PATTERNS, which find less beside letters with accents; for tables that SQL masks too.
    """
    quoted = token.replace("\\", "\\\\").replace("$", "\\$")
    out = c
    for name, pattern in (ASCII_PATTERNS if ascii_only else PATTERNS).items():
        out = F.regexp_replace(out, pattern, f"$1{quoted}$2" if ascii_only and name == "phone" else quoted)
    runs_of_digits = ASCII_GROUPED if ascii_only else GROUPED

    def grouped(text: Column) -> Column:
        """Each grouped run is judged by itself: the gaps and the runs are put together again, in one pass."""
        runs = F.transform(F.regexp_extract_all(text, F.lit(runs_of_digits), F.lit(0)), lambda r: F.when(is_identifier(r), F.lit(token)).otherwise(r))
        return F.array_join(F.zip_with(F.split(text, runs_of_digits), runs, lambda gap, r: F.concat(gap, F.coalesce(r, F.lit("")))), "")

    masked = F.get(F.transform(F.array(out), grouped), F.lit(0))  # the patterns before are worked out once
    return F.when(c.rlike(r"(?U)[@\d]"), masked).otherwise(c)  # each pattern takes one of these signs


def contains_pii(c: Column) -> Column:
    """Whether any pattern still matches."""
    hit = F.lit(False)
    for pattern in PATTERNS.values():
        hit = hit | c.rlike(pattern)
    grouped = F.exists(F.regexp_extract_all(c, F.lit(GROUPED), F.lit(0)), is_identifier)
    return F.coalesce(hit | grouped, F.lit(False))


def is_sensitive_name(name: str, *, names: frozenset[str] = frozenset(), prefix: str = "") -> bool:
    """Whether a field of this name holds personal data."""
    plain = re.sub(r"[^a-z0-9]+", "_", name.removeprefix(prefix).lower())
    return plain in names or any(h in plain for h in KEY_HINTS)


def sensitive_key(c: Column, *, names: frozenset[str] = frozenset(), prefix: str = "") -> Column:
    """The same for a column of names, such as a map's keys."""
    bare = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c) if prefix else c
    low = F.lower(bare)
    hit = low.rlike("|".join(h.replace("_", "[^a-z0-9]+") for h in KEY_HINTS))
    return hit | F.regexp_replace(low, "[^a-z0-9]+", "_").isin(sorted(names)) if names else hit


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType))


def _masked(c: Column, kind: T.DataType, token: str, names: frozenset[str], depth: int) -> Column:
    """A value of any type: text by its patterns, structs and maps by their names, arrays by item, bytes and what lies too deep whole."""
    if depth > MAX_DEPTH:
        return F.lit(token)
    if isinstance(kind, T.StringType):
        return mask_text(c, token)
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.lit(token))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _masked(x, kind.elementType, token, names, depth + 1))
    if isinstance(kind, T.MapType):

        def value(k: Column, v: Column) -> Column:
            inner = _masked(v, kind.valueType, token, names, depth + 1)
            if not isinstance(kind.keyType, T.StringType):
                return inner
            hit = sensitive_key(k, names=names)
            return F.when(hit, F.lit(token)).otherwise(inner) if _is_text(kind.valueType) or depth + 1 > MAX_DEPTH else F.when(~hit, inner)

        return F.transform_values(c, value)
    if isinstance(kind, T.StructType):
        fields = [(F.lit(token) if is_sensitive_name(f.name, names=names) else _masked(c[f.name], f.dataType, token, names, depth + 1)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def mask_columns(df: DataFrame, *, token: str = TOKEN, names: frozenset[str] = frozenset()) -> DataFrame:
    """Every column masked by its name and, however deeply nested, its content. The schema decides the plan, so nothing is inspected row by row.

    A field with a sensitive name holds the token, whatever its value, null too. A map's value under a
    sensitive key becomes the token if the map's values are text or bytes, and null otherwise, since one
    type holds for all values of a map.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.lit(token) if is_sensitive_name(f.name, names=names) else _masked(c, f.dataType, token, names, 1)).alias(f.name))
    return df.select(*out)


def holds_pii(c: Column, kind: T.DataType, *, token: str = TOKEN, names: frozenset[str] = frozenset()) -> Column:
    """Whether a value of any type still holds personal data: text that a pattern matches, or a sensitive name or key whose value is neither the token nor null."""
    out = F.lit(False)
    if isinstance(kind, T.StringType):
        out = contains_pii(c)
    elif isinstance(kind, T.ArrayType):
        out = F.exists(c, lambda x: holds_pii(x, kind.elementType, token=token, names=names))
    elif isinstance(kind, T.MapType):
        inner = F.exists(F.map_values(c), lambda v: holds_pii(v, kind.valueType, token=token, names=names))
        named = F.lit(False)
        if isinstance(kind.keyType, T.StringType):
            named = F.exists(F.map_entries(c), lambda e: sensitive_key(e["key"], names=names) & _unmasked(e["value"], kind.valueType, token))
        out = inner | named
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            out = out | (_unmasked(c[f.name], f.dataType, token) if is_sensitive_name(f.name, names=names) else holds_pii(c[f.name], f.dataType, token=token, names=names))
    return F.coalesce(out, F.lit(False))


def _unmasked(c: Column, kind: T.DataType, token: str) -> Column:
    return F.coalesce(c != token, F.lit(False)) if isinstance(kind, T.StringType) else c.isNotNull()


def mask_attributes(c: Column, *, token: str = TOKEN, prefix: str = "") -> Column:
    """A map of attributes without its sensitive keys, its texts masked."""
    return F.transform_values(F.map_filter(c, lambda k, v: ~sensitive_key(k, prefix=prefix)), lambda k, v: mask_text(v, token))


def drop_keys(c: Column, keys: list[str]) -> Column:
    """A map without the given keys."""
    return F.map_filter(c, lambda k, v: ~k.isin(keys))


def _json_text(c: Column) -> Column:
    """A text as a JSON string."""
    return once(F.to_json(F.array(c)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def _masked_json(v: Column, token: str, names: frozenset[str], prefix: str, depth: int) -> Column:
    """The JSON text of a VARIANT, masked. Objects and lists are both lists of (key, value), so a level is one lambda whatever lies below, and the plan grows with the depth alone."""
    quoted = F.lit(json.dumps(token, ensure_ascii=False))
    if depth > MAX_DEPTH:
        return quoted
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))

    def one(kid: Column) -> Column:
        hit = F.coalesce(sensitive_key(kid["key"], names=names, prefix=prefix), F.lit(False))
        name = F.when(kid["key"].isNotNull(), F.concat(_json_text(kid["key"]), F.lit(":"))).otherwise(F.lit(""))
        return F.concat(name, F.when(hit, quoted).otherwise(_masked_json(kid["value"], token, names, prefix, depth + 1)))

    def whole(x: Column) -> Column:
        none = x["entries"].isNull() & x["items"].isNull()
        leaf = F.when(F.schema_of_variant(v) == "STRING", _json_text(mask_text(F.try_variant_get(v, "$", "string"), token))).otherwise(F.coalesce(F.to_json(v), F.lit("null")))
        body = F.when(none, leaf).otherwise(F.array_join(F.transform(F.coalesce(x["entries"], x["items"]), one), ","))
        around = lambda both: F.when(none, F.lit("")).when(x["entries"].isNotNull(), F.lit(both[0])).otherwise(F.lit(both[1]))
        return F.concat(around("{["), body, around("}]"))

    return once(F.struct(entries.alias("entries"), items.alias("items")), whole)


def mask_json(c: Column, *, token: str = TOKEN, names: frozenset[str] = frozenset(), prefix: str = "") -> Column:
    """JSON text of any shape, masked as mask_columns() masks columns: values under sensitive keys become the token, whatever they
    are, texts are masked by pattern, and what lies deeper than MAX_DEPTH levels becomes the token whole.

    Keys are judged at each level of each row; no schema is needed. Objects come back with their keys in order of name and no
    white space. Text that is no JSON, or repeats a key in an object, is masked as text; null stays null.
    """
    parsed = F.try_parse_json(c)
    return F.when(parsed.isNull(), mask_text(c, token)).otherwise(once(parsed, lambda v: _masked_json(v, token, names, prefix, 0)))


def mask_variant(c: Column, *, token: str = TOKEN, names: frozenset[str] = frozenset(), prefix: str = "") -> Column:
    """A VARIANT, masked as mask_json() masks text."""
    return F.when(c.isNotNull(), F.try_parse_json(once(c, lambda v: _masked_json(v, token, names, prefix, 0))))


def mask_json_attributes(c: Column, *, token: str = TOKEN, prefix: str = "") -> Column:
    """A map of attributes without its sensitive keys, its values masked as JSON where they are JSON, as text where not."""
    kept = F.map_filter(c, lambda k, v: ~sensitive_key(k, prefix=prefix))
    return F.transform_values(kept, lambda k, v: F.when(v.rlike(r"^\s*[\[{]"), mask_json(v, token=token, prefix=prefix)).otherwise(mask_text(v, token)))
