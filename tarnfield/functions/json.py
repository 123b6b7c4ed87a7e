"""Expressions on JSON values: presence, truth, canonical text, key lists.

A value is a VARIANT. Four states stay apart: absent key (SQL NULL from a
lookup), explicit null (a variant null), and on the line level blank and
malformed. All conversions are try_ forms, so no row can fail a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trim() strips in the line model: Unicode white space and the byte-order mark.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(f"^[{JS_SPACE}]*$")


def parsed(text: Column) -> Column:
    """VARIANT, or NULL for malformed text."""
    return F.try_parse_json(text)


def kind(v: Column) -> Column:
    """Top-level type name: OBJECT, ARRAY, STRING, BOOLEAN, VOID, or a numeric type; NULL stays NULL."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z_]+)", 1)


def is_record(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def as_map(v: Column) -> Column:
    """MAP<STRING, VARIANT> of an object's top level; NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def has_key(m: Column, key: str | Column) -> Column:
    """Presence, also of a key whose value is null."""
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def lookup(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def is_null_value(v: Column) -> Column:
    """True only for an explicit null."""
    return F.coalesce(F.is_variant_null(v), F.lit(False))


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


#: JSON texts of values that aren't truthy.
FALSY = r'^(null|false|""|-?0(\.0*)?([eE][-+]?[0-9]+)?)$'


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_truthy(v: Column) -> Column:
    """JavaScript truth of a value: absent, null, '', 0 and false are not."""
    return F.coalesce(~F.to_json(v).rlike(FALSY), F.lit(False))


def or_else(a: Column, b: Column) -> Column:
    """a || b: a if truthy, else b whatever it is."""
    return let(a, lambda x: F.when(is_truthy(x), x).otherwise(b))


def is_integer_value(v: Column) -> Column:
    """By value, so 1.0 and 1e3 are integers; false for other types."""
    number = ~kind(v).isin("STRING", "BOOLEAN", "VOID", "OBJECT", "ARRAY")
    return F.coalesce(number & let(F.try_variant_get(v, "$", "double"), lambda d: d == F.floor(d)), F.lit(False))


def keys_of(raw: Column) -> Column:
    """Sorted top-level keys of an object's text; NULL for anything else."""
    return F.array_sort(F.json_object_keys(raw))


def canonical(text: Column) -> Column:
    """Compact text with keys sorted at every depth; NULL for malformed text."""
    return F.to_json(F.try_parse_json(text))
