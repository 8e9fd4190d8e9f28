"""Strict JSON tests on text columns, built on VARIANT.

``try_parse_json`` alone accepts junk after a complete value, so a text counts as JSON only when it parses inside an
array *and* as an object member.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(c: Column) -> Column:
    """True when the text is exactly one JSON value; NULL for NULL."""
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"k":'), c, F.lit("}")))
    return F.when(c.isNotNull(), in_array.isNotNull() & in_object.isNotNull())


def variant_root_type(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


def json_root_type(c: Column) -> Column:
    """Type of the JSON value in a text cell; NULL when the text is not JSON."""
    return F.when(is_json(c), variant_root_type(F.try_parse_json(c)))


def args_of(c: Column, path: str | None) -> Column:
    """The JSON text found at ``path`` (``None``: the whole cell)."""
    return c if path is None else F.get_json_object(c, path)


def json_keys(c: Column) -> Column:
    """Top-level keys of a JSON object text; NULL when it is not an object."""
    return F.json_object_keys(c)
