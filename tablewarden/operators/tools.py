"""Checks on tool-call records: JSON text compared with other columns of the same row.

A cell that is not JSON is reported by :func:`valid_json` only; the other checks are silent about it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json import args_of, is_json, json_keys, json_root_type, variant_root_type
from ..functions.text import is_blank, strip
from .rules import Rule


def valid_json(col: str) -> Rule:
    c = F.col(col)
    return Rule(f"valid_json:{col}", col, "format_violation", ~is_blank(c) & ~is_json(c))


def json_field_equals(json: str, path: str, expected: str | Column) -> Rule:
    """A scalar inside the JSON that must equal another column."""
    want = F.col(expected) if isinstance(expected, str) else expected
    got = F.get_json_object(F.col(json), path)
    bad = F.coalesce(is_json(F.col(json)), F.lit(False)) & ~got.eqNullSafe(want)
    return Rule(f"json_field_equals:{json}", json, "inconsistent_value", bad, observed=got, expected=want)


def _listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda k: k != "")


def required_keys(json: str, path: str | None, listed: str | Column) -> Rule:
    """Keys named in a comma-separated list that the JSON object lacks."""
    names = F.col(listed) if isinstance(listed, str) else listed
    ok = F.coalesce(is_json(F.col(json)), F.lit(False))
    present = F.coalesce(json_keys(args_of(F.col(json), path)), F.array().cast("array<string>"))
    lacking = F.array_except(_listed(names), present)
    return Rule(f"required_keys:{json}", json, "inconsistent_value", ok & (F.size(lacking) > 0),
                observed=F.array_join(F.array_sort(lacking), ","), expected=names)


def unknown_keys(json: str, path: str | None, schema_json: str | Column) -> Rule:
    """Keys of the JSON object that its declared schema (a JSON object) does not know."""
    schema = F.col(schema_json) if isinstance(schema_json, str) else schema_json
    ok = F.coalesce(is_json(F.col(json)) & is_json(schema), F.lit(False))
    extra = F.array_except(json_keys(args_of(F.col(json), path)), json_keys(schema))
    return Rule(f"unknown_keys:{json}", json, "inconsistent_value", ok & (F.size(extra) > 0),
                observed=F.array_join(F.array_sort(extra), ","))


# Type words of a schema and the JSON types they stand for.
TYPE_WORDS = {
    "string": "string", "integer": "number", "int": "number", "number": "number", "float": "number",
    "boolean": "boolean", "bool": "boolean", "array": "array", "list": "array", "object": "object", "dict": "object",
}


def wrong_arg_types(json: Column, path: str | None, schema_json: Column) -> Column:
    """Sorted keys whose value is of another type than the first word the schema gives for them."""
    words = F.create_map(*[F.lit(x) for kv in TYPE_WORDS.items() for x in kv])
    args = F.try_parse_json(args_of(json, path)).try_cast("map<string,variant>")
    declared = F.from_json(schema_json, "map<string,string>")

    def differs(key: Column, value: Column) -> Column:
        word = F.lower(F.regexp_extract(F.try_element_at(declared, key), r"^\s*(\w+)", 1))
        want = F.try_element_at(words, word)
        got = variant_root_type(value)
        whole = F.schema_of_variant(value).isin("BIGINT", "INT", "SMALLINT", "TINYINT") | F.schema_of_variant(
            value).rlike(r"^DECIMAL\(\d+,0\)$")
        return want.isNotNull() & ((want != got) | (word.isin("integer", "int") & ~whole))

    return F.array_sort(F.map_keys(F.map_filter(args, differs)))


def json_arg_types(json: str, path: str | None, schema_json: str | Column) -> Rule:
    schema = F.col(schema_json) if isinstance(schema_json, str) else schema_json
    ok = F.coalesce(is_json(F.col(json)) & is_json(schema), F.lit(False))
    wrong = wrong_arg_types(F.col(json), path, schema)
    return Rule(f"json_arg_types:{json}", json, "wrong_type", ok & (F.size(wrong) > 0),
                observed=F.array_join(wrong, ","))


def json_root_type_matches(json: str, declared: str | Column, report_col: str | None = None) -> Rule:
    """Declared type of a JSON value against its real one; reported on the declaring column by default."""
    want = F.col(declared) if isinstance(declared, str) else declared
    got = json_root_type(F.col(json))
    name = report_col or (declared if isinstance(declared, str) else json)
    return Rule(f"json_root_type:{json}", name, "inconsistent_value", got != F.lower(strip(want)),
                observed=want, expected=got)
