"""Catalogue: checks on tool-call records, built from the events and their JSON properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, tools
from ..operators.contaminate import Fault, added_key, contaminate, cut_short, dropped_key, renamed_key, retyped_key
from .base import findings, query, s_blank, s_finding, s_picked, table

FAULTS = [
    Fault(renamed_key("click", "clicked"), "call", rate=0.05, difficulty=2.0),
    Fault(dropped_key("user"), "args", rate=0.03, difficulty=2.5),
    Fault(added_key("mode", '"fast"'), "args", rate=0.03, difficulty=3.0),
    Fault(retyped_key("k", '"high"'), "args", rate=0.03, issue_type="wrong_type", difficulty=2.5),
    Fault(cut_short(0.6), "args", rate=0.03, issue_type="format_violation", difficulty=2.0),
]
SCHEMA = '{"k": "integer (count)", "user": "integer", "tag": "string"}'
REQUIRED = "k, user"


def records(spark, sf):
    """Tool-call records with five kinds of planted faults, and the truth about them."""
    calls = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("function_name"),
        F.concat(F.lit('{"function": "'), "event_type", F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}")).alias("call"),
        F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "user": '), F.col("user_id").cast("string"), F.lit("}")).alias("args"),
        F.lit(SCHEMA).alias("schema"), F.lit(REQUIRED).alias("required"),
        F.when(F.col("event_id") % 11 == 0, "array").otherwise("object").alias("return_type"),
    )
    return contaminate(calls, FAULTS, "event_id", "calls")


def _p(i: int, col: str, rate: float) -> str:
    return s_picked("event_id", f"{i}:{col}", rate)


RECORDS_SQL = f"""
r0 AS (SELECT event_id, event_type AS function_name, '{{"function": "' || event_type || '", "id": ' || event_id || '}}' AS call,
       regexp_replace(props, '\\}}$', '') || ', "user": ' || user_id || '}}' AS args,
       CASE WHEN event_id % 11 = 0 THEN 'array' ELSE 'object' END AS return_type FROM events),
r1 AS (SELECT * REPLACE (CASE WHEN {_p(0, 'call', 0.05)} THEN replace(call, '"click"', '"clicked"') ELSE call END AS call,
       CASE WHEN {_p(1, 'args', 0.03)} THEN json_object('k', CAST(json_extract(args, '$.k') AS BIGINT))::VARCHAR ELSE args END AS args) FROM r0),
r2 AS (SELECT * REPLACE (CASE WHEN {_p(2, 'args', 0.03)} THEN regexp_replace(args, '\\}}$', '') || ', "mode": "fast"}}' ELSE args END AS args) FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN {_p(3, 'args', 0.03)} THEN regexp_replace(args, '("k"\\s*:\\s*)([0-9]+)', '\\1"high"') ELSE args END AS args) FROM r2),
r AS (SELECT * REPLACE (CASE WHEN {_p(4, 'args', 0.03)} THEN substr(args, 1, CAST(floor(length(args) * 0.6) AS INTEGER)) ELSE args END AS args) FROM r3)
"""


def _run(spark, sf, rule, *extra):
    dirty, _ = records(spark, sf)
    return findings(rules.run_rules(dirty, [rule], "event_id"), *extra)


@query("valid_json", f"""
WITH {RECORDS_SQL} SELECT {s_finding('event_id', 'args', 'format_violation')} FROM r WHERE NOT {s_blank('args')} AND NOT json_valid(args)
""")
def valid_json(spark, sf):
    return _run(spark, sf, tools.valid_json("args"))


@query("json_field_equals", f"""
WITH {RECORDS_SQL} SELECT {s_finding('event_id', 'call', 'inconsistent_value', "json_extract_string(call, '$.function') AS observed, function_name AS expected")}
FROM r WHERE json_extract_string(call, '$.function') IS DISTINCT FROM function_name
""")
def json_field_equals(spark, sf):
    return _run(spark, sf, tools.json_field_equals("call", "$.function", "function_name"), "observed", "expected")


@query("required_keys", f"""
WITH {RECORDS_SQL}, k AS (SELECT event_id, list_filter(['k', 'user'], lambda x: NOT list_contains(json_keys(args), x)) AS missing FROM r WHERE json_valid(args))
SELECT {s_finding('event_id', 'args', 'inconsistent_value', "array_to_string(missing, ',') AS observed")} FROM k WHERE len(missing) > 0
""")
def required_keys(spark, sf):
    return _run(spark, sf, tools.required_keys("args", None, "required"), "observed")


@query("unknown_keys", f"""
WITH {RECORDS_SQL}, k AS (SELECT event_id, list_filter(json_keys(args), lambda x: x NOT IN ('k', 'user', 'tag')) AS extra FROM r WHERE json_valid(args))
SELECT {s_finding('event_id', 'args', 'inconsistent_value', "array_to_string(list_sort(extra), ',') AS observed")} FROM k WHERE len(extra) > 0
""")
def unknown_keys(spark, sf):
    return _run(spark, sf, tools.unknown_keys("args", None, "schema"), "observed")


@query("json_arg_types", f"""
WITH {RECORDS_SQL} SELECT {s_finding('event_id', 'args', 'wrong_type', "'k' AS observed")} FROM r
WHERE CASE WHEN json_valid(args) THEN json_type(args, '$.k') = 'VARCHAR' ELSE false END
""")
def json_arg_types(spark, sf):
    return _run(spark, sf, tools.json_arg_types("args", None, "schema"), "observed")


@query("json_root_type", f"""
WITH {RECORDS_SQL} SELECT {s_finding('event_id', 'return_type', 'inconsistent_value', "return_type AS observed, 'object' AS expected")} FROM r
WHERE CASE WHEN json_valid(args) THEN return_type <> 'object' ELSE false END
""")
def json_root_type(spark, sf):
    return _run(spark, sf, tools.json_root_type_matches("args", "return_type"), "observed", "expected")


@query("record_suite", f"""
WITH {RECORDS_SQL}, f AS (
  SELECT 'valid_json' AS rule_id FROM r WHERE NOT json_valid(args)
  UNION ALL SELECT 'json_field_equals' FROM r WHERE json_extract_string(call, '$.function') IS DISTINCT FROM function_name
  UNION ALL SELECT 'required_keys' FROM r WHERE CASE WHEN json_valid(args) THEN NOT list_contains(json_keys(args), 'user') OR NOT list_contains(json_keys(args), 'k') ELSE false END
  UNION ALL SELECT 'unknown_keys' FROM r WHERE CASE WHEN json_valid(args) THEN list_contains(json_keys(args), 'mode') ELSE false END
  UNION ALL SELECT 'json_arg_types' FROM r WHERE CASE WHEN json_valid(args) THEN json_type(args, '$.k') = 'VARCHAR' ELSE false END)
SELECT rule_id, count(*) AS findings FROM f GROUP BY 1
""")
def record_suite(spark, sf):
    """All record checks in one scan, counted per rule."""
    dirty, _ = records(spark, sf)
    found = rules.run_rules(dirty, [
        tools.valid_json("args"), tools.json_field_equals("call", "$.function", "function_name"),
        tools.required_keys("args", None, "required"), tools.unknown_keys("args", None, "schema"),
        tools.json_arg_types("args", None, "schema"),
    ], "event_id")
    return found.groupBy(F.split("rule_id", ":")[0].alias("rule_id")).agg(F.count(F.lit(1)).alias("findings"))
