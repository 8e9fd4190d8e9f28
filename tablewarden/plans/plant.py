"""Catalogue: planting faults.  Every query returns the spoilt cells with their clean and dirty values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import plain_decimal
from ..operators.contaminate import (
    Fault, added_key, append_copies, constant, contaminate, copy_from_donor, cut_short, dropped_key, prefixed,
    renamed_key, retyped_key, scaled, shifted_time,
)
from ..operators.related import before_previous, below_column, copy_from_other_group
from ..operators.review import suite_summary
from .base import query, s_draw, s_luck, s_money, s_picked, s_typo, table


def _spoilt_cells(dirty, truth, col: str, row_id: str):
    seen = dirty.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(col).cast("string").alias("dirty_value"))
    return truth.join(seen, "row_id").select("row_id", "issue_type", "difficulty", "clean_value", "dirty_value")


def _plant(name: str, source: str, row: str, col: str, base: Callable[[], Column] | None, base_sql: str, fault: Fault, new_sql: str,
           issue_type: str, difficulty: float) -> None:
    """Register one rule: ``new_sql`` is the SQL of the new value over the clean text ``v`` (NULL: does not apply)."""
    sql = f"""
    WITH a AS (SELECT CAST({row} AS BIGINT) AS {row}, {base_sql} AS v FROM {source}),
    b AS (SELECT *, CASE WHEN {s_picked(row, f'0:{col}', fault.rate)} THEN {new_sql} END AS n FROM a)
    SELECT {row} AS row_id, '{issue_type}' AS issue_type, {difficulty}::DOUBLE AS difficulty, trim(v) AS clean_value, n AS dirty_value
    FROM b WHERE n IS NOT NULL"""

    @query(name, sql)
    def run(spark, sf):
        clean = table(spark, sf, source)
        if base is not None:
            clean = clean.withColumn(col, base())
        dirty, truth = contaminate(clean.select(row, col), [fault], row)
        return _spoilt_cells(dirty, truth, col, row)

    run.__doc__ = f"Plant {name} in {source}.{col}."


def _luck(row: str, col: str) -> str:
    return s_luck(row, col)


def _money() -> Column:
    return plain_decimal(F.col("o_totalprice"))


def _balance() -> Column:
    return plain_decimal(F.col("c_acctbal"))


def _iso() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


_ISO_SQL = "strftime(o_orderdate, '%Y-%m-%d')"
_NEG = ("'-' || CASE WHEN CAST(v AS DOUBLE) = floor(CAST(v AS DOUBLE)) THEN CAST(CAST(abs(CAST(v AS DOUBLE)) AS BIGINT) AS VARCHAR) || '.0' "
        "ELSE regexp_replace(ltrim(v, '-'), '0+$', '') END")

_plant("plant_missing_value", "customer", "c_custkey", "c_name", None, "c_name",
       Fault("missing_value", "c_name", rate=0.03), "''", "missing_value", 1.0)
_plant("plant_whitespace_value", "customer", "c_custkey", "c_mktsegment", None, "c_mktsegment",
       Fault("whitespace_value", "c_mktsegment", rate=0.03), "' '", "missing_value", 2.5)
_plant("plant_wrong_type_text", "orders", "o_orderkey", "o_totalprice", _money, s_money("o_totalprice"),
       Fault("wrong_type_text", "o_totalprice", rate=0.02),
       f"['not-a-number', 'N/A', 'null', 'undefined'][{_luck('o_orderkey', 'o_totalprice')} % 4 + 1]", "wrong_type", 1.0)
_plant("plant_negative_value", "customer", "c_custkey", "c_acctbal", _balance, s_money("c_acctbal"),
       Fault("negative_value", "c_acctbal", rate=0.05), _NEG, "out_of_range", 1.0)
_plant("plant_typo", "part", "p_partkey", "p_name", None, "p_name", Fault("typo", "p_name", rate=0.05, difficulty=1.5),
       s_typo("v", "p_partkey", "p_name"), "format_violation", 1.5)
_plant("plant_date_layout", "orders", "o_orderkey", "o_orderdate", _iso, _ISO_SQL, Fault("date_us", "o_orderdate", rate=0.02),
       "strftime(strptime(v, '%Y-%m-%d'), '%m-%d-%Y')", "format_violation", 1.5)
_plant("plant_letter_for_digit", "orders", "o_orderkey", "o_totalprice", _money, s_money("o_totalprice"),
       Fault("letter_for_digit", "o_totalprice", rate=0.02), "CASE WHEN contains(v, '0') THEN replace(v, '0', 'O') END", "wrong_type", 1.5)
_plant("plant_broken_sum", "orders", "o_orderkey", "o_totalprice", _money, s_money("o_totalprice"),
       Fault(scaled(1.1), "o_totalprice", rate=0.02, difficulty=2.0),
       "CAST(CAST(CAST(v AS DOUBLE) * 1.1::DOUBLE AS DECIMAL(38,2)) AS VARCHAR)", "inconsistent_value", 2.0)
_plant("plant_cut_text", "documents", "doc_id", "text", None, "text",
       Fault(cut_short(0.5), "text", rate=0.05, issue_type="missing_value", difficulty=2.5),
       "CASE WHEN length(v) > 1 THEN substr(v, 1, greatest(CAST(floor(length(v) * 0.5) AS INTEGER), 1)) END", "missing_value", 2.5)
_plant("plant_flipped_flag", "labels", "doc_id", "toxic", None, "CAST(toxic AS VARCHAR)", Fault("flip_flag", "toxic", rate=0.2),
       "CASE v WHEN '0' THEN '1' WHEN '1' THEN '0' END", "inconsistent_value", 2.0)
_plant("plant_out_of_set", "customer", "c_custkey", "c_mktsegment", None, "c_mktsegment",
       Fault(constant("UNKNOWN"), "c_mktsegment", rate=0.03, issue_type="format_violation", difficulty=1.5), "'UNKNOWN'", "format_violation", 1.5)
_plant("plant_out_of_range", "part", "p_partkey", "p_size", None, "CAST(p_size AS VARCHAR)",
       Fault(scaled(100.0, 0), "p_size", rate=0.03, issue_type="out_of_range", difficulty=1.0),
       "CAST(CAST(v AS BIGINT) * 100 AS VARCHAR)", "out_of_range", 1.0)
_plant("plant_moved_timestamp", "events", "event_id", "ts", lambda: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
       "strftime(ts, '%Y-%m-%dT%H:%M:%S')", Fault(shifted_time(-10), "ts", rate=0.02, difficulty=2.0),
       "strftime(strptime(v, '%Y-%m-%dT%H:%M:%S') - INTERVAL 10 DAY, '%Y-%m-%dT%H:%M:%S')", "inconsistent_value", 2.0)
_plant("plant_marker", "documents", "doc_id", "text", None, "text", Fault(prefixed("[SYSTEM] "), "text", rate=0.1, difficulty=2.5),
       "'[SYSTEM] ' || v", "inconsistent_value", 2.5)
_plant("plant_extra_decimal", "orders", "o_orderkey", "o_totalprice", _money, s_money("o_totalprice"),
       Fault("extra_decimal", "o_totalprice", rate=0.02), "v || '9'", "format_violation", 1.5)
_plant("plant_json_renamed_key", "events", "event_id", "props", None, "props",
       Fault(renamed_key("k", "key"), "props", rate=0.03, difficulty=2.0), "replace(v, '\"k\"', '\"key\"')", "inconsistent_value", 2.0)
_plant("plant_json_dropped_key", "events", "event_id", "props", None, "props",
       Fault(dropped_key("k"), "props", rate=0.03, difficulty=2.5), "'{}'", "inconsistent_value", 2.5)
_plant("plant_json_added_key", "events", "event_id", "props", None, "props",
       Fault(added_key("mode", '"fast"'), "props", rate=0.03, difficulty=3.0),
       "regexp_replace(v, '\\}$', '') || ', \"mode\": \"fast\"}'", "inconsistent_value", 3.0)
_plant("plant_json_retyped_key", "events", "event_id", "props", None, "props",
       Fault(retyped_key("k", '"high"'), "props", rate=0.03, issue_type="wrong_type", difficulty=2.5),
       "regexp_replace(v, '(\"k\"\\s*:\\s*)[0-9]+', '\\1\"high\"')", "wrong_type", 2.5)


@query("plant_row_copies", f"""
SELECT CAST(c_custkey + m AS BIGINT) AS row_id, 'duplicate_row' AS issue_type, c_name,
       'Exact duplicate of row ' || c_custkey AS description
FROM customer, (SELECT max(c_custkey) + 1 AS m FROM customer) WHERE {s_picked('c_custkey', 'copy', 0.05)}
""")
def plant_row_copies(spark, sf):
    dirty, truth = append_copies(table(spark, sf, "customer"), "c_custkey", "c_custkey", 0.05)
    return truth.join(dirty.select(F.col("c_custkey").alias("row_id"), "c_name"), "row_id").select(
        "row_id", "issue_type", "c_name", "description"
    )


def _donor_sql(source: str, row: str, col: str, shift: int, rate: float, issue_type: str, difficulty: float) -> str:
    return f"""
    SELECT CAST(c.{row} AS BIGINT) AS row_id, '{issue_type}' AS issue_type, {difficulty}::DOUBLE AS difficulty,
           CAST(c.{col} AS VARCHAR) AS clean_value, CAST(o.{col} AS VARCHAR) AS dirty_value
    FROM {source} c JOIN {source} o ON o.{row} = c.{row} - {shift}
    WHERE {s_picked(f'c.{row}', f'donor:{col}', rate)} AND c.{col} <> o.{col}"""


@query("plant_copied_key", _donor_sql("customer", "c_custkey", "c_name", 16, 0.05, "duplicate_row", 1.5))
def plant_copied_key(spark, sf):
    dirty, truth = copy_from_donor(table(spark, sf, "customer"), "c_name", 16, "c_custkey", 0.05)
    return _spoilt_cells(dirty, truth, "c_name", "c_custkey")


@query("plant_copied_cell", _donor_sql("part", "p_partkey", "p_type", 9, 0.1, "inconsistent_value", 2.0))
def plant_copied_cell(spark, sf):
    dirty, truth = copy_from_donor(
        table(spark, sf, "part"), "p_type", 9, "p_partkey", 0.1, issue_type="inconsistent_value", difficulty=2.0
    )
    return _spoilt_cells(dirty, truth, "p_type", "p_partkey")


@query("plant_in_order", f"""
WITH a AS (SELECT c_custkey, {s_money('c_acctbal')} AS v, {s_picked('c_custkey', '0:c_acctbal', 0.2)} AS p,
           {s_picked('c_custkey', '1:c_acctbal', 0.2)} AS q FROM customer)
SELECT CAST(c_custkey AS BIGINT) AS row_id, issue_type, difficulty, v AS clean_value, CASE WHEN q THEN '-1' ELSE '' END AS dirty_value
FROM a, (VALUES (0, 'missing_value', 1.5::DOUBLE), (1, 'out_of_range', 1.0::DOUBLE)) t(seq, issue_type, difficulty)
WHERE (seq = 0 AND p) OR (seq = 1 AND p AND q)
""")
def plant_in_order(spark, sf):
    """Two faults on one cell: the second sees what the first left, and both are in the truth."""
    customers = table(spark, sf, "customer").select("c_custkey", _balance().alias("c_acctbal"))
    faults = [Fault("missing_value", "c_acctbal", rate=0.2, difficulty=1.5),
              Fault("negative_value", "c_acctbal", rate=0.2, where=F.col("c_acctbal") == "")]
    dirty, truth = contaminate(customers, faults, "c_custkey")
    return _spoilt_cells(dirty, truth, "c_acctbal", "c_custkey")


@query("plant_below_partner", f"""
WITH a AS (SELECT p_partkey, {s_money('p_retailprice')} AS v, p_size FROM part)
SELECT CAST(p_partkey AS BIGINT) AS row_id, 'inconsistent_value' AS issue_type, 2.0::DOUBLE AS difficulty, v AS clean_value,
  CAST(CAST(p_size - 1 AS DECIMAL(38,2)) AS VARCHAR) AS dirty_value
FROM a WHERE {s_picked('p_partkey', '0:price', 0.05)}
""")
def plant_below_partner(spark, sf):
    """Prices of parts moved below their size, which no clean part has."""
    parts = table(spark, sf, "part").select("p_partkey", plain_decimal(F.col("p_retailprice")).alias("price"), "p_size")
    fault = Fault(below_column("p_size"), "price", rate=0.05, issue_type="inconsistent_value", difficulty=2.0)
    return _spoilt_cells(*contaminate(parts, [fault], "p_partkey"), "price", "p_partkey")


_STAMP = "'%Y-%m-%d %H:%M:%S'"


@query("plant_before_previous", f"""
WITH a AS (SELECT event_id, date_trunc('second', ts) AS ts, {s_picked('event_id', 'previous:ts', 0.05)} AS p, user_id, ts AS seen FROM events),
b AS (SELECT *, lag(ts) OVER w AS before, lag(p) OVER w AS drawn FROM a WINDOW w AS (PARTITION BY user_id ORDER BY seen, event_id))
SELECT CAST(event_id AS BIGINT) AS row_id, 'inconsistent_value' AS issue_type, 2.0::DOUBLE AS difficulty, strftime(ts, {_STAMP}) AS clean_value,
  strftime(before - INTERVAL 1 SECOND, {_STAMP}) AS dirty_value
FROM b WHERE p AND before IS NOT NULL AND NOT drawn
""")
def plant_before_previous(spark, sf):
    """Times of events moved to just before the event ahead of them, per user."""
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("seen"), F.date_trunc("second", "ts").alias("ts"))
    dirty, truth = before_previous(events, "ts", "seen", "event_id", ["user_id"], 0.05)
    return _spoilt_cells(dirty.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), truth, "ts", "event_id")


@query("plant_foreign_text", f"""
WITH b AS (SELECT doc_id, text, lang, {s_draw('doc_id', 'slot:text')} % 1024 AS slot FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
o AS (SELECT lang, slot, min(doc_id) AS donor FROM b GROUP BY 1, 2),
n AS (SELECT lang, donor, row_number() OVER (PARTITION BY lang ORDER BY slot) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM o),
g AS (SELECT lang, coalesce(lead(lang) OVER (ORDER BY lang), first_value(lang) OVER (ORDER BY lang)) AS giver FROM (SELECT DISTINCT lang FROM b)),
w AS (SELECT b.doc_id, b.text, b.lang, giver, {s_draw('b.doc_id', 'foreign:luck:text')} AS luck FROM b JOIN g USING (lang) WHERE {s_picked('b.doc_id', 'foreign:text', 0.05)} AND giver <> lang)
SELECT CAST(w.doc_id AS BIGINT) AS row_id, 'inconsistent_value' AS issue_type, 2.5::DOUBLE AS difficulty, regexp_replace(w.text, '^\\s+|\\s+$', '', 'g') AS clean_value, d.text AS dirty_value
FROM w JOIN n ON n.lang = w.giver AND n.k = w.luck % n.n JOIN documents d ON d.doc_id = n.donor WHERE d.text <> w.text
""")
def plant_foreign_text(spark, sf):
    """Texts of documents taken from a document of another language."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    dirty, truth = copy_from_other_group(docs, "text", "lang", "doc_id", 0.05)
    return _spoilt_cells(dirty, truth, "text", "doc_id")


@query("truth_summary", f"""
WITH t AS (
  SELECT 'customer' AS dataset, 'missing_value' AS issue_type, 1.0::DOUBLE AS d FROM customer WHERE {s_picked('c_custkey', '0:c_name', 0.03)}
  UNION ALL SELECT 'customer', 'missing_value', 2.5 FROM customer WHERE {s_picked('c_custkey', '1:c_mktsegment', 0.03)}
  UNION ALL SELECT 'customer', 'out_of_range', 1.0 FROM customer WHERE {s_picked('c_custkey', '2:c_acctbal', 0.03)}
  UNION ALL SELECT 'part', 'format_violation', 1.0 FROM part WHERE {s_picked('p_partkey', '0:p_name', 0.03)})
SELECT dataset, issue_type, count(*) AS planted, sum(d) AS difficulty, max(d) AS hardest FROM t GROUP BY ROLLUP (dataset, issue_type)
""")
def truth_summary(spark, sf):
    """Planted faults per dataset and type, with subtotals."""
    customers = table(spark, sf, "customer").withColumn("c_acctbal", _balance())
    faults = [Fault("missing_value", "c_name", rate=0.03), Fault("whitespace_value", "c_mktsegment", rate=0.03),
              Fault("negative_value", "c_acctbal", rate=0.03)]
    _, a = contaminate(customers, faults, "c_custkey", "customer")
    _, b = contaminate(table(spark, sf, "part"), [Fault("typo", "p_name", rate=0.03)], "p_partkey", "part")
    return suite_summary(a.unionByName(b))
