"""Catalogue: checks on tabular data.

Where a table has no fault of the kind, faults are planted first, at a seeded rate over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import plain_decimal
from ..operators import keyed, ordered, relations, rules, spelling, statistics
from ..operators.contaminate import Fault, append_copies, contaminate, copy_from_donor, scaled, shifted_time
from ..operators.score import confusion, precision_recall, weighted_score
from .base import (
    findings, query, s_blank, s_finding, s_luck, s_money, s_number, s_picked, s_spoilt, s_typo, table,
)

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# --- customers with three kinds of faults ----------------------------------------------------------------------------

CUSTOMER_FAULTS = [
    Fault("missing_value", "c_name", rate=0.02), Fault("whitespace_value", "c_mktsegment", rate=0.02),
    Fault("negative_value", "c_acctbal", rate=0.03),
]


def dirty_customers(spark, sf):
    clean = table(spark, sf, "customer").withColumn("c_acctbal", plain_decimal(F.col("c_acctbal")))
    return contaminate(clean, CUSTOMER_FAULTS, "c_custkey", F.col("c_nationkey").cast("string"))


_NAME, _SEG, _BAL = (
    s_picked("c_custkey", "0:c_name", 0.02), s_picked("c_custkey", "1:c_mktsegment", 0.02),
    s_picked("c_custkey", "2:c_acctbal", 0.03),
)
DIRTY_CUSTOMER_SQL = f"""
dirty AS (
  SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS dataset,
         CASE WHEN {_NAME} THEN '' ELSE c_name END AS c_name,
         CASE WHEN {_SEG} THEN ' ' ELSE c_mktsegment END AS c_mktsegment,
         CASE WHEN {_BAL} THEN -abs(c_acctbal) ELSE c_acctbal END AS c_acctbal
  FROM customer),
truth AS (
  SELECT c_custkey AS row_id, CAST(c_nationkey AS VARCHAR) AS dataset, 'c_name' AS col, 'missing_value' AS issue_type,
         1.0::DOUBLE AS difficulty FROM customer WHERE {_NAME}
  UNION ALL SELECT c_custkey, CAST(c_nationkey AS VARCHAR), 'c_mktsegment', 'missing_value', 2.5 FROM customer WHERE {_SEG}
  UNION ALL SELECT c_custkey, CAST(c_nationkey AS VARCHAR), 'c_acctbal', 'out_of_range', 1.0 FROM customer WHERE {_BAL}),
found AS (
  SELECT c_custkey AS row_id, dataset, 'c_name' AS col, 'missing_value' AS issue_type FROM dirty WHERE {s_blank("c_name")}
  UNION ALL SELECT c_custkey, dataset, 'c_mktsegment', 'missing_value' FROM dirty WHERE {s_blank("c_mktsegment")}
  UNION ALL SELECT c_custkey, dataset, 'c_acctbal', 'out_of_range' FROM dirty WHERE c_acctbal < 0)
"""


def customer_rules():
    return [rules.missing_value("c_name"), rules.missing_value("c_mktsegment"), rules.out_of_range("c_acctbal", 0)]


@query("flagship_contaminate_detect_score", f"""
WITH {DIRTY_CUSTOMER_SQL},
t AS (SELECT dataset, count(*) AS n, sum(difficulty) AS w FROM truth GROUP BY dataset),
m AS (SELECT f.dataset, count(*) AS reported, count(t.row_id) AS tp, coalesce(sum(t.difficulty), 0) AS found
      FROM found f LEFT JOIN truth t USING (dataset, row_id, col, issue_type) GROUP BY f.dataset),
d AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS dataset FROM customer),
j AS (SELECT d.dataset, coalesce(reported, 0) AS reported, coalesce(tp, 0) AS tp, coalesce(found, 0) AS found,
             coalesce(n, 0) AS n, coalesce(w, 0) AS w
      FROM d LEFT JOIN m USING (dataset) LEFT JOIN t USING (dataset)),
pr AS (SELECT *, CASE WHEN reported > 0 THEN tp * 1.0 / reported ELSE 0 END AS p,
                 CASE WHEN n > 0 THEN tp * 1.0 / n ELSE 0 END AS r,
                 CASE WHEN w > 0 THEN found / w ELSE 0 END AS wr,
                 CASE WHEN found > 0 THEN found / (found + (reported - tp) * w / n) ELSE 0 END AS wp FROM j)
SELECT dataset, CAST(tp AS BIGINT) AS tp, CAST(reported - tp AS BIGINT) AS fp, CAST(n - tp AS BIGINT) AS fn,
       round(CASE WHEN reported = 0 AND n = 0 THEN 1 ELSE p END, 6)::DOUBLE AS precision_,
       round(CASE WHEN reported = 0 AND n = 0 THEN 1 ELSE r END, 6)::DOUBLE AS recall_,
       round(CASE WHEN reported = 0 AND n = 0 THEN 1 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1,
       round(CASE WHEN reported = 0 AND n = 0 THEN 1 WHEN wp + wr > 0 THEN 2 * wp * wr / (wp + wr) ELSE 0 END, 6)::DOUBLE
         AS identify_score
FROM pr
""")
def flagship(spark, sf) -> DataFrame:
    """Plant faults in the customers, find them by rule, and score the finds per nation."""
    dirty, truth = dirty_customers(spark, sf)
    found = rules.run_rules(dirty, customer_rules(), "c_custkey", F.col("c_nationkey").cast("string"))
    runs = lambda df: df.withColumn("episode_id", F.lit("rules")).withColumn("step", F.lit(1))
    steps = runs(table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("dataset")).distinct())
    scored = weighted_score(precision_recall(confusion(steps, runs(found), truth)))
    return scored.select(
        "dataset", "tp", "fp", "fn", F.round("precision", 6).alias("precision_"), F.round("recall", 6).alias("recall_"),
        F.round("f1", 6).alias("f1"), F.round("identify_score", 6).alias("identify_score"),
    )


@query("completeness_profile", f"""
WITH {DIRTY_CUSTOMER_SQL}, c AS (
  SELECT count(*) AS n, count(*) FILTER ({s_blank('c_name')}) AS a, count(*) FILTER ({s_blank('c_mktsegment')}) AS b,
         count(*) FILTER (c_acctbal IS NULL) AS d FROM dirty)
SELECT 'c_name' AS col, n AS n_rows, a AS n_missing, round(a * 1.0 / n, 6)::DOUBLE AS missing_share FROM c
UNION ALL SELECT 'c_mktsegment', n, b, round(b * 1.0 / n, 6)::DOUBLE FROM c
UNION ALL SELECT 'c_acctbal', n, d, round(d * 1.0 / n, 6)::DOUBLE FROM c
""")
def completeness_profile(spark, sf):
    dirty, _ = dirty_customers(spark, sf)
    return statistics.completeness(dirty, ["c_name", "c_mktsegment", "c_acctbal"]).withColumn(
        "missing_share", F.round("missing_share", 6)
    )


@query("missing_value", f"""
WITH d AS (SELECT doc_id, CASE WHEN {s_picked('doc_id', '0:text', 0.05)} THEN '' ELSE text END AS text,
                  CASE WHEN {s_picked('doc_id', '1:lang', 0.05)} THEN ' ' ELSE lang END AS lang FROM documents)
SELECT {s_finding('doc_id', 'text', 'missing_value')} FROM d WHERE {s_blank('text')}
UNION ALL SELECT {s_finding('doc_id', 'lang', 'missing_value')} FROM d WHERE {s_blank('lang')}
""")
def missing_value(spark, sf):
    faults = [Fault("missing_value", "text", rate=0.05), Fault("whitespace_value", "lang", rate=0.05)]
    dirty, _ = contaminate(table(spark, sf, "documents"), faults, "doc_id")
    return findings(rules.run_rules(dirty, [rules.missing_value("text"), rules.missing_value("lang")], "doc_id"))


_O_TEXT = s_picked("o_orderkey", "0:o_totalprice", 0.02)
_O_LETTER = s_picked("o_orderkey", "1:o_totalprice", 0.02)
_WORDS = "['not-a-number', 'N/A', 'null', 'undefined']"


@query("wrong_type", f"""
WITH a AS (SELECT o_orderkey, {s_spoilt(s_money('o_totalprice'), _O_TEXT,
           f"{_WORDS}[{s_luck('o_orderkey', 'o_totalprice')} % 4 + 1]")} AS v FROM orders),
b AS (SELECT o_orderkey, {s_spoilt('v', _O_LETTER, "CASE WHEN contains(v, '0') THEN replace(v, '0', 'O') END")} AS v FROM a)
SELECT {s_finding('o_orderkey', 'o_totalprice', 'wrong_type', 'v AS observed')} FROM b
WHERE NOT {s_blank('v')} AND {s_number('v')} IS NULL
""")
def wrong_type(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_totalprice", plain_decimal(F.col("o_totalprice")))
    faults = [Fault("wrong_type_text", "o_totalprice", rate=0.02), Fault("letter_for_digit", "o_totalprice", rate=0.02)]
    dirty, _ = contaminate(orders, faults, "o_orderkey")
    return findings(rules.run_rules(dirty, [rules.wrong_type("o_totalprice", "float")], "o_orderkey"), "observed")


@query("duplicate_key", """
SELECT CAST(event_id AS BIGINT) AS row_id, 'user_id' AS col, 'duplicate_row' AS issue_type,
       CAST(first_id AS VARCHAR) AS expected
FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, props) AS first_id FROM events)
WHERE event_id > first_id
""")
def duplicate_key(spark, sf):
    return findings(keyed.duplicate_key(table(spark, sf, "events"), ["user_id", "event_type", "props"], "event_id"), "expected")


@query("lineitem_key_copies", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies
FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def lineitem_key_copies(spark, sf):
    keys = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return keys.agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("duplicate_row", f"""
WITH m AS (SELECT max(c_custkey) + 1 AS m FROM customer),
d AS (SELECT * FROM customer UNION ALL
      SELECT c_custkey + m, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer, m WHERE {s_picked('c_custkey', 'copy', 0.05)})
SELECT CAST(c_custkey AS BIGINT) AS row_id, 'c_name' AS col, 'duplicate_row' AS issue_type, CAST(first_id AS VARCHAR) AS expected
FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_name, c_nationkey, c_acctbal, c_mktsegment) AS first_id FROM d)
WHERE c_custkey > first_id
""")
def duplicate_row(spark, sf):
    dirty, _ = append_copies(table(spark, sf, "customer"), "c_name", "c_custkey", 0.05)
    return findings(keyed.duplicate_row(dirty, "c_name", "c_custkey"), "expected")


@query("out_of_range", f"""
WITH {DIRTY_CUSTOMER_SQL}
SELECT {s_finding('c_custkey', 'c_acctbal', 'out_of_range', "'[0,9000]' AS expected")} FROM dirty
WHERE c_acctbal < 0 OR c_acctbal > 9000
""")
def out_of_range(spark, sf):
    dirty, _ = dirty_customers(spark, sf)
    return findings(rules.run_rules(dirty, [rules.out_of_range("c_acctbal", 0, 9000)], "c_custkey"), "expected")


@query("numeric_out_of_range", f"""
SELECT {s_finding('l_orderkey', 'l_quantity', 'out_of_range', "CAST(l_quantity AS BIGINT) AS quantity")} FROM lineitem
WHERE l_quantity < 3 OR l_quantity > 48
""")
def numeric_out_of_range(spark, sf):
    """On a numeric column the bounds reach the parquet reader."""
    rule = rules.numeric_out_of_range("l_quantity", 3, 48)
    found = rules.run_rules(table(spark, sf, "lineitem").where(rule.bad), [rule], "l_orderkey")
    return findings(found, F.col("observed").cast("double").cast("bigint").alias("quantity"))


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


_PRIO = f"SELECT o_orderkey, {s_spoilt('o_orderpriority', s_picked('o_orderkey', '0:o_orderpriority', 0.02), s_typo('o_orderpriority', 'o_orderkey', 'o_orderpriority'))} AS v FROM orders"


@query("in_set", f"""
WITH d AS ({_PRIO})
SELECT {s_finding('o_orderkey', 'o_orderpriority', 'format_violation', 'v AS observed')} FROM d
WHERE NOT {s_blank('v')} AND trim(v) NOT IN ({_quoted(PRIORITIES)})
""")
def in_set(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "orders"), [Fault("typo", "o_orderpriority", rate=0.02)], "o_orderkey")
    return findings(rules.run_rules(dirty, [rules.in_set("o_orderpriority", PRIORITIES)], "o_orderkey"), "observed")


@query("matches_format", f"""
WITH d AS (SELECT c_custkey, {s_spoilt('c_name', s_picked('c_custkey', '0:c_name', 0.05), s_typo('c_name', 'c_custkey', 'c_name'))} AS v FROM customer)
SELECT {s_finding('c_custkey', 'c_name', 'format_violation', 'v AS observed')} FROM d
WHERE NOT regexp_matches(v, '^Customer#[0-9]{{9}}$')
""")
def matches_format(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "customer"), [Fault("typo", "c_name", rate=0.05)], "c_custkey")
    return findings(rules.run_rules(dirty, [rules.matches("c_name", "^Customer#[0-9]{9}$")], "c_custkey"), "observed")


_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
_DATED = f"""
a AS (SELECT o_orderkey, {s_spoilt(_ISO, s_picked('o_orderkey', '0:o_orderdate', 0.02), "strftime(o_orderdate, '%m-%d-%Y')")} AS v FROM orders),
b AS (SELECT o_orderkey, {s_spoilt('v', s_picked('o_orderkey', '1:o_orderdate', 0.02),
      "CASE WHEN regexp_matches(v, '^[0-9]{4}-') THEN strftime(strptime(v, '%Y-%m-%d'), '%d/%m/%Y') END")} AS v FROM a)
"""


def dated_orders(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    faults = [Fault("date_us", "o_orderdate", rate=0.02), Fault("date_slashed", "o_orderdate", rate=0.02)]
    return contaminate(orders, faults, "o_orderkey")


@query("date_format_violation", f"""
WITH {_DATED}
SELECT {s_finding('o_orderkey', 'o_orderdate', 'format_violation', 'v AS observed')} FROM b
WHERE NOT regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR try_strptime(v, '%Y-%m-%d') IS NULL
""")
def date_format_violation(spark, sf):
    dirty, _ = dated_orders(spark, sf)
    return findings(rules.run_rules(dirty, [rules.date_format("o_orderdate")], "o_orderkey"), "observed")


@query("date_range", f"""
WITH {_DATED}
SELECT {s_finding('o_orderkey', 'o_orderdate', 'out_of_range', 'v AS observed')} FROM b
WHERE regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND (v < '1996-01-01' OR v > '1999-12-31')
""")
def date_range(spark, sf):
    dirty, _ = dated_orders(spark, sf)
    return findings(rules.run_rules(dirty, [rules.date_range("o_orderdate", "1996-01-01", "1999-12-31")], "o_orderkey"), "observed")


@query("max_decimals", f"""
WITH d AS (SELECT o_orderkey, {s_spoilt(s_money('o_totalprice'), s_picked('o_orderkey', '0:o_totalprice', 0.02), s_money('o_totalprice') + " || '9'")} AS v FROM orders)
SELECT {s_finding('o_orderkey', 'o_totalprice', 'format_violation', 'v AS observed')} FROM d
WHERE regexp_matches(v, '^[+-]?[0-9]*\\.[0-9]{{3,}}$')
""")
def max_decimals(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_totalprice", plain_decimal(F.col("o_totalprice")))
    dirty, _ = contaminate(orders, [Fault("extra_decimal", "o_totalprice", rate=0.02)], "o_orderkey")
    return findings(rules.run_rules(dirty, [rules.max_decimals("o_totalprice", 2)], "o_orderkey"), "observed")


SEGMENT_TYPOS = f"SELECT c_custkey, {s_spoilt('c_mktsegment', s_picked('c_custkey', '0:c_mktsegment', 0.1), s_typo('c_mktsegment', 'c_custkey', 'c_mktsegment'))} AS v FROM customer"


def misspelt_segments(spark, sf):
    return contaminate(table(spark, sf, "customer"), [Fault("typo", "c_mktsegment", rate=0.1)], "c_custkey")


@query("misspelling", f"""
WITH d AS ({SEGMENT_TYPOS}), w AS (SELECT unnest([{_quoted(SEGMENTS)}]) AS w),
p AS (SELECT c_custkey, v, w, levenshtein(v, w) AS k FROM d, w WHERE v NOT IN ({_quoted(SEGMENTS)})),
b AS (SELECT c_custkey, min(struct_pack(k := k, w := w)) AS b FROM p WHERE k BETWEEN 1 AND 2 GROUP BY c_custkey)
SELECT {s_finding('c_custkey', 'c_mktsegment', 'format_violation', 'b.w AS expected')} FROM b
""")
def misspelling(spark, sf):
    dirty, _ = misspelt_segments(spark, sf)
    return findings(rules.run_rules(dirty, [rules.misspelling("c_mktsegment", SEGMENTS)], "c_custkey"), "expected")


@query("misspelling_vocabulary", f"""
WITH d AS (SELECT p_partkey, {s_spoilt('p_name', s_picked('p_partkey', '0:p_name', 0.05), s_typo('p_name', 'p_partkey', 'p_name'))} AS v FROM part),
w AS (SELECT trim(v) AS w FROM d GROUP BY 1 HAVING count(*) >= 5),
u AS (SELECT DISTINCT trim(v) AS v FROM d WHERE trim(v) NOT IN (SELECT w FROM w)),
n AS (SELECT v, min(struct_pack(k := levenshtein(v, w), w := w)) AS b FROM u, w WHERE levenshtein(v, w) BETWEEN 1 AND 2 GROUP BY v)
SELECT {s_finding('p_partkey', 'p_name', 'format_violation', 'n.b.w AS expected')} FROM d JOIN n ON trim(d.v) = n.v
""")
def misspelling_vocabulary(spark, sf):
    """The column's own frequent values are the dictionary."""
    dirty, _ = contaminate(table(spark, sf, "part"), [Fault("typo", "p_name", rate=0.05)], "p_partkey")
    words = spelling.frequent_values(dirty, "p_name", 5)
    return findings(spelling.misspelling_against(dirty, "p_name", words, row_id="p_partkey"), "expected")


_LINE = "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)"
_NET = "CAST(CAST(l_extendedprice AS DECIMAL(28,6)) * CAST(1 - l_discount AS DECIMAL(28,6)) AS DECIMAL(38,2))"


def lines_with_net(spark, sf):
    lines = table(spark, sf, "lineitem")
    price, rebate = F.col("l_extendedprice").cast("decimal(18,6)"), (1 - F.col("l_discount")).cast("decimal(18,6)")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (price * rebate).alias("net"),
        (price * rebate).cast("decimal(38,2)").cast("string").alias("l_net"),
    )


@query("row_expression", f"""
WITH a AS (SELECT {_LINE} AS row_id, CAST(l_extendedprice AS DECIMAL(18,6)) * CAST(1 - l_discount AS DECIMAL(18,6)) AS net FROM lineitem),
b AS (SELECT row_id, net, {s_spoilt('CAST(CAST(net AS DECIMAL(38,2)) AS VARCHAR)', s_picked('row_id', '0:l_net', 0.01),
      'CAST(CAST(CAST(CAST(net AS DECIMAL(38,2)) AS DOUBLE) * 2 AS DECIMAL(38,2)) AS VARCHAR)')} AS v FROM a)
SELECT {s_finding('row_id', 'l_net', 'inconsistent_value', 'v AS observed')} FROM b
WHERE abs(CAST(net AS DOUBLE) - CAST(v AS DOUBLE)) > 0.01
""")
def row_expression(spark, sf):
    dirty, _ = contaminate(lines_with_net(spark, sf), [Fault("doubled", "l_net", rate=0.01)])
    rule = rules.row_expression("l_net", F.col("net").cast("double"), 0.01)
    return findings(rules.run_rules(dirty, [rule]), "observed")


@query("aggregate_match", """
WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS s FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS BIGINT) AS row_id, 'o_totalprice' AS col, 'inconsistent_value' AS issue_type,
       round(coalesce(s, 0), 2) AS child_sum
FROM orders LEFT JOIN s ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(s, 0)) > 0.01
""")
def aggregate_match(spark, sf):
    found = relations.aggregate_match(
        table(spark, sf, "orders"), "o_orderkey", "o_totalprice", table(spark, sf, "lineitem"), "l_orderkey",
        F.col("l_extendedprice"),
    )
    return findings(found, F.round(F.col("expected").cast("double"), 2).alias("child_sum"))


@query("column_compare", f"""
SELECT {_LINE} AS row_id, 'l_shipdate' AS col, 'inconsistent_value' AS issue_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
""")
def column_compare(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = lines.join(orders, "l_orderkey").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rule = rules.column_compare("l_shipdate", F.col("l_shipdate") >= F.col("o_orderdate"))
    return findings(rules.run_rules(joined, [rule]))


@query("derived_match", f"""
WITH d AS (SELECT c.c_custkey, CASE WHEN {s_picked('c.c_custkey', 'donor:c_name', 0.05)} THEN coalesce(o.c_name, c.c_name) ELSE c.c_name END AS v
           FROM customer c LEFT JOIN customer o ON o.c_custkey = c.c_custkey - 7)
SELECT {s_finding('c_custkey', 'c_name', 'inconsistent_value', "v AS observed, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS expected")}
FROM d WHERE v <> 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
""")
def derived_match(spark, sf):
    dirty, _ = copy_from_donor(table(spark, sf, "customer"), "c_name", 7, "c_custkey", 0.05)
    want = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return findings(rules.run_rules(dirty, [rules.derived_match("c_name", want)], "c_custkey"), "observed", "expected")


@query("implies", f"""
SELECT {s_finding('doc_id', 'quality', 'inconsistent_value')} FROM labels WHERE toxic = 1 AND NOT quality = 0
""")
def implies(spark, sf):
    rule = rules.implies(F.col("toxic") == 1, F.col("quality") == 0, "quality")
    return findings(rules.run_rules(table(spark, sf, "labels"), [rule], "doc_id"))


@query("power_of_two", f"""
SELECT {s_finding('p_partkey', 'p_size', 'format_violation', 'CAST(p_size AS VARCHAR) AS observed')} FROM part
WHERE NOT (p_size > 0 AND (p_size & (p_size - 1)) = 0)
""")
def power_of_two(spark, sf):
    return findings(rules.run_rules(table(spark, sf, "part"), [rules.power_of_two("p_size")], "p_partkey"), "observed")


# --- order ------------------------------------------------------------------------------------------------------------

_MOVED = f"""
d AS (SELECT event_id, user_id,
      CASE WHEN {s_picked('event_id', '0:ts', 0.01)} THEN date_trunc('second', ts) - INTERVAL 2 DAY ELSE date_trunc('second', ts) END AS ts
      FROM events)"""


def moved_events(spark, sf):
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    events = table(spark, sf, "events").withColumn("ts", F.date_format("ts", fmt))
    fault = Fault(shifted_time(-2), "ts", rate=0.01, issue_type="inconsistent_value")
    dirty, truth = contaminate(events, [fault], "event_id")
    return dirty.withColumn("ts", F.try_to_timestamp("ts", F.lit(fmt))), truth


@query("chronological", f"""
WITH {_MOVED}, l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM d)
SELECT {s_finding('event_id', 'ts', 'inconsistent_value', "strftime(p, '%Y-%m-%d %H:%M:%S') AS expected")} FROM l WHERE ts < p
""")
def chronological(spark, sf):
    dirty, _ = moved_events(spark, sf)
    return findings(ordered.chronological(dirty, "ts", "event_id", "event_id", ["user_id"]), "expected")


@query("chronological_whole_table", f"""
WITH {_MOVED}, l AS (SELECT *, lag(ts) OVER (ORDER BY event_id) AS p FROM d)
SELECT {s_finding('event_id', 'ts', 'inconsistent_value', "strftime(p, '%Y-%m-%d %H:%M:%S') AS expected")} FROM l WHERE ts < p
""")
def chronological_whole_table(spark, sf):
    dirty, _ = moved_events(spark, sf)
    return findings(ordered.chronological(dirty, "ts", "event_id", "event_id"), "expected")


_NUMBERED = f"""
d AS (SELECT c.o_orderkey, CASE WHEN {s_picked('c.o_orderkey', 'donor:order_no', 0.02)} THEN coalesce(o.o_orderkey, c.o_orderkey) ELSE c.o_orderkey END AS n
      FROM orders c LEFT JOIN orders o ON o.o_orderkey = c.o_orderkey - 3)"""


def numbered_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("order_no"))
    return copy_from_donor(orders, "order_no", 3, "o_orderkey", 0.02)


@query("sequential_id", f"""
WITH {_NUMBERED}, f AS (SELECT n, min(o_orderkey) AS r, max(o_orderkey) AS last FROM d GROUP BY n)
SELECT {s_finding('r', 'order_no', 'inconsistent_value', 'CAST(n - 1 AS VARCHAR) AS expected')} FROM f
WHERE n <> (SELECT min(n) FROM f) AND n - 1 NOT IN (SELECT n FROM f)
UNION ALL SELECT {s_finding('o_orderkey', 'order_no', 'duplicate_row', 'CAST(f.r AS VARCHAR) AS expected')}
FROM d JOIN f USING (n) WHERE o_orderkey > f.r
""")
def sequential_id(spark, sf):
    dirty, _ = numbered_orders(spark, sf)
    return findings(ordered.sequential_id(dirty, "order_no", "o_orderkey", None), "expected")


@query("id_profile", f"""
WITH {_NUMBERED}
SELECT min(n) AS min_id, max(n) AS max_id, count(*) AS n_rows, count(DISTINCT n) AS n_distinct,
       count(*) - count(DISTINCT n) AS n_repeated, max(n) - min(n) + 1 - count(DISTINCT n) AS n_missing FROM d
""")
def id_profile(spark, sf):
    dirty, _ = numbered_orders(spark, sf)
    return ordered.id_profile(dirty, "order_no")


# --- relations and statistics -------------------------------------------------------------------------------------------

@query("referential_integrity", f"""
WITH d AS (SELECT o_orderkey, CASE WHEN {s_picked('o_orderkey', '0:o_custkey', 0.02)} THEN CAST(CAST(o_custkey AS DOUBLE) * 1000 AS BIGINT) ELSE o_custkey END AS k FROM orders)
SELECT {s_finding('o_orderkey', 'o_custkey', 'referential_integrity', 'CAST(k AS VARCHAR) AS observed')} FROM d
WHERE k NOT IN (SELECT c_custkey FROM customer)
""")
def referential_integrity(spark, sf):
    fault = Fault(scaled(1000.0, 0), "o_custkey", rate=0.02, issue_type="referential_integrity")
    dirty, _ = contaminate(table(spark, sf, "orders"), [fault], "o_orderkey")
    dirty = dirty.withColumn("o_custkey", F.col("o_custkey").cast("bigint"))
    found = relations.referential_integrity(dirty, "o_custkey", table(spark, sf, "customer"), "c_custkey", "o_orderkey")
    return findings(found, "observed")


@query("unlabelled_documents", f"""
SELECT {s_finding('doc_id', 'doc_id', 'referential_integrity')} FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def unlabelled_documents(spark, sf):
    found = relations.referential_integrity(
        table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), "doc_id", "doc_id"
    )
    return findings(found)


def _outliers(col: str = "value") -> str:
    return s_finding("event_id", col, "statistical_outlier")


@query("outlier_zscore", f"""
WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT {_outliers()} FROM events JOIN s USING (event_type) WHERE abs(value - m) > 3 * sd
""")
def outlier_zscore(spark, sf):
    return findings(statistics.outlier_zscore(table(spark, sf, "events"), "value", "event_type", 3.0, "event_id"))


@query("outlier_iqr", f"""
WITH s AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT {_outliers()} FROM events JOIN s USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)
""")
def outlier_iqr(spark, sf):
    return findings(statistics.outlier_iqr(table(spark, sf, "events"), "value", "event_type", 1.5, "event_id"))


@query("outlier_mad", f"""
WITH s AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1),
d AS (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN s USING (event_type) GROUP BY 1)
SELECT {_outliers()} FROM events JOIN s USING (event_type) JOIN d USING (event_type)
WHERE mad > 0 AND abs(value - m) > 5 * mad
""")
def outlier_mad(spark, sf):
    return findings(statistics.outlier_mad(table(spark, sf, "events"), "value", "event_type", 5.0, "event_id"))


@query("outlier_ratio", f"""
WITH r AS (SELECT {_LINE} AS row_id, l_returnflag AS g, l_extendedprice / l_quantity AS v FROM lineitem WHERE l_quantity <> 0),
s AS (SELECT g, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM r GROUP BY 1)
SELECT {s_finding('row_id', 'l_extendedprice', 'statistical_outlier')} FROM r JOIN s USING (g)
WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)
""")
def outlier_ratio(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return findings(statistics.outlier_ratio(
        lines, F.col("l_extendedprice"), F.col("l_quantity"), "l_extendedprice", "iqr", group="l_returnflag", k=1.5
    ))


@query("quantiles_by_group", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q0, round(quantile_cont(l_extendedprice, 0.5), 4) AS q1,
       round(quantile_cont(l_extendedprice, 0.9), 4) AS q2 FROM lineitem GROUP BY 1
""")
def quantiles_by_group(spark, sf):
    q = statistics.exact_quantiles(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.1, 0.5, 0.9])
    return q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q0", "q1", "q2")])


@query("context_bound", f"""
WITH l AS (SELECT event_type, 1.0 AS lo, round(avg(value) * 4, 2) AS hi FROM events GROUP BY 1)
SELECT {_outliers()} FROM events JOIN l USING (event_type) WHERE value < lo OR value > hi
""")
def context_bound(spark, sf):
    events = table(spark, sf, "events")
    limits = events.groupBy(F.col("event_type").alias("category")).agg(
        F.lit(1.0).alias("lo"), F.round(F.avg("value") * 4, 2).alias("hi")
    )
    return findings(statistics.context_bound(events, "value", "event_type", limits, "event_id"))


@query("context_bound_small", f"""
SELECT {s_finding('p_partkey', 'p_size', 'statistical_outlier')} FROM part
WHERE (p_type = 'ECONOMY' AND p_size > 30) OR (p_type = 'SMALL' AND p_size > 10) OR (p_type = 'LARGE' AND p_size < 20)
""")
def context_bound_small(spark, sf):
    rule = rules.context_bound("p_size", "p_type", {"ECONOMY": (None, 30), "SMALL": (None, 10), "LARGE": (20, None)})
    return findings(rules.run_rules(table(spark, sf, "part"), [rule], "p_partkey"))


# --- all at once --------------------------------------------------------------------------------------------------------

def order_suite():
    return [
        rules.missing_value("o_orderstatus"), rules.wrong_type("o_totalprice", "float"),
        rules.out_of_range("o_totalprice", 1000, 400000), rules.max_decimals("o_totalprice", 2),
        rules.in_set("o_orderpriority", PRIORITIES), rules.date_format("o_orderdate"),
        rules.in_set("o_orderstatus", ["F", "O", "P"]),
    ]


ORDER_FAULTS = [
    Fault("missing_value", "o_orderstatus", rate=0.01), Fault("wrong_type_text", "o_totalprice", rate=0.01),
    Fault("extra_decimal", "o_totalprice", rate=0.01), Fault("typo", "o_orderpriority", rate=0.01),
    Fault("date_us", "o_orderdate", rate=0.01),
]


def dirty_orders(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_totalprice", plain_decimal(F.col("o_totalprice"))).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return contaminate(orders, ORDER_FAULTS, "o_orderkey", "orders")


_K = "o_orderkey"
DIRTY_ORDERS_SQL = f"""
o1 AS (SELECT {_K}, {s_spoilt('o_orderstatus', s_picked(_K, '0:o_orderstatus', 0.01), "''")} AS o_orderstatus,
  {s_spoilt(s_money('o_totalprice'), s_picked(_K, '1:o_totalprice', 0.01), f"{_WORDS}[{s_luck(_K, 'o_totalprice', 1)} % 4 + 1]")} AS p,
  {s_spoilt('o_orderpriority', s_picked(_K, '3:o_orderpriority', 0.01), s_typo('o_orderpriority', _K, 'o_orderpriority', 3))} AS o_orderpriority,
  {s_spoilt(_ISO, s_picked(_K, '4:o_orderdate', 0.01), "strftime(o_orderdate, '%m-%d-%Y')")} AS o_orderdate FROM orders),
dirty AS (SELECT * EXCLUDE (p), {s_spoilt('p', s_picked(_K, '2:o_totalprice', 0.01), "CASE WHEN regexp_matches(p, '^[+-]?[0-9]+[.][0-9]{2}$') THEN p || '9' END")} AS o_totalprice FROM o1),
found AS (
  SELECT {s_finding(_K, 'o_orderstatus', 'missing_value', "'missing_value:o_orderstatus' AS rule_id")} FROM dirty WHERE {s_blank('o_orderstatus')}
  UNION ALL SELECT {s_finding(_K, 'o_totalprice', 'wrong_type', "'wrong_type:o_totalprice'")} FROM dirty WHERE {s_number('o_totalprice')} IS NULL
  UNION ALL SELECT {s_finding(_K, 'o_totalprice', 'out_of_range', "'out_of_range:o_totalprice'")} FROM dirty WHERE {s_number('o_totalprice')} < 1000 OR {s_number('o_totalprice')} > 400000
  UNION ALL SELECT {s_finding(_K, 'o_totalprice', 'format_violation', "'max_decimals:o_totalprice'")} FROM dirty WHERE regexp_matches(o_totalprice, '^[+-]?[0-9]*[.][0-9]{{3,}}$')
  UNION ALL SELECT {s_finding(_K, 'o_orderpriority', 'format_violation', "'in_set:o_orderpriority'")} FROM dirty WHERE trim(o_orderpriority) NOT IN ({_quoted(PRIORITIES)})
  UNION ALL SELECT {s_finding(_K, 'o_orderdate', 'format_violation', "'date_format:o_orderdate'")} FROM dirty WHERE NOT regexp_matches(o_orderdate, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
  UNION ALL SELECT {s_finding(_K, 'o_orderstatus', 'format_violation', "'in_set:o_orderstatus'")} FROM dirty WHERE NOT {s_blank('o_orderstatus')} AND o_orderstatus NOT IN ('F', 'O', 'P'))
"""


@query("suite_findings", f"WITH {DIRTY_ORDERS_SQL} SELECT * FROM found")
def suite_findings(spark, sf):
    """Seven rules, one scan."""
    dirty, _ = dirty_orders(spark, sf)
    return findings(rules.run_rules(dirty, order_suite(), "o_orderkey", "orders"), "rule_id")


