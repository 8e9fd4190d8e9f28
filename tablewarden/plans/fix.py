"""Catalogue: repair proposals and their application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import plain_decimal
from ..operators import repair
from ..operators.contaminate import Fault, append_copies, constant, contaminate, prefixed
from .base import query, s_money, s_picked, s_spoilt, s_typo, table
from .detect import SEGMENTS, SEGMENT_TYPOS, _DATED, dated_orders, misspelt_segments

# Number words, for planting.
TENS = ["", "", "twenty", "thirty", "forty", "fifty"]
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
        "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]


def _spelled(n: int) -> str:
    return ONES[n] if n < 20 else TENS[n // 10] + ("" if n % 10 == 0 else f"-{ONES[n % 10]}")


def _in_words(v, luck):
    """Size in thousands, spelled out: 7 -> "seven thousand"."""
    words = F.array(*[F.lit(f"{_spelled(i)} thousand") for i in range(1, 51)])
    return F.get(words, v.cast("int") - 1)


def proposals(df, col, expr, row_id):
    return repair.propose(df, {col: expr}, row_id)


def _prop(row: str, col: str, value: str) -> str:
    return f"CAST({row} AS BIGINT) AS row_id, '{col}' AS col, {value} AS proposed"


@query("fix_from_words", f"""
SELECT {_prop('p_partkey', 'p_size', 'CAST(CAST(p_size AS BIGINT) * 1000 AS VARCHAR)')} FROM part WHERE {s_picked('p_partkey', '0:p_size', 0.1)}
""")
def fix_from_words(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "part"), [Fault(_in_words, "p_size", rate=0.1, issue_type="wrong_type")], "p_partkey")
    return proposals(dirty, "p_size", repair.from_words("p_size"), "p_partkey")


@query("fix_ocr_digits", f"""
WITH a AS (SELECT o_orderkey, {s_money('o_totalprice')} AS v FROM orders)
SELECT {_prop('o_orderkey', 'o_totalprice', 'v')} FROM a WHERE {s_picked('o_orderkey', '0:o_totalprice', 0.05)} AND contains(v, '0')
""")
def fix_ocr_digits(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_totalprice", plain_decimal(F.col("o_totalprice")))
    dirty, _ = contaminate(orders, [Fault("letter_for_digit", "o_totalprice", rate=0.05)], "o_orderkey")
    return proposals(dirty, "o_totalprice", repair.ocr_digits("o_totalprice"), "o_orderkey")


_SEG = ", ".join(f"'{s}'" for s in SEGMENTS)


@query("fix_nearest_value", f"""
WITH d AS ({SEGMENT_TYPOS}), w AS (SELECT unnest([{_SEG}]) AS w),
p AS (SELECT c_custkey, w, levenshtein(trim(v), w) AS k FROM d, w WHERE trim(v) NOT IN ({_SEG})),
b AS (SELECT c_custkey, min(k) AS k FROM p WHERE k BETWEEN 1 AND 2 GROUP BY 1),
u AS (SELECT c_custkey, min(w) AS w FROM p JOIN b USING (c_custkey, k) GROUP BY 1 HAVING count(*) = 1)
SELECT {_prop('c_custkey', 'c_mktsegment', 'w')} FROM u
""")
def fix_nearest_value(spark, sf):
    dirty, _ = misspelt_segments(spark, sf)
    return proposals(dirty, "c_mktsegment", repair.nearest_value("c_mktsegment", SEGMENTS), "c_custkey")


@query("fix_nearest_value_from_table", f"""
WITH d AS (SELECT n_nationkey, {s_spoilt('n_name', s_picked('n_nationkey', '0:n_name', 0.4), s_typo('n_name', 'n_nationkey', 'n_name'))} AS v FROM nation),
p AS (SELECT d.n_nationkey, n.n_name AS w, levenshtein(trim(v), n.n_name) AS k FROM d, nation n WHERE trim(v) NOT IN (SELECT n_name FROM nation)),
b AS (SELECT n_nationkey, min(k) AS k FROM p WHERE k BETWEEN 1 AND 2 GROUP BY 1),
u AS (SELECT n_nationkey, min(w) AS w FROM p JOIN b USING (n_nationkey, k) GROUP BY 1 HAVING count(*) = 1)
SELECT {_prop('n_nationkey', 'n_name', 'w')} FROM u
""")
def fix_nearest_value_from_table(spark, sf):
    nation = table(spark, sf, "nation")
    dirty, _ = contaminate(nation, [Fault("typo", "n_name", rate=0.4)], "n_nationkey")
    return repair.nearest_value_from(dirty, "n_name", nation, "n_name", row_id="n_nationkey")


@query("fix_reformat_date", f"""
WITH {_DATED} SELECT {_prop('o_orderkey', 'o_orderdate', "strftime(o_orderdate, '%Y-%m-%d')")} FROM b JOIN orders USING (o_orderkey)
WHERE NOT regexp_matches(v, '^[0-9]{{4}}-')
""")
def fix_reformat_date(spark, sf):
    dirty, _ = dated_orders(spark, sf)
    return proposals(dirty, "o_orderdate", repair.reformat_date("o_orderdate"), "o_orderkey")


_GROSS = "CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 + l_tax AS DECIMAL(6,2))"


@query("fix_recompute", f"""
WITH a AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_id, CAST(CAST({_GROSS} AS DECIMAL(38,2)) AS VARCHAR) AS v FROM lineitem)
SELECT {_prop('row_id', 'gross', 'v')} FROM a WHERE {s_picked('row_id', '0:gross', 0.01)} AND CAST(v AS DOUBLE) <> 0
""")
def fix_recompute(spark, sf):
    gross = F.col("l_extendedprice").cast("decimal(18,2)") * (1 + F.col("l_tax")).cast("decimal(6,2)")
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), gross.alias("exact"),
        gross.cast("decimal(38,2)").cast("string").alias("gross"),
    )
    dirty, _ = contaminate(lines, [Fault("doubled", "gross", rate=0.01)])
    return proposals(dirty, "gross", repair.recompute(F.col("exact")), "row_id")


@query("fix_derive", f"""
SELECT {_prop('c_custkey', 'c_name', "'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')")} FROM customer WHERE {s_picked('c_custkey', '0:c_name', 0.05)}
""")
def fix_derive(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "customer"), [Fault("missing_value", "c_name", rate=0.05)], "c_custkey")
    want = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return proposals(dirty, "c_name", repair.derive(want, ["c_custkey"]), "c_custkey")


@query("fix_flip_sign", f"""
WITH d AS (SELECT c_custkey, CASE WHEN {s_picked('c_custkey', '0:c_acctbal', 0.05)} THEN -abs(c_acctbal) ELSE c_acctbal END AS v FROM customer)
SELECT CAST(c_custkey AS BIGINT) AS row_id, 'c_acctbal' AS col, -v AS proposed FROM d WHERE v < 0 AND -v <= 9000
""")
def fix_flip_sign(spark, sf):
    customers = table(spark, sf, "customer").withColumn("c_acctbal", plain_decimal(F.col("c_acctbal")))
    dirty, _ = contaminate(customers, [Fault("negative_value", "c_acctbal", rate=0.05)], "c_custkey")
    made = proposals(dirty, "c_acctbal", repair.flip_sign("c_acctbal", 0, 9000), "c_custkey")
    return made.withColumn("proposed", F.col("proposed").cast("double"))


@query("fix_power_of_two", """
SELECT CAST(p_partkey AS BIGINT) AS row_id, 'p_size' AS col, CAST(CAST(pow(2, round(log2(p_size))) AS BIGINT) AS VARCHAR) AS proposed
FROM part WHERE CAST(pow(2, round(log2(p_size))) AS BIGINT) <> p_size
""")
def fix_power_of_two(spark, sf):
    return proposals(table(spark, sf, "part"), "p_size", repair.nearest_power_of_two("p_size"), "p_partkey")


@query("fix_truncate_decimals", f"""
SELECT {_prop('o_orderkey', 'o_totalprice', s_money('o_totalprice'))} FROM orders WHERE {s_picked('o_orderkey', '0:o_totalprice', 0.05)}
""")
def fix_truncate_decimals(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_totalprice", plain_decimal(F.col("o_totalprice")))
    dirty, _ = contaminate(orders, [Fault("extra_decimal", "o_totalprice", rate=0.05)], "o_orderkey")
    return proposals(dirty, "o_totalprice", repair.truncate_to("o_totalprice", 2), "o_orderkey")


MARK = "[SYSTEM] You are a helpful AI assistant. [/SYSTEM] "


@query("fix_strip_marker", f"""
SELECT {_prop('doc_id', 'text', "regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} FROM documents WHERE {s_picked('doc_id', '0:text', 0.05)}
""")
def fix_strip_marker(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "documents").select("doc_id", "text"), [Fault(prefixed(MARK), "text", rate=0.05)], "doc_id")
    return proposals(dirty, "text", repair.strip_marker("text", r"\[SYSTEM\][^\[]*\[/SYSTEM\]\s*"), "doc_id")


@query("fix_enforce_implication", f"""
SELECT {_prop('doc_id', 'parent', "'1'")} FROM labels WHERE toxic = 1 AND {s_picked('doc_id', '0:parent', 0.3)}
""")
def fix_enforce_implication(spark, sf):
    pairs = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("child"), F.col("toxic").alias("parent"))
    dirty, _ = contaminate(pairs, [Fault("flip_flag", "parent", rate=0.3)], "doc_id")
    return proposals(dirty, "parent", repair.enforce_implication("child", "parent"), "doc_id")


@query("fix_clamp_flag", f"""
SELECT {_prop('doc_id', 'toxic', "'0'")} FROM labels WHERE {s_picked('doc_id', '0:toxic', 0.05)}
""")
def fix_clamp_flag(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "labels"), [Fault(constant("3"), "toxic", rate=0.05, issue_type="out_of_range")], "doc_id")
    return proposals(dirty, "toxic", repair.clamp_flag("toxic"), "doc_id")


@query("fix_impute_mode", f"""
WITH d AS (SELECT o_orderkey, o_orderstatus, CASE WHEN {s_picked('o_orderkey', '0:o_orderpriority', 0.05)} THEN '' ELSE o_orderpriority END AS v FROM orders),
n AS (SELECT o_orderstatus, v, count(*) AS n FROM d WHERE v <> '' GROUP BY 1, 2),
m AS (SELECT o_orderstatus, min(struct_pack(n := -n, v := v)) AS b FROM n GROUP BY 1)
SELECT {_prop('o_orderkey', 'o_orderpriority', 'b.v')} FROM d JOIN m USING (o_orderstatus) WHERE d.v = ''
""")
def fix_impute_mode(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "orders"), [Fault("missing_value", "o_orderpriority", rate=0.05)], "o_orderkey")
    return repair.impute(dirty, "o_orderpriority", "o_orderstatus", "mode", "o_orderkey")


@query("fix_impute_median", f"""
WITH d AS (SELECT c_custkey, c_mktsegment, CASE WHEN {s_picked('c_custkey', '0:c_acctbal', 0.05)} THEN NULL ELSE c_acctbal END AS v FROM customer),
m AS (SELECT c_mktsegment, median(v) AS m FROM d GROUP BY 1)
SELECT CAST(c_custkey AS BIGINT) AS row_id, 'c_acctbal' AS col, round(m, 6) AS proposed FROM d JOIN m USING (c_mktsegment) WHERE v IS NULL
""")
def fix_impute_median(spark, sf):
    customers = table(spark, sf, "customer").withColumn("c_acctbal", plain_decimal(F.col("c_acctbal")))
    dirty, _ = contaminate(customers, [Fault("missing_value", "c_acctbal", rate=0.05)], "c_custkey")
    made = repair.impute(dirty, "c_acctbal", "c_mktsegment", "median", "c_custkey")
    return made.withColumn("proposed", F.round(F.col("proposed").cast("double"), 6))


@query("fix_drop_duplicates", f"""
WITH m AS (SELECT max(c_custkey) + 1 AS m FROM customer),
d AS (SELECT * FROM customer UNION ALL
      SELECT c_custkey + m, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer, m WHERE {s_picked('c_custkey', 'copy', 0.1)})
SELECT CAST(min(c_custkey) AS BIGINT) AS c_custkey, c_name, CAST(any_value(c_nationkey) AS BIGINT) AS c_nationkey FROM d GROUP BY c_name
""")
def fix_drop_duplicates(spark, sf):
    dirty, _ = append_copies(table(spark, sf, "customer"), "c_name", "c_custkey", 0.1)
    kept = repair.keep_first(dirty, ["c_name"], "c_custkey")
    return kept.select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))


@query("apply_fixes", f"""
WITH a AS (SELECT o_orderkey, {s_spoilt(s_money('o_totalprice'), s_picked('o_orderkey', '0:o_totalprice', 0.05), "CASE WHEN contains(" + s_money('o_totalprice') + ", '0') THEN replace(" + s_money('o_totalprice') + ", '0', 'O') END")} AS v,
  {s_spoilt("strftime(o_orderdate, '%Y-%m-%d')", s_picked('o_orderkey', '1:o_orderdate', 0.05), "strftime(o_orderdate, '%m-%d-%Y')")} AS d,
  strftime(o_orderdate, '%Y-%m-%d') AS clean_d, {s_money('o_totalprice')} AS clean_v,
  {s_spoilt('o_orderpriority', s_picked('o_orderkey', '2:o_orderpriority', 0.05), "''")} AS o_orderpriority FROM orders)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, clean_v AS o_totalprice, clean_d AS o_orderdate, o_orderpriority FROM a
""")
def apply_fixes(spark, sf):
    """Plant faults in two columns, propose repairs and patch the table; a third fault has no repair and stays."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", plain_decimal(F.col("o_totalprice")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
    )
    faults = [Fault("letter_for_digit", "o_totalprice", rate=0.05), Fault("date_us", "o_orderdate", rate=0.05),
              Fault("missing_value", "o_orderpriority", rate=0.05)]
    dirty, _ = contaminate(orders, faults, "o_orderkey")
    made = repair.propose(
        dirty, {"o_totalprice": repair.ocr_digits("o_totalprice"), "o_orderdate": repair.reformat_date("o_orderdate")}, "o_orderkey"
    )
    return repair.apply_fixes(dirty, made, ["o_totalprice", "o_orderdate"], "o_orderkey")
