"""Catalogue: row addresses, cell lookups and the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import plain_decimal
from ..operators.contaminate import Fault, contaminate
from ..session import fresh_path
from ..sources import attach_clean_values, cell_value, read_submissions, read_table, with_row_id, write_table
from .base import query, s_money, s_picked, table


@query("row_addresses", """
SELECT 'orders' AS source, count(*) AS n_rows, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, count(*) AS n_distinct FROM orders
UNION ALL SELECT 'lineitem', count(*), 1, count(*), count(*) FROM lineitem
""")
def row_addresses(spark, sf):
    """Rows numbered from 1 without gaps or repeats, with no sort and no shuffle of the rows."""
    made = None
    for name in ("orders", "lineitem"):
        ids = with_row_id(table(spark, sf, name).select(table(spark, sf, name).columns[0])).groupBy("row_id").count()
        part = ids.agg(
            F.sum("count").alias("n_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"),
            F.count(F.lit(1)).alias("n_distinct"),
        ).select(F.lit(name).alias("source"), "*")
        made = part if made is None else made.unionByName(part)
    return made


@query("cell_values", """
WITH c AS (SELECT event_id, user_id AS row_id, CASE event_type WHEN 'click' THEN ' C_Name' WHEN 'view' THEN 'c_acctbal' WHEN 'error' THEN 'no_such' ELSE 'C_MKTSEGMENT' END AS col FROM events)
SELECT event_id, CAST(c.row_id AS BIGINT) AS row_id, CASE lower(trim(col)) WHEN 'c_name' THEN trim(c_name) WHEN 'c_acctbal' THEN CAST(CAST(c_acctbal AS DECIMAL(38,2)) AS VARCHAR) WHEN 'c_mktsegment' THEN trim(c_mktsegment) END AS value
FROM c LEFT JOIN customer ON c_custkey = c.row_id
""")
def cell_values(spark, sf):
    """Look up one customer cell per event; unknown columns and rows give NULL."""
    name = F.when(F.col("event_type") == "click", " C_Name").when(F.col("event_type") == "view", "c_acctbal").when(
        F.col("event_type") == "error", "no_such").otherwise("C_MKTSEGMENT")
    cells = table(spark, sf, "events").select("event_id", F.col("user_id").cast("bigint").alias("row_id"), name.alias("col"))
    customers = table(spark, sf, "customer").withColumn("c_acctbal", plain_decimal(F.col("c_acctbal")))
    found = cell_value(customers, cells, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])
    return found.select("event_id", "row_id", "value")


@query("attach_clean_values", f"""
SELECT CAST(o_orderkey AS BIGINT) AS row_id, 'o_totalprice' AS col, {s_money('o_totalprice')} AS clean_value FROM orders
WHERE {s_picked('o_orderkey', '0:o_totalprice', 0.05)}
""")
def clean_values(spark, sf):
    """A truth table without clean values gets them from the clean table."""
    orders = table(spark, sf, "orders").withColumn("o_totalprice", plain_decimal(F.col("o_totalprice")))
    _, truth = contaminate(orders, [Fault("wrong_type_text", "o_totalprice", rate=0.05)], "o_orderkey")
    bare = truth.withColumn("clean_value", F.lit(None).cast("string"))
    return attach_clean_values(bare, orders, "o_orderkey", ["o_totalprice"]).select("row_id", "col", "clean_value")


@query("csv_round_trip", f"""
SELECT doc_id, lang, CASE WHEN {s_picked('doc_id', '0:source', 0.1)} THEN NULL ELSE source END AS source, '{{"n": "' || n_chars || ', chars"}}' AS note FROM documents
""")
def csv_round_trip(spark, sf):
    """Text with quotes and commas, and empty cells, written as CSV and read back."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id"), "lang", "source", F.concat(F.lit('{"n": "'), F.col("n_chars").cast("string"), F.lit(', chars"}')).alias("note")
    )
    dirty, _ = contaminate(docs, [Fault("missing_value", "source", rate=0.1)], "doc_id")
    path = fresh_path(spark, "csv")
    write_table(dirty, path, "csv")
    back = read_table(spark, path, "csv")
    return back.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("submission_records", """
SELECT CAST(user_id AS VARCHAR) AS episode_id, CAST(event_id AS INTEGER) AS step, CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS n_fixes FROM events
""")
def submission_records(spark, sf):
    """Submissions written as JSON records, some without fixes, and read with a declared schema."""
    made = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").cast("int").alias("step"), F.lit("d").alias("dataset"),
        F.array(F.concat(F.lit("row:"), F.col("user_id").cast("string"), F.lit(",col:a,issue:missing_value"))).alias("issues"),
        F.when(F.col("event_type") == "click", F.array(F.lit("row:1,col:a,fix:b"))).alias("fixes"),
    )
    path = fresh_path(spark, "submissions")
    write_table(made, path, "json")
    return read_submissions(spark, path).select("episode_id", "step", F.size("fixes").cast("bigint").alias("n_fixes"))
