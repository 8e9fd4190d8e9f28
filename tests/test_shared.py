"""Keyed checks in one pass against the same checks one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import keyed, shared
from tablewarden.operators.skew import digest

SCHEMA = "row_id long, k string, prompt string, reply string, good int, value string, key string"


def made(n=600):
    rng = random.Random(11)
    texts = ["Hot reply"] * 8 + ["hot, REPLY!", "", "  ", None, "a b", "a  b", "A-B", "long " * 50]
    return [
        (i if i != 40 else 7, rng.choice(["", None, "x", "y", "z"]), rng.choice(["p", "q", None]), rng.choice(texts),
         rng.choice([0, 1, None]), "clash", "clash") for i in rng.sample(range(n), n)
    ]


def checks():
    return [
        shared.duplicate_row("reply", ["k", "prompt", "reply", "good"]), shared.duplicate_key(["k", "good"]), shared.duplicate_key(["k"], "reply"),
        shared.duplicate_text("reply"), shared.duplicate_text("reply", True, "inconsistent_value"), shared.copied_response("prompt", "reply"),
        *shared.label_conflict(F.col("reply"), ["good", "k"]),
    ]


def one_by_one(df):
    parts = [
        keyed.duplicate_row(df, "reply", cols=["k", "prompt", "reply", "good"]), keyed.duplicate_key(df, ["k", "good"]),
        keyed.duplicate_key(df, ["k"], report_col="reply"), keyed.duplicate_text(df, "reply"),
        keyed.duplicate_text(df, "reply", normalise=True, issue_type="inconsistent_value"), keyed.copied_response(df, "prompt", "reply"),
        keyed.label_conflict(df, F.when(F.col("reply").isNotNull(), digest(F.col("reply"))), ["good", "k"]),
    ]
    return sorted((repr(tuple(r)) for p in parts for r in p.collect()))


def test_findings_equal_the_single_checks(spark):
    df = spark.createDataFrame(made(), SCHEMA).repartition(5)
    got = shared.run_keyed(df, checks())
    assert got.columns == keyed.duplicate_text(df, "reply").columns
    rows = sorted(repr(tuple(r)) for r in got.collect())
    assert rows == one_by_one(df) and len(rows) > 1000


def test_findings_equal_without_broadcast(no_broadcast):
    df = no_broadcast.createDataFrame(made(300), SCHEMA).repartition(3)
    assert sorted(repr(tuple(r)) for r in shared.run_keyed(df, checks()).collect()) == one_by_one(df)


def test_empty_table_rows_without_id_and_no_checks(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shared.run_keyed(empty, checks()).count() == 0
    with pytest.raises(ValueError):
        shared.run_keyed(empty, [])
    df = spark.createDataFrame([(None, "x", "p", "r", 1, "", ""), (5, "x", "q", "r", 0, "", ""), (6, "x", "p", "r", 0, "", "")], SCHEMA)
    got = {(r.row_id, r.rule_id, r.col, r.observed, r.expected) for r in shared.run_keyed(df, checks()).collect()}
    assert {r for r in got if r[1] == "label_conflict"} == {(5, "label_conflict", "good", "0", None), (6, "label_conflict", "good", "0", None)}
    assert (6, "copied_response", "reply", None, "5") in got and all(r[0] for r in got)


def test_groups_take_one_exchange(spark):
    df = spark.createDataFrame(made(100), SCHEMA)
    plan = shared.run_keyed(df, checks())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 2 and "Python" not in plan
