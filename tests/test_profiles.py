"""Profiles merged from parts against the whole, what is kept on disk, and drift between parts."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import profiles

SCHEMA = "part string, v double, t string"


def made(n=4000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        v = None if i % 17 == 0 else round(rng.lognormvariate(3, 1), 3)
        rows.append((rng.choice(["a", "b", "b", "b", "007"]), v, rng.choice(["", " ", None, "12", f"x{i % 900}"])))
    return rows


def test_merged_equals_whole(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_rows", F.lit("clash")).repartition(5)
    parts = profiles.profile_states(df, ["v", "t"], F.col("part"))
    assert parts.count() == 6
    merged = {r.col: r for r in profiles.read_states(profiles.merge_states(parts)).collect()}
    whole = {r.col: r for r in profiles.read_states(profiles.profile_states(df, ["v", "t"], F.lit("all"))).collect()}
    values = sorted(v for _, v, _ in rows if v is not None)
    mean = math.fsum(values) / len(values)
    sd = math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1))
    m = merged["v"]
    assert (m.n_rows, m.n_missing, m.n_numbers, m.low, m.high) == (len(rows), len(rows) - len(values), len(values), values[0], values[-1])
    assert m.mean == pytest.approx(mean, rel=1e-12) and m.sd == pytest.approx(sd, rel=1e-9)
    for col in ("v", "t"):
        for name in ("n_rows", "n_missing", "n_numbers", "low", "high", "mean", "sd"):
            assert merged[col][name] == whole[col][name]
    for share, estimate in zip(profiles.SHARES, m.quantiles):
        assert abs(bisect.bisect_right(values, estimate) / len(values) - share) <= profiles.RANK_ERROR
    texts = [t for _, _, t in rows if t and t.strip()]
    assert merged["t"].n_missing == len(rows) - len(texts) and merged["t"].n_numbers == texts.count("12")
    for col, n in (("v", len(set(values))), ("t", len(set(texts)))):
        assert abs(merged[col].n_distinct / n - 1) <= profiles.DISTINCT_ERROR


def test_merging_by_key_and_twice(spark):
    df = spark.createDataFrame(made(600), SCHEMA)
    parts = profiles.profile_states(df, ["v"], F.col("part")).withColumn("numbered", F.col("part") == "007")
    once = profiles.merge_states(parts)
    twice = profiles.merge_states(profiles.merge_states(parts, "numbered"))
    pick = lambda s: [tuple(r) for r in s.select("col", *profiles.STATE[:7]).collect()]
    assert pick(once) == pick(twice)


def test_stored_parts_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "states")
    df = spark.createDataFrame(made(500) + [(None, 1.0, "n")], SCHEMA)
    profiles.store_states(profiles.profile_states(df, ["v", "t"], F.col("part")), path)
    before = {(r.part, r.col): r.n_rows for r in profiles.stored_states(spark, path).collect()}
    assert {p for p, _ in before} == {"a", "b", "007", None}
    again = profiles.profile_states(df.where("part = 'b'").limit(7), ["v", "t"], F.col("part"))
    for _ in range(2):
        profiles.store_states(again, path)
    after = {(r.part, r.col): r.n_rows for r in profiles.stored_states(spark, path).collect()}
    assert after == before | {("b", "v"): 7, ("b", "t"): 7}
    assert profiles.read_states(profiles.merge_states(profiles.stored_states(spark, path))).count() == 2


def test_no_numbers_no_rows_and_numbers_too_large(spark):
    odd = [("a", None, None), ("a", float("nan"), ""), ("a", float("inf"), "nan"), ("b", 1e300, "1e400"), ("b", 2.0, "3")]
    df = spark.createDataFrame(odd, SCHEMA)
    states = profiles.profile_states(df, ["v", "t"], F.col("part"))
    got = {(r.part, r.col): r for r in profiles.read_states(states).collect()}
    none = got["a", "v"]
    assert (none.n_rows, none.n_missing, none.n_numbers, none.mean, none.sd, none.quantiles, none.low) == (3, 1, 0, None, None, None, None)
    assert (got["b", "v"].n_numbers, got["b", "v"].mean, got["b", "v"].high) == (2, None, 1e300)
    merged = {r.col: r for r in profiles.read_states(profiles.merge_states(states)).collect()}
    assert (merged["v"].n_rows, merged["v"].mean, merged["v"].low) == (5, None, 2.0)
    empty = profiles.profile_states(df.limit(0), ["v"], F.col("part"))
    assert empty.count() == 0 and profiles.merge_states(empty).count() == 0 and profiles.drifted(empty).count() == 0


def test_drift(spark):
    rows = [(f"d{d}", 10.0 + (i % 5), str(i)) for d in range(5) for i in range(100)]
    rows += [("d5", 14.0 + (i % 5), str(i)) for i in range(100)]
    rows += [("d6", 10.0 + (i % 5), None if i < 30 else str(i)) for i in range(100)]
    rows += [("d7", 10.0 + (i % 5), str(i)) for i in range(40)]
    states = profiles.profile_states(spark.createDataFrame(rows, SCHEMA), ["v", "t"], F.col("part"))
    got = {(r.part, r.col, r.measure) for r in profiles.drifted(states).collect()}
    assert got - {("d6", "t", "mean")} == {("d5", "v", "mean"), ("d6", "v", "mean"), ("d6", "t", "missing"), ("d7", "v", "rows"), ("d7", "t", "rows"), ("d7", "t", "mean")}


def test_plan_has_one_scan_and_no_python(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(made(50), SCHEMA).write.parquet(path)
    plan = profiles.profile_states(spark.read.parquet(path), ["v", "t"], F.col("part"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("Exchange hashpartitioning") == 1 and "PythonUDF" not in plan
    assert "partial_kll_sketch_agg_double" in plan and plan.count("RLIKE") == 2  # a text is read as a number once
