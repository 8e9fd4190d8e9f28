"""Shared pieces of the query catalogue: table access, and the SQL twins of the column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import FINITE

Query = Callable[[SparkSession, str], DataFrame]
# Tables whose rows are dear to process: texts and records that are parsed.
SPREAD = {"documents", "pages", "conversations", "events"}
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL another engine can check it by."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table.  One that comes in fewer pieces than there are cores is spread over them first; a large one is
    read as it is stored."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if name in SPREAD:
        cores = spark.sparkContext.defaultParallelism
        if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores:
            return df.repartition(cores)
    return df


def findings(df: DataFrame, *extra: str) -> DataFrame:
    """The stable part of a findings table."""
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), "col", "issue_type", *extra)


# --- SQL twins ------------------------------------------------------------------------------------------------------

def s_draw(row: str, label: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:{label}:' || CAST({row} AS VARCHAR)), 1, 8) AS BIGINT)"


def s_picked(row: str, label: str, rate: float, seed: int = 42) -> str:
    return f"({s_draw(row, label, seed)} < {int(rate * 2**32)})"


def s_blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '\\S'))"


def s_number(c: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({c}), '{FINITE}') THEN TRY_CAST(replace(trim({c}), '_', '') AS DOUBLE) END)"


def s_money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(38,2)) AS VARCHAR)"


def s_luck(row: str, col: str, fault: int = 0, seed: int = 42) -> str:
    return s_draw(row, f"value:{fault}:{col}", seed)


def s_typo(c: str, row: str, col: str, fault: int = 0) -> str:
    luck = s_luck(row, col, fault)
    at = f"({luck} % greatest(length({c}) - 1, 1) + 1)"
    a, b = f"substr({c}, {at}, 1)", f"substr({c}, {at} + 1, 1)"
    made = (
        f"CASE WHEN {luck} // 65536 % 3 = 0 THEN {b} WHEN {luck} // 65536 % 3 = 1 OR {a} = {b} THEN {a} || {a} || {b} "
        f"ELSE {b} || {a} END"
    )
    return f"(CASE WHEN length({c}) >= 2 THEN substr({c}, 1, {at} - 1) || {made} || substr({c}, {at} + 2) END)"


def s_spoilt(c: str, chosen: str, new: str) -> str:
    """A cell after one fault; where the rule cannot apply the cell stays."""
    return f"coalesce(CASE WHEN {chosen} THEN {new} END, {c})"


def s_finding(row: str, col: str, issue_type: str, extra: str = "") -> str:
    return f"CAST({row} AS BIGINT) AS row_id, '{col}' AS col, '{issue_type}' AS issue_type{', ' + extra if extra else ''}"
