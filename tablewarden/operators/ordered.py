"""Checks that compare a row with its predecessor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import first_of_copies, to_findings
from .skew import carry


def chronological(
    df: DataFrame, ts: str, order_by: str, row_id: str = "row_id", partition_by: list[str] | None = None,
    dataset: str = "data",
) -> DataFrame:
    """Rows whose time lies before that of the row ahead of them; only the later row is reported.

    Unreadable or missing times are stepped over.
    """
    keys = list(partition_by or [])
    narrow = df.where(F.col(ts).isNotNull() & F.col(order_by).isNotNull()).select(
        *dict.fromkeys([*keys, order_by, row_id, ts])
    )
    scanned = carry(narrow, ts, order_by, row_id, keys, "last", "previous")
    late = scanned.where(F.col(ts) < F.col("previous")).withColumn("row_id", F.col(row_id).cast("bigint"))
    return to_findings(late, dataset, ts, "inconsistent_value", f"chronological:{ts}", F.col(ts), F.col("previous"))


def id_profile(df: DataFrame, col: str) -> DataFrame:
    """Bounds and counts of an id column, and how many ids are missing or repeated."""
    per_id = df.groupBy(F.col(col).try_cast("bigint").alias("id")).count().where("id IS NOT NULL")
    return per_id.agg(
        F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.sum("count").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
    ).select(
        "*", (F.col("n_rows") - F.col("n_distinct")).alias("n_repeated"),
        (F.col("max_id") - F.col("min_id") + 1 - F.col("n_distinct")).alias("n_missing"),
    )


def sequential_id(
    df: DataFrame, col: str, row_id: str = "row_id", start: int | None = 1, dataset: str = "data"
) -> DataFrame:
    """Ids that repeat or whose predecessor is absent.

    Every id votes for itself and for its successor, so one grouped count finds the gaps without an ordered scan.
    ``start`` is the id that needs no predecessor (``None``: the smallest one present).  Cells that are no whole number take
    no part; the type check reports them.
    """
    ids = df.select(
        F.col(row_id).cast("bigint").alias("row_id"), F.col(col).try_cast("bigint").alias("id")
    ).where("id IS NOT NULL")
    per_id = ids.groupBy("id").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))
    votes = per_id.select(
        F.explode(F.array(
            F.struct(F.col("id").alias("at"), F.col("row_id").alias("own"), F.lit(False).alias("led")),
            F.struct((F.col("id") + 1).alias("at"), F.lit(None).cast("bigint").alias("own"), F.lit(True).alias("led")),
        )).alias("v")
    ).select("v.*")
    seen = votes.groupBy("at").agg(F.max("own").alias("row_id"), F.bool_or("led").alias("led"))
    gaps = seen.where("row_id IS NOT NULL AND NOT led")
    if start is None:
        start = ids.agg(F.min("id")).first()[0]
    gaps = gaps.where(F.col("at") != F.lit(start))
    repeats = first_of_copies(ids, F.col("id"), "row_id")
    return to_findings(
        gaps, dataset, col, "inconsistent_value", f"sequential_id:gap:{col}", F.col("at"), F.col("at") - 1
    ).unionByName(
        to_findings(repeats, dataset, col, "duplicate_row", f"sequential_id:repeat:{col}", None, F.col("first_id"))
    )
