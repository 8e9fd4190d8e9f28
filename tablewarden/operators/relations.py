"""Checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .keyed import to_findings
from .skew import lookup_join


def referential_integrity(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """Child rows whose key has no parent; blank keys are left to the missing-value check.

    The distinct keys are tested, not the rows, so a key that very many rows share is tested once.
    """
    rows = child.where(~is_blank(F.col(fk).cast("string"))).select(
        F.col(row_id).cast("bigint").alias("row_id"), F.col(fk).alias("__k")
    )
    used = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(pk).alias("__k")).where("__k IS NOT NULL").distinct()
    orphans = used.join(known, "__k", "left_anti")
    found = lookup_join(rows, orphans, ["__k"], "row_id", "inner")
    return to_findings(found, dataset, fk, "referential_integrity", f"referential_integrity:{fk}", F.col("__k"))


def aggregate_match(
    parent: DataFrame, pk: str, total: str, child: DataFrame, fk: str, amount: Column, tolerance: float = 0.01,
    dataset: str = "data",
) -> DataFrame:
    """Parents whose total is not the sum over their children, or that have no children but a total.

    Child amounts are summed as exact decimals, so the result does not depend on the order of the rows.
    """
    sums = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__k")).agg(
        F.sum(amount.cast("decimal(28,6)")).cast("double").alias("__sum")
    )
    joined = parent.select(F.col(pk).alias("__k"), F.col(total).cast("double").alias("__total")).join(
        sums, "__k", "left"
    ).withColumn("__sum", F.coalesce("__sum", F.lit(0.0))).withColumn("row_id", F.col("__k").cast("bigint"))
    found = joined.where(F.abs(F.col("__total") - F.col("__sum")) > F.lit(tolerance))
    return to_findings(found, dataset, total, "inconsistent_value", f"aggregate_match:{total}",
                       F.col("__total"), F.round(F.col("__sum"), 2))
