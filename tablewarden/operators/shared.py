"""Several checks over groups of equal rows in one pass.

Each check of :mod:`keyed` scans and shuffles the table for itself.  Here every row is expanded to one short row per check -- number of
the check, 256-bit key, row id, value -- and these are stored once; one aggregate over (check, key) finds what all checks need to know
of their groups, and only groups with something to report are joined back.  The findings are those of the single checks together.  A
check costs about 60 bytes a row, whatever the width of the table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import cut_lineage
from .keyed import normal_text
from .skew import digest, lookup_join

COPY, COPIED, CONFLICT = "copy", "copied", "conflict"


@dataclass(frozen=True)
class KeyedCheck:
    """Rows with one ``key`` form a group; rows where it is NULL take no part.

    ``kind`` says what is found: ``copy``, rows after the first; ``copied``, later rows whose ``value`` is not the first row's;
    ``conflict``, all rows of a group with several values, with their values as observed.
    """

    rule_id: str
    col: str
    issue_type: str
    kind: str
    key: Column
    value: Column | None = None


def _key(given: Column, *cols: Column) -> Column:
    return F.when(given, F.unhex(digest(*cols)))


def duplicate_row(report_col: str, cols: Iterable[str]) -> KeyedCheck:
    return KeyedCheck("duplicate_row", report_col, "duplicate_row", COPY, _key(F.lit(True), *[F.col(c) for c in cols]))


def duplicate_key(keys: list[str], report_col: str | None = None) -> KeyedCheck:
    """Keys are compared as texts, so 0.0 and -0.0 differ here."""
    given = F.lit(True)
    for k in keys:
        given = given & ~is_blank(F.col(k).cast("string"))
    return KeyedCheck(f"duplicate_key:{','.join(keys)}", report_col or keys[0], "duplicate_row", COPY, _key(given, *[F.col(k) for k in keys]))


def duplicate_text(col: str, normalise: bool = False, issue_type: str = "duplicate_row") -> KeyedCheck:
    text = normal_text(F.col(col)) if normalise else F.col(col)
    return KeyedCheck(f"duplicate_text:{col}", col, issue_type, COPY, _key(~is_blank(F.col(col)), text))


def copied_response(prompt: str, response: str) -> KeyedCheck:
    return KeyedCheck("copied_response", response, "inconsistent_value", COPIED, _key(~is_blank(F.col(response)), F.col(response)),
                      digest(F.col(prompt)))


def label_conflict(key: Column, labels: list[str]) -> list[KeyedCheck]:
    """One check per label; labels are compared as texts."""
    return [
        KeyedCheck("label_conflict", c, "inconsistent_value", CONFLICT, _key(key.isNotNull(), key), F.col(c).cast("string")) for c in labels
    ]


def run_keyed(df: DataFrame, checks: list[KeyedCheck], row_id: str = "row_id", dataset: str = "data") -> DataFrame:
    """Findings of all ``checks``, in the columns of the single ones; ``df`` is read once.

    A key that fills a large share of the rows is counted by a map-side-combined aggregate and spread by ``lookup_join``; a row without
    a row id is never first and never reported, but counts for conflicts of its group.
    """
    if not checks:
        raise ValueError("no checks")
    none = F.lit(None).cast("string")
    expanded = F.array(*[
        F.struct(F.lit(i).alias("check"), c.key.alias("key"), (none if c.value is None else c.value).alias("value")) for i, c in enumerate(checks)
    ])
    told = F.filter(expanded, lambda e: e["key"].isNotNull())
    rows = cut_lineage(df.select(F.col(row_id).cast("bigint").alias("row_id"), F.explode(told).alias("e")).select("row_id", "e.*"))
    groups = rows.groupBy("check", "key").agg(
        F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), (F.min("value") != F.max("value")).alias("mixed"),
        F.min_by("value", F.when(F.col("row_id").isNotNull(), F.struct("row_id", "value"))).alias("first_value"),
    )
    of = lambda kind: F.col("check").isin([i for i, c in enumerate(checks) if c.kind == kind])
    telling = groups.where((of(COPY) & (F.col("copies") > 1)) | (~of(COPY) & F.coalesce("mixed", F.lit(False)))).drop("copies", "mixed")
    found = lookup_join(rows, telling, ["check", "key"], "row_id", "inner").where(
        F.col("row_id").isNotNull() & (
            (of(COPY) & (F.col("row_id") > F.col("first_id"))) | of(CONFLICT)
            | (of(COPIED) & (F.col("row_id") > F.col("first_id")) & (F.col("value") != F.col("first_value")))
        )
    )
    names = F.array(*[
        F.struct(F.lit(c.col).alias("col"), F.lit(c.issue_type).alias("issue_type"), F.lit(c.rule_id).alias("rule_id")) for c in checks
    ])
    return found.withColumn("__is", F.get(names, F.col("check"))).select(
        F.lit(dataset).alias("dataset"), "row_id", "__is.col", "__is.issue_type", "__is.rule_id",
        F.when(of(CONFLICT), F.col("value")).alias("observed"), F.when(~of(CONFLICT), F.col("first_id").cast("string")).alias("expected"),
    )
