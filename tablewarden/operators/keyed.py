"""Checks over groups of equal rows.

No group is ever gathered: the smallest row id per key is found with a map-side-combined aggregate, and joined back to
the rows with :func:`~tablewarden.operators.skew.lookup_join`, which spreads keys that many rows share.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .skew import digest, lookup_join


def to_findings(
    df: DataFrame, dataset: str, col: str, issue_type: str, rule_id: str, observed: Column | None = None,
    expected: Column | None = None,
) -> DataFrame:
    """Shape rows that hold ``row_id`` into findings."""
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(dataset).alias("dataset"), F.col("row_id").cast("bigint").alias("row_id"), F.lit(col).alias("col"),
        F.lit(issue_type).alias("issue_type"), F.lit(rule_id).alias("rule_id"),
        (none if observed is None else observed.cast("string")).alias("observed"),
        (none if expected is None else expected.cast("string")).alias("expected"),
    )


def first_of_copies(df: DataFrame, key: Column, row_id: str = "row_id") -> DataFrame:
    """Rows that repeat an earlier row's key: ``row_id``, ``first_id``, ``copies`` (rows with that key).

    Callers leave out rows without a key; a test for NULL here would be pushed down and work the key out twice.
    """
    keyed = df.select(F.col(row_id).cast("bigint").alias("row_id"), key.alias("__key"))
    groups = keyed.groupBy("__key").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # Most keys are single: they leave before the join, which keeps its right side small.
    repeated = groups.where("copies > 1")
    return lookup_join(keyed, repeated, ["__key"], "row_id", "inner").where("row_id > first_id").drop("__key")


def duplicate_row(
    df: DataFrame, report_col: str, row_id: str = "row_id", cols: Iterable[str] | None = None, dataset: str = "data"
) -> DataFrame:
    """Later copies of rows that agree in all ``cols`` (default: every column but the row id)."""
    names = list(cols) if cols else [c for c in df.columns if c != row_id]
    found = first_of_copies(df, digest(*[F.col(c) for c in names]), row_id)
    return to_findings(found, dataset, report_col, "duplicate_row", "duplicate_row", expected=F.col("first_id"))


def duplicate_key(
    df: DataFrame, keys: list[str], row_id: str = "row_id", report_col: str | None = None, dataset: str = "data"
) -> DataFrame:
    """Later rows that repeat a key; rows with a blank key part are left to the missing-value check."""
    given = F.lit(True)
    for k in keys:
        given = given & ~is_blank(F.col(k).cast("string"))
    key = digest(*[F.col(k) for k in keys]) if len(keys) > 1 else F.col(keys[0])
    found = first_of_copies(df.where(given), key, row_id)
    name = report_col or keys[0]
    return to_findings(found, dataset, name, "duplicate_row", f"duplicate_key:{','.join(keys)}",
                       expected=F.col("first_id"))


def normal_text(c: Column) -> Column:
    """Case, punctuation and spacing taken out of a text."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def duplicate_text(
    df: DataFrame, col: str, row_id: str = "row_id", normalise: bool = False, dataset: str = "data",
    issue_type: str = "duplicate_row",
) -> DataFrame:
    """Later copies of a text, exact or after :func:`normal_text`.  Blank texts do not count as copies."""
    text = normal_text(F.col(col)) if normalise else F.col(col)
    found = first_of_copies(df.where(~is_blank(F.col(col))), digest(text), row_id)
    return to_findings(found, dataset, col, issue_type, f"duplicate_text:{col}", expected=F.col("first_id"))


def copied_response(
    df: DataFrame, prompt: str, response: str, row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """The same response given to different prompts: rows after the first whose prompt is not the first one's."""
    keyed = df.where(~is_blank(F.col(response))).select(
        F.col(row_id).cast("bigint").alias("row_id"), digest(F.col(prompt)).alias("__p"),
        digest(F.col(response)).alias("__r"),
    )
    groups = keyed.groupBy("__r").agg(
        F.min_by("__p", "row_id").alias("__first_p"), F.min("row_id").alias("first_id"),
        (F.min("__p") != F.max("__p")).alias("__mixed"),
    ).where("__mixed").drop("__mixed")
    found = lookup_join(keyed, groups, ["__r"], "row_id", "inner").where("__p <> __first_p AND row_id > first_id")
    return to_findings(found, dataset, response, "inconsistent_value", "copied_response", expected=F.col("first_id"))


def label_conflict(
    df: DataFrame, key: Column, labels: list[str], row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """Rows of the same text (or cluster) that carry different labels; one finding per row and label."""
    keyed = df.select(F.col(row_id).cast("bigint").alias("row_id"), key.alias("__key"), *labels).where(
        "__key IS NOT NULL"
    )
    groups = keyed.groupBy("__key").agg(
        *[(F.min(c) != F.max(c)).alias(f"__mixed_{c}") for c in labels]
    ).where(" OR ".join(f"__mixed_{c}" for c in labels))
    joined = lookup_join(keyed, groups, ["__key"], "row_id", "inner")
    marks = [
        F.when(F.col(f"__mixed_{c}"), F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("observed")))
        for c in labels
    ]
    return joined.select("row_id", F.explode(F.array(*marks)).alias("m")).where("m IS NOT NULL").select(
        F.lit(dataset).alias("dataset"), "row_id", "m.col", F.lit("inconsistent_value").alias("issue_type"),
        F.lit("label_conflict").alias("rule_id"), "m.observed", F.lit(None).cast("string").alias("expected"),
    )


def label_by_peer(
    df: DataFrame, group: Column, label: str, row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """Rows whose label differs from the majority label of their group; ties go to the smaller label."""
    keyed = df.select(F.col(row_id).cast("bigint").alias("row_id"), group.alias("__key"), F.col(label)).where(
        "__key IS NOT NULL"
    )
    votes = keyed.groupBy("__key", label).agg(F.count(F.lit(1)).alias("n"))
    majority = votes.groupBy("__key").agg(
        F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("majority"),
        F.count(F.lit(1)).alias("labels"),
    ).where("labels > 1")
    found = lookup_join(keyed, majority, ["__key"], "row_id", "inner").where(F.col(label) != F.col("majority"))
    return to_findings(found, dataset, label, "inconsistent_value", f"label_by_peer:{label}",
                       observed=F.col(label), expected=F.col("majority"))


def keep_first(df: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """Drop later copies: the first row of every key stays.  One aggregate, no window, no sort."""
    others = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(row_id)).alias("__row"))
    return packed.select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )
