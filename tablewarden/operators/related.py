"""Planting faults that only show against another column, the row before, or another group.

As in :mod:`contaminate`, every choice depends on seed, fault and row id alone, and dirty table and truth come from the same
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, picked
from ..functions.numbers import as_number
from ..functions.text import strip
from ..session import cut_lineage
from .contaminate import Rewrite
from .skew import carry, lookup_join

SLOTS = 1024  # donors per group


def below_column(other: str, step: float = 1.0, places: int = 2) -> Rewrite:
    """A number ``step`` below the row's ``other``; cells whose partner is no number stay."""
    return lambda v, luck: (as_number(F.col(other).cast("string")) - F.lit(step)).try_cast(f"decimal(38,{places})").cast("string")


def before_column(other: str, days: int = 1) -> Rewrite:
    """A date ``days`` before the row's ``other``; cells whose partner is no date stay."""
    return lambda v, luck: F.date_format(F.date_sub(F.to_date(F.try_to_timestamp(F.substring(F.col(other).cast("string"), 1, 10), F.lit("yyyy-MM-dd"))), days), "yyyy-MM-dd")


def _truth(changed: DataFrame, dataset: str, row: Column, col: str, issue_type: str, description: Column, difficulty: float, clean: Column) -> DataFrame:
    return changed.select(
        F.lit(dataset).alias("dataset"), row.alias("row_id"), F.lit(col).alias("col"), F.lit(issue_type).alias("issue_type"), description.alias("description"),
        F.lit(float(difficulty)).alias("difficulty"), strip(clean.cast("string")).alias("clean_value"), F.lit(0).alias("seq"))


def before_previous(
    df: DataFrame, ts: str, order_by: str, row_id: str = "row_id", partition_by: list[str] | None = None, rate: float = 0.02, seconds: int = 1,
    dataset: str = "data", seed: int = 42, difficulty: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """Move drawn timestamps to ``seconds`` before that of the row ahead of them: ``(dirty, truth)``.

    The row ahead is the one before in ``(order_by, row_id)`` within the group that has a time.  A drawn row whose row ahead is drawn
    too is left alone, so each planted row lies below a time that stayed, and rows after it are measured against a lowered one:
    in a table that was in order :func:`ordered.chronological` reports the planted rows and no other.  Rows without
    time or order, and the first of a group, are never drawn.  The row ahead comes from the sliced scan of :func:`skew.carry`.
    """
    keys, row = list(partition_by or []), F.col(row_id).cast("bigint")
    chosen = picked(row, f"previous:{ts}", rate, seed)
    rows = df.where(F.col(ts).isNotNull() & F.col(order_by).isNotNull()).select(*dict.fromkeys([*keys, order_by, row_id]), F.struct(F.col(ts).alias("ts"), chosen.alias("drawn")).alias("__own"))
    scanned = carry(rows, "__own", order_by, row_id, keys, "last", "__ahead")
    hit = F.col("__own.drawn") & F.col("__ahead").isNotNull() & ~F.col("__ahead.drawn")
    lowered = (F.col("__ahead.ts") - F.make_interval(secs=F.lit(seconds))).cast(df.schema[ts].dataType)
    moved = cut_lineage(scanned.where(hit).select(F.col(row_id).alias("__row"), lowered.alias("__moved")))
    joined = lookup_join(df.withColumn("__row", F.col(row_id)), moved, ["__row"], row_id)
    dirty = joined.select(*[F.coalesce("__moved", F.col(c)).alias(c) if c == ts else F.col(c) for c in df.columns])
    changed = joined.where("__moved IS NOT NULL")
    told = F.lit(f"{ts} lies {seconds} s before the time of the row ahead")
    return dirty, _truth(changed, dataset, row, ts, "inconsistent_value", told, difficulty, F.col(ts))


def copy_from_other_group(
    df: DataFrame, col: str, group: str, row_id: str = "row_id", rate: float = 0.02, dataset: str = "data", seed: int = 42, difficulty: float = 2.5,
    issue_type: str = "inconsistent_value", slots: int = SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """Overwrite drawn cells with the cell of a row of another group (a text of another language): ``(dirty, truth)``.

    Every group offers at most ``slots`` donors, the smallest row id of each hashed slot, so a group of any size gives a small table
    after one map-side-combined minimum, and drawn rows spread evenly over it.  A group takes from the one that follows it in order,
    the last from the first.  Rows without a group, and tables of one group, stay as they are.  The choice depends on ids and seed
    alone, however the table is partitioned.
    """
    row, given = F.col(row_id).cast("bigint"), df.where(F.col(group).isNotNull() & F.col(col).isNotNull())
    slot = (draw(row, f"slot:{col}", seed) % slots).alias("__slot")
    offered = given.select(F.col(group).alias("__group"), slot, row.alias("__donor")).groupBy("__group", "__slot").agg(F.min("__donor").alias("__donor"))
    in_group = Window.partitionBy("__group")
    numbered = cut_lineage(offered.select(
        "__group", "__donor", (F.row_number().over(in_group.orderBy("__slot")) - 1).cast("bigint").alias("__k"), F.count(F.lit(1)).over(in_group).alias("__n")))
    groups = numbered.select("__group", "__n").distinct()
    ring = Window.orderBy("__group")  # one row per group
    next_of = groups.select("__group", F.coalesce(F.lead("__group").over(ring), F.first("__group").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__from"))
    sizes = groups.select(F.col("__group").alias("__from"), "__n")
    plan = cut_lineage(next_of.where("__group <> __from").join(sizes, "__from"))
    drawn = given.where(picked(row, f"foreign:{col}", rate, seed)).select(row.alias("__row"), F.col(group).alias("__group"), draw(row, f"foreign:luck:{col}", seed).alias("__luck"))
    sent = lookup_join(drawn, plan, ["__group"], "__row", "inner").select("__row", "__from", (F.col("__luck") % F.col("__n")).alias("__k"))
    donors = numbered.select(F.col("__group").alias("__from"), "__k", "__donor")
    wanted = cut_lineage(lookup_join(sent, donors, ["__from", "__k"], "__row", "inner").select("__row", "__donor"))
    cells = df.select(row.alias("__donor"), F.col(col).alias("__given")).join(numbered.select("__donor"), "__donor", "left_semi")
    gifts = lookup_join(wanted, cut_lineage(cells), ["__donor"], "__row", "inner")
    joined = lookup_join(df.withColumn("__row", row), cut_lineage(gifts), ["__row"], row_id).withColumn(
        "__changed", F.col("__given").isNotNull() & ~F.col("__given").eqNullSafe(F.col(col)))
    dirty = joined.select(*[F.when(F.col("__changed"), F.col("__given")).otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns])
    told = F.concat(F.lit(f"{col} comes from row "), F.col("__donor").cast("string"), F.lit(f" of another {group}"))
    return dirty, _truth(joined.where("__changed"), dataset, row, col, issue_type, told, difficulty, F.col(col))
