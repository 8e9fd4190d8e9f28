"""Joins and ordered scans in which no single key's rows have to meet in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_limit, cut_lineage, plan_bytes

SALTS = 64  # salts per shuffle partition, shared out among the hot keys: so many that hashing them again deals the rows out evenly
WORTH = 8  # keys with less than one eighth of a twentieth of a partition get no salts
SLICE_BYTES = 64 << 20  # of an ordered table, for one slice of its order


def hot_limit(rows: DataFrame) -> int:
    """How many keys count as hot: any key that could fill a twentieth of a shuffle partition is among so many."""
    return 20 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_salts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent keys of ``rows`` and how many salts each gets (``__salts``), by its share of the rows of all of them.

    Keys with too few rows to matter leave before the most frequent ones meet in one task: at most ``WORTH`` times as many as are
    wanted reach it, in step with the shuffle partitions and not with their square.
    """
    spark = rows.sparkSession
    counted = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    of_all = counted.agg(F.sum("__rows")).scalar()
    many = counted.where(F.col("__rows") * F.lit(WORTH * hot_limit(rows)) > of_all)
    hot = cut_lineage(many.orderBy(F.desc("__rows"), *keys).limit(hot_limit(rows)))
    total = hot.agg(F.sum("__rows")).first()[0] or 1
    salts = SALTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return hot.select(*keys, F.ceil(F.col("__rows") / F.lit(total) * F.lit(salts)).cast("int").alias("__salts"))


def lookup_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: str, how: str = "left", stored: bool = False) -> DataFrame:
    """Join ``rows`` to ``facts``, which holds each key at most once, when some keys fill a large share of ``rows``.

    When either side is so small that Spark itself would broadcast it, the join is a plain one.  An aggregate is planned as
    large as its input, so facts that look large are stored and measured first; the few facts of a grouped table are then
    broadcast as well.  Otherwise the most frequent keys of ``rows`` are found with a map-side-combined count, their rows are
    spread by ``spread_by`` over salts, and only their facts are repeated per salt.  A key gets salts by its share of the hot rows,
    so all facts together are repeated at most ``SALTS`` + 20 times per shuffle partition.  In a left join rows with a NULL key, which
    match nothing, are spread likewise.  The result equals a plain join.  Facts that are a stored table, or columns of one, are told so
    by ``stored`` and not written once more.
    """
    spark = rows.sparkSession
    limit = broadcast_limit(spark)
    if min(plan_bytes(facts), plan_bytes(rows)) <= limit:
        return rows.join(facts, keys, how)
    if not stored and plan_bytes(facts := cut_lineage(facts)) <= limit:
        return rows.join(F.broadcast(facts), keys, how)
    salts = SALTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_salts(rows, keys)
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.when(empty, F.pmod(F.xxhash64(spread_by), F.lit(salts)))
        .otherwise(F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__salts")), F.lit(0))).cast("int")
    )
    salted_facts = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    )
    joined = salted_rows.drop("__salts").join(salted_facts.drop("__salts"), [*keys, "__salt"], how)
    return joined.drop("__salt")


def row_bytes(df: DataFrame) -> int:
    """About the size of a row outside columnar files: a word per column, and two more for a text or nested value."""
    return 16 + sum(8 if f.dataType.simpleString() in ("boolean", "int", "bigint", "double", "float", "smallint", "tinyint", "date", "timestamp") else 24 for f in df.schema)


def carry(
    df: DataFrame, value: str, order: str, row_id: str, partition_by: list[str] | None = None, how: str = "last",
    out: str = "carried", split: bool | None = None,
) -> DataFrame:
    """Add ``out``: what the earlier rows of the group carry to this one.

    ``last`` is the latest earlier non-NULL ``value``; ``max`` the largest ``value`` so far, this row included.
    Rows are ordered by ``(order, row_id)``, rows without ``order`` first.  A table that is planned as too large to be broadcast is
    stored, so that its real size decides and not a planner's guess, which multiplies at every join.  If it still is too large, it is
    range partitioned by that order into slices, one per ``SLICE_BYTES`` as stored or as shuffled, whichever are more (stored columns
    may be many times smaller than the rows a task reads); each (group, slice) is scanned on its own, and one
    summary row per (group, slice) hands the state on, so neither a group that fills a third of the table nor a table without
    groups nor a value of ``order`` that many rows share runs in one task.  A smaller table is scanned in one slice.
    """
    keys, forced = list(partition_by or []), split
    limit = broadcast_limit(df.sparkSession)
    if split is None:
        split = plan_bytes(df) > limit
    if split and not forced:
        df = cut_lineage(df)
        split = plan_bytes(df) > limit
    first = [F.col(order).asc_nulls_first(), F.col(row_id).asc_nulls_first()]
    sliced = df
    if split:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if forced else max(2, math.ceil(max(plan_bytes(df), df.count() * row_bytes(df)) / SLICE_BYTES))
        ranged = df.repartitionByRange(n, *first)
        sliced = cut_lineage(ranged.withColumn("__slice", F.spark_partition_id()))
    within = Window.partitionBy(*keys, *(["__slice"] if split else [])).orderBy(*first)
    if how == "last":
        local = F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
        end = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(F.col(order).isNotNull().alias("o"), order, row_id)))
        over_slices, pick = F.last("__end", ignorenulls=True), F.coalesce
    elif how == "max":
        local = F.max(value).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        end = F.max(F.col(value))
        over_slices, pick = F.max("__end"), F.greatest
    else:
        raise ValueError(f"unknown carry: {how}")
    scanned = sliced.withColumn("__local", local)
    if not split:
        return scanned.withColumnRenamed("__local", out)
    ends = sliced.groupBy(*keys, "__slice").agg(end.alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*keys, "__slice", over_slices.over(before).alias("__before"))
    same = F.lit(True)
    left, right = scanned.alias("l"), handed.alias("r")
    for k in [*keys, "__slice"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in df.columns], pick(F.col("l.__local"), F.col("r.__before")).alias(out)
    )


def digest(*cols: Column) -> Column:
    """256-bit digest of several values, NULLs told apart from empty text; equal digests mean equal values."""
    named = [c.alias(f"c{i}") for i, c in enumerate(cols)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


__all__ = ["carry", "cut_lineage", "digest", "lookup_join"]
