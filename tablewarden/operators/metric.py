"""Exact search for nearly parallel vectors, with angles as a metric.

Some rows serve as pivots; every row belongs to the cell of the pivot nearest to it.  An earlier row ``y`` within the angle ``a`` of
``x`` lies in a cell of pivot ``q`` only if ``angle(x, q) <= angle(x, own pivot) + 2 a`` and ``angle(x, q) <= a + radius(q)``, both by the
triangle inequality, so ``x`` visits no other cell.  Rows that a pivot or the first row of a cell settles visit none, so the members of
a huge cluster do not meet one another.  Cells are packed into units, a visitor travels once to a unit however many of its cells it
visits, and units and their visitors become a grid of tasks; a task keeps one partner per visitor.  No pair is missed; how many cells are
left out depends on how clustered the vectors are.  A vector travels at most some ``2 * PIECES`` times, as the sides of the grid grow
with the table, up to ``MOST_SIDE`` rows; beyond that it travels once per ``MOST_SIDE`` rows met, so that a task stays bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keyed import to_findings
from .similarity import _folded
from .skew import digest

PIVOTS = 512  # at most so many pivot rows; they and the first rows of their cells are all that reaches the driver
SIDE, MOST_SIDE = 4096, 65_536  # rows on either side of a task of the grid: at least and at most, about
PIECES = 8  # sides of the grid between these limits
SLACK = 1e-7  # radians given to rounding where cells are left out


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0)


def _unit(vectors: pd.Series, dims: int) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, dims))
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _collected(rows: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["id"] for r in rows], np.int64), _unit(pd.Series([r["payload"] for r in rows], dtype=object), dims)


def _units(sizes: np.ndarray, side: int) -> np.ndarray:
    """The unit of each cell: cells in their order, as many as hold about ``side`` members together; a larger cell is a unit of its own."""
    units, unit, held = np.zeros(len(sizes), np.int64), 0, 0
    for cell, n in enumerate(sizes):
        if held and held + n > side:
            unit, held = unit + 1, 0
        units[cell], held = unit, held + n
    return units


def earlier_parallel(items: DataFrame, dims: int, threshold: float, most_pivots: int | None = None) -> DataFrame:
    """Ids with an earlier row at a cosine of at least ``threshold``, and one such row: ``id, other``.

    ``items`` is a stored table of ``id, payload``, every payload usable and every id once.  No rows give no rows.
    """
    reach, least = math.acos(min(1.0, max(-1.0, threshold))) + SLACK, threshold - 1e-12
    # As many cells as a cell has members keeps both the pivots looked at and the members met near the root of the table.
    count = min(most_pivots or PIVOTS, max(1, math.isqrt(items.count())))

    ids, pivots = _collected(items.orderBy(F.xxhash64("id"), "id").limit(count).collect(), dims)
    if not len(ids):
        return items.select("id", F.col("id").alias("other"))
    kind = items.schema["payload"].dataType.simpleString()  # vectors travel as they are given and are scaled where they meet

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = _unit(f["payload"], dims)
            away = _angles(v, pivots)
            home = away.argmin(axis=1)
            yield pd.DataFrame({"id": f["id"], "payload": f["payload"], "home": home.astype("int32"), "away": away[np.arange(len(v)), home]})

    placed = cut_lineage(items.select("id", "payload").mapInPandas(assign, f"id bigint, payload {kind}, home int, away double"))
    cells = placed.groupBy("home").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "payload"), "id").alias("head")).collect()
    radius, sizes = np.full(count, -np.inf), np.zeros(count, np.int64)
    for c in cells:
        radius[c["home"]], sizes[c["home"]] = c["radius"], c["n"]
    head_ids, heads = _collected([c["head"] for c in cells], dims)
    side = min(MOST_SIDE, max(SIDE, -(-int(sizes.sum()) // PIECES)))
    units = _units(sizes, side)
    leaders, leader_ids = np.concatenate([pivots, heads]), np.concatenate([ids, head_ids])

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        never = np.iinfo(np.int64).max
        for f in frames:
            v, own = _unit(f["payload"], dims), f["id"].to_numpy(np.int64)
            hit = (v @ leaders.T >= least) & (leader_ids[None, :] < own[:, None])
            other = np.where(hit, leader_ids[None, :], never).min(axis=1)
            away = _angles(v, pivots)
            near = (away <= f["away"].to_numpy()[:, None] + 2 * reach) & (away <= radius[None, :] + reach)
            settled = [None if o == never else int(o) for o in other]
            open_ = [p if o is None else None for p, o in zip(f["payload"], settled)]
            cells = [np.packbits(row).tobytes() if o is None else None for row, o in zip(near, settled)]
            met = [np.unique(units[row]).astype(np.int32) if o is None else None for row, o in zip(near, settled)]
            yield pd.DataFrame({"id": own, "payload": pd.Series(open_, dtype=object), "other": pd.Series(settled, dtype="Int64"),
                                "cells": pd.Series(cells, dtype=object), "units": pd.Series(met, dtype=object)})

    routed = cut_lineage(placed.mapInPandas(route, f"id bigint, payload {kind}, other bigint, cells binary, units array<int>"))
    visits = routed.where("other IS NULL").select("id", "payload", "cells", F.explode("units").alias("unit"))
    visitors = np.zeros(int(units[-1]) + 1, np.int64)
    for r in visits.groupBy("unit").count().collect():
        visitors[r["unit"]] = r["count"]
    members = np.bincount(units, weights=sizes).astype(np.int64)

    def of_unit(rows: np.ndarray) -> Column:
        return F.array(*[F.lit(int(n)) for n in -(-rows // side)])[F.col("unit")]

    def dealt(pieces: Column) -> Column:
        return F.pmod(F.xxhash64("id"), pieces).cast("int")

    def upto(pieces: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), pieces - 1))

    task = ["unit", "x", "y"]
    later = visits.withColumn("x", dealt(of_unit(visitors))).withColumn("y", upto(of_unit(members)))
    unit = F.array(*[F.lit(int(u)) for u in units])[F.col("home")]
    met = placed.select("id", "payload", "home", unit.alias("unit")).where(of_unit(visitors) > 0)
    met = met.withColumn("y", dealt(of_unit(members))).withColumn("x", upto(of_unit(visitors)))

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": [], "other": []}, dtype="int64")]
        if len(one) and len(two):
            own, never = one["id"].to_numpy(np.int64), np.iinfo(np.int64).max
            best = np.full(len(one), never)
            visited = np.unpackbits(np.frombuffer(b"".join(one["cells"]), np.uint8).reshape(len(one), -1), axis=1, count=count).astype(bool)
            v = _unit(one["payload"], dims)
            for home, rows in two.groupby("home"):
                there, earlier = _unit(rows["payload"], dims), rows["id"].to_numpy(np.int64)
                order = np.argsort(earlier)
                there, earlier = there[order], earlier[order]
                who = np.flatnonzero(visited[:, home] & (best > earlier[0]))
                step = max(1, (1 << 21) // len(earlier))
                for at in range(0, len(who), step):
                    part = who[at : at + step]
                    hit = (v[part] @ there.T >= least) & (earlier[None, :] < own[part, None])
                    some = hit.any(axis=1)
                    best[part[some]] = np.minimum(best[part[some]], earlier[hit[some].argmax(axis=1)])
            found.append(pd.DataFrame({"id": own[best < never], "other": best[best < never]}))
        return pd.concat(found)

    late = later.groupBy(*task).cogroup(met.groupBy(*task)).applyInPandas(compare, "id bigint, other bigint")
    return routed.where("other IS NOT NULL").select("id", "other").unionByName(late.groupBy("id").agg(F.min("other").alias("other")))


def parallel_vector(
    df: DataFrame, vector: str, dims: int, threshold: float = 0.95, row_id: str = "row_id", dataset: str = "data",
) -> DataFrame:
    """Rows whose vector has a cosine of at least ``threshold`` with that of an earlier row.  Exact.

    Vectors that are null, of another length, zero, or hold null or non-finite components take no part; equal vectors are folded
    first.  Cosines are compared with 1e-12 of slack for rounding.
    """
    items, copies = _folded(df.where(usable(F.col(vector), dims)), digest(F.col("payload")), row_id, F.col(vector))
    items = cut_lineage(items)
    found = copies.unionByName(earlier_parallel(items, dims, threshold))
    return to_findings(found.withColumnRenamed("id", "row_id"), dataset, vector, "duplicate_row",
                       f"parallel_vector:{vector}", expected=F.col("other"))
