"""Clusters of near duplicates: connected components over a similarity join, and votes within them.

A partner per row is enough to drop copies but not to cluster: a row may join two groups that have nothing else in common.  So the
components of the links to the first rows under the ``leads`` are taken, and rows of different components are compared all with all,
once.  The members of a huge cluster, most of which share a component by then, are not paired with one another; of the pairs found
the likeliest of each row are verified first, and the others only if their ends are still apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import keyed
from .similarity import jaccard, led_similar, set_marks, settled_pairs, similar_grid, verified_sets, word_sets
from .skew import lookup_join


def connected(links: DataFrame) -> DataFrame:
    """``id``, ``cluster`` for every end of ``links`` (two bigint columns, in any order): the smallest id reachable.

    Each round every node hands its larger neighbours to its smallest one, and then all its smaller ones, so stars grow and
    a path of n nodes ends in about log n rounds.  The minima are map-side-combined; a node with very many neighbours is joined by
    :func:`lookup_join`.  Links of a node to itself and links with a null end count nothing.  A count and a checksum a round reach the driver.
    """
    one, other = links.columns
    ends = links.select(F.col(one).cast("bigint").alias("a"), F.col(other).cast("bigint").alias("b")).where("a <> b")

    def stored(edges: DataFrame) -> DataFrame:
        return cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges, before = stored(ends), None
    while (now := state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        spread = lookup_join(both.where("b > a"), least, ["a"], "b", "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(spread)
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup_join(large, first, ["a"], "b", "inner").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small)
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("cluster"))
    return roots.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("cluster")).distinct())


def _bridges(marks: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``id, other, apart`` that sizes and parity bits do not rule out and that lie in different components."""
    marked = cut_lineage(lookup_join(marks.drop("leads"), roots, ["id"], "size").withColumn("cluster", F.coalesce("cluster", "id")))
    return similar_grid(marked, None, threshold)


def _still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, other`` of the ``pairs`` whose ends are in different components."""
    ends = lookup_join(pairs.select("id", "other"), roots.withColumnRenamed("cluster", "a"), ["id"], "other", stored=True)
    ends = lookup_join(ends, roots.select(F.col("id").alias("other"), F.col("cluster").alias("b")), ["other"], "id", stored=True)
    return ends.where(F.coalesce("a", "id") != F.coalesce("b", "other")).select("id", "other")


def near_clusters(df: DataFrame, col: str, threshold: float = 0.65, row_id: str = "row_id") -> DataFrame:
    """``id``, ``cluster`` of every row that has a near copy: rows whose word sets have Jaccard similarity of at least ``threshold`` are linked,
    and a cluster is all that links reach, named by its smallest id.  Exact.

    Rows without words, and rows without a near copy, are in no cluster.  Rows with a null id are left out; ids are taken as unique.
    """
    items, copies = word_sets(df.where(F.col(row_id).isNotNull()), col, row_id)
    marks = set_marks(items)
    links = led_similar(items, marks, threshold)
    pairs = cut_lineage(_bridges(marks, cut_lineage(connected(links)), threshold))
    links = cut_lineage(links.unionByName(settled_pairs(pairs, items, threshold)))
    left = cut_lineage(_still_apart(pairs, cut_lineage(connected(links))))
    more = verified_sets(left, items, lambda a, b: jaccard(a, b) >= threshold)
    return connected(links.unionByName(more).unionByName(copies.select("id", "other")))


def with_cluster(df: DataFrame, col: str, threshold: float = 0.65, row_id: str = "row_id") -> DataFrame:
    """``df`` with ``cluster``; rows without a near copy have their own id there."""
    found = near_clusters(df, col, threshold, row_id).select(F.col("id").alias(row_id), "cluster")
    return lookup_join(df, cut_lineage(found), [row_id], row_id).withColumn("cluster", F.coalesce("cluster", F.col(row_id).cast("bigint")))


def label_conflict_near(
    df: DataFrame, col: str, labels: list[str], threshold: float = 0.65, row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """Rows of nearly the same text that carry different labels; one finding per row and label."""
    return keyed.label_conflict(with_cluster(df, col, threshold, row_id), F.col("cluster"), labels, row_id, dataset)


def label_by_cluster(
    df: DataFrame, col: str, label: str, threshold: float = 0.65, row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """Rows whose label differs from the majority label of the near copies they belong to; ties go to the smaller label."""
    return keyed.label_by_peer(with_cluster(df, col, threshold, row_id), F.col("cluster"), label, row_id, dataset)
