"""Near misses of known values, for dictionaries of any size.

Only distinct values are compared.  A word within ``k`` edits of another must contain one of its ``k + 1`` pieces
unchanged, at most ``k`` places away; the pieces are the join keys, so no value meets the whole dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .keyed import to_findings
from .skew import lookup_join


def _pieces(word: Column, k: int) -> Column:
    """(word length, piece number, piece) of a dictionary word, cut into ``k + 1`` nearly equal pieces."""
    n = F.length(word)
    cut = lambda i: F.floor(n * i / (k + 1)).cast("int")
    return F.array(*[
        F.struct(n.alias("n"), F.lit(i).alias("i"),
                 F.substring(word, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"))
        for i in range(k + 1)
    ])


def _probes(values: DataFrame, k: int) -> DataFrame:
    """Every place where a value can hold a piece of a dictionary word of similar length: ``v, n, i, piece``."""
    ways = F.array(*[
        F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))
        for d in range(-k, k + 1) for i in range(k + 1) for shift in range(-k, k + 1)
    ])
    laid = values.select("v", F.explode(ways).alias("w")).select("v", "w.*").withColumn("n", F.length("v") + F.col("d"))
    start = F.floor(F.col("n") * F.col("i") / (k + 1)).cast("int")
    size = F.floor(F.col("n") * (F.col("i") + 1) / (k + 1)).cast("int") - start
    placed = laid.withColumn("at", start + F.col("shift")).withColumn("size", size)
    return placed.where("n > 0 AND at >= 0 AND at + size <= length(v)").select(
        "v", "n", "i", F.substring("v", F.col("at") + 1, F.col("size")).alias("piece")
    ).distinct()


def near_words(values: DataFrame, value: str, words: DataFrame, word: str, max_distance: int = 2) -> DataFrame:
    """For every distinct value that is no dictionary word: the nearest word within ``max_distance`` edits.

    Columns ``value, nearest, distance, ways``; ties go to the smaller word, and ``ways`` counts the words at that distance.
    """
    w = words.select(strip(F.col(word)).alias("w")).where("w IS NOT NULL AND w <> ''").distinct()
    v = values.select(strip(F.col(value)).alias("v")).where("v IS NOT NULL AND v <> ''").distinct()
    unknown = v.join(w, v["v"] == w["w"], "left_anti")
    probes = _probes(unknown, max_distance)
    pieces = w.select("w", F.explode(_pieces(F.col("w"), max_distance)).alias("p")).select("w", "p.*")
    pairs = probes.join(pieces, ["n", "i", "piece"]).select("v", "w").distinct()
    near = pairs.withColumn("d", F.levenshtein("v", "w", max_distance)).where("d >= 1")
    # At most ``max_distance`` counts per value: how many words lie at each distance.
    at = near.groupBy("v", "d").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("ways"))
    best = at.groupBy("v").agg(F.min(F.struct("d", "w", "ways")).alias("b"))
    return best.select(F.col("v").alias("value"), F.col("b.w").alias("nearest"), F.col("b.d").alias("distance"), F.col("b.ways").alias("ways"))


def frequent_values(df: DataFrame, col: str, at_least: int) -> DataFrame:
    """A column's own vocabulary: the values that occur ``at_least`` times. Column ``word``."""
    return df.where(~is_blank(F.col(col))).groupBy(strip(F.col(col)).alias("word")).count().where(
        F.col("count") >= at_least
    ).select("word")


def misspelling_against(
    df: DataFrame, col: str, words: DataFrame, word: str = "word", max_distance: int = 2, row_id: str = "row_id",
    dataset: str = "data",
) -> DataFrame:
    """Cells that are near misses of a dictionary table's words."""
    rows = df.select(F.col(row_id).cast("bigint").alias("row_id"), strip(F.col(col)).alias("value")).where(
        "value IS NOT NULL"
    )
    near = near_words(rows, "value", words, word, max_distance)
    found = lookup_join(rows, near, ["value"], "row_id", "inner")
    return to_findings(found, dataset, col, "format_violation", f"misspelling:{col}", F.col("value"), F.col("nearest"))
