"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Terms are vector positions; the postings of a term are the rows with a non-zero weight there.  Queries and candidates are
dealt in blocks; a task takes one block of each, adds every term's postings, weighted by the queries, into a dense score
array, and keeps the k best rows of each query by partition selection.  The few rows kept per block are merged by a window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of

LIMIT = 2**62  # sums below it are added as 64-bit integers; larger ones as Python integers


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id``, integer ``terms``: floor(scale * x) of each component, taken as double.

    Rows that are null, hold a null or non-finite component, or have no id, are left out.  A component beyond a long after scaling
    fails the job.
    """
    flat = rows_of(vectors, vec_id=F.col(id_col).cast("bigint"), x=F.col(vector_col).cast("array<double>"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.forall("x", lambda v: F.abs(v) * scale < float(2**63))
    checked = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is beyond a long after scaling")).cast("array<double>"))
    return flat.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(good).select(
        "vec_id", F.transform(checked, lambda v: F.floor(v * scale).cast("bigint")).alias("terms"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores [query, row]: for every term, the postings of the block are scattered to all queries that hold the term."""
    most = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if most(queries) * most(block) * block.shape[1] >= LIMIT:  # no rounding and no wrapping round; a score beyond a long fails
        exact = queries.astype(object) @ block.T.astype(object)
        if any(abs(x) >= 2**63 for x in exact.ravel()):
            raise OverflowError("a score is beyond a long")
        return exact.astype(np.int64)
    scores = np.zeros((len(queries), len(block)), dtype=np.int64)
    for term in range(block.shape[1]):
        who, rows = np.flatnonzero(queries[:, term]), np.flatnonzero(block[:, term])
        if len(who) == len(queries) and len(rows) == len(block):
            scores += queries[:, term, None] * block[None, :, term]
        elif len(who) and len(rows):
            scores[who[:, None], rows[None, :]] += queries[who, term, None] * block[None, rows, term]
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores of one query, ties to the smaller id; ``ids`` ascend."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > least)
    level = np.flatnonzero(scores == least)[: k - len(over)]
    chosen = np.sort(np.concatenate([over, level]))
    return chosen[np.argsort(-scores[chosen], kind="stable")]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, rows_per_block: int = 4096, queries_per_block: int = 1024) -> DataFrame:
    """The k best candidates of every query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Both inputs have ``vec_id`` and integer ``terms`` (see ``usable``); vectors of different length are padded with zeros.
    Candidates with the query's own id take no part.  Fewer than k candidates: all of them.  Equal scores go to the smaller
    id; a candidate row that occurs twice may take two ranks.  A query id with two different vectors gives a ranking for each;
    repeated equal query rows give one.  Either table empty: no rows.
    """
    n_blocks = max(1, math.ceil(candidates.count() / rows_per_block))
    asked = queries.distinct()
    q_blocks = max(1, math.ceil(asked.count() / queries_per_block))
    row_key, query_key = F.xxhash64("vec_id", "terms"), F.xxhash64(F.lit(7), "vec_id", "terms")
    dealt = candidates.select("vec_id", "terms", F.pmod(row_key, F.lit(n_blocks)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    held = asked.select(F.col("vec_id").alias("query_id"), "terms", query_key.alias("query_key"), F.pmod(query_key, F.lit(q_blocks)).cast("int").alias("q"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("c"))

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_key", "vec_id", "score")})
        if rows.empty or wanted.empty:
            return empty
        rows = rows.sort_values("vec_id", kind="stable")
        width = max(rows["terms"].map(len).max(), wanted["terms"].map(len).max())
        ids, block = rows["vec_id"].to_numpy(), _matrix(rows["terms"], width)
        found = [empty]
        for at in range(0, len(wanted), 128):
            part = wanted.iloc[at : at + 128]
            scores = accumulate(_matrix(part["terms"], width), block)
            for own, key, line in zip(part["query_id"], part["query_key"], scores):
                others = np.flatnonzero(ids != own)
                best = others[best_of(line[others], ids[others], k)]
                found.append(pd.DataFrame({"query_id": own, "query_key": key, "vec_id": ids[best], "score": line[best]}))
        return pd.concat(found, ignore_index=True)

    kept = dealt.groupBy("q", "c").cogroup(held.groupBy("q", "c")).applyInPandas(search, "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
