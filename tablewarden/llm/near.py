"""Near copies by word shingles: exact set similarity, no fingerprints.

A text is the set of its five-word shingles, as 64-bit hashes.  Equal sets are folded first.  Two sets with Jaccard similarity of
at least t share a shingle within their first n - ceil(t * n) + 1 shingles under any fixed order; here those frequent in a sample
come last.  Only shingles that two texts have in that prefix are kept as meeting points.

What meets is tested four times, each on less: by the sizes and places that stand at the meeting points; by 512 parity bits and then by a
signature of about eight parity bits per shingle, fetched by id, which bounds the difference of two sets from below; and what is left by the
words of the texts.  The likeliest partner of a text is read first, the others only if it fails, so hardly more texts travel than go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import BITS, _close_enough, _verified, earlier_match
from ..operators.skew import lookup_join
from ..session import drop_stages
from .common import batches_by_size, cut_lineage, join_small, rows_of

SAMPLE, FREQUENT = 10_000, 50_000  # documents looked at for the order of shingles, and most of them that come last
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in ``simhash.fingerprint``
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))
    width = min(width, len(words))
    made = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        made = made * ODD + codes[j : j + len(made)]
    made = (made ^ (made >> np.uint64(31))) * MIX
    return np.unique(made ^ (made >> np.uint64(32)))


def similarity(a: str | None, b: str | None, width: int) -> float:
    """Jaccard similarity of the sets of word runs, on the words themselves; two texts without words are equal."""
    one, other = ({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
                  for words in ((t or "").encode("utf-8", "surrogatepass").lower().split() for t in (a, b)))
    shared = len(one & other)
    return shared / (len(one) + len(other) - shared) if one or other else 1.0


def signature(own: np.ndarray) -> bytes:
    """Parity bits of a set, eight to sixteen per member, a power of two in all."""
    size = 64 << max(0, len(own) - 1 >> 3).bit_length()
    counts = np.bincount((own >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the members that are in one set only: the longer signature is folded to the shorter one's length."""
    one, other = sorted((np.frombuffer(x, np.uint64) for x in (a, b)), key=len)
    while len(other) > len(one):
        other = other.reshape(2, -1)[0] ^ other.reshape(2, -1)[1]
    return int(np.bitwise_count(one ^ other).sum())


def frequent_shingles(flat: DataFrame, width: int) -> np.ndarray:
    """Hashes that several documents of a sample have, the most frequent last.  They steer the order only, not the result."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_by_size(frames, "text", 8_000_000):
            some, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingles(t, width) for t in frame["text"])]), return_counts=True)
            yield pd.DataFrame({"h": some.view(np.int64), "n": counts})

    step = max(1, flat.count() // SAMPLE)
    sample = flat.where(F.pmod(F.xxhash64("doc_id", "own"), F.lit(step)) == 0).select("text")
    counted = sample.mapInPandas(work, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return np.array([r["h"] for r in reversed(found)], np.int64).view(np.uint64)


def prefix_of(own: np.ndarray, known: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set: those not ``known`` (sorted, with their ``rank``) by hash, then the known ones by rank."""
    if not len(own):
        return own
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own
        own = np.concatenate([own[~hit], own[hit][np.argsort(rank[at[hit]])]])
    return own[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]


def shingle_sets(flat: DataFrame, width: int, threshold: float, frequent: np.ndarray) -> DataFrame:
    """``doc_id``, ``own``, ``key`` (digest of the set), ``n``, ``bits`` (as in ``similarity.parity_bits``), ``signed``, ``prefix``."""
    order = np.argsort(frequent)
    known, rank = frequent[order], order

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_by_size(frames, "text", 16_000_000):
            rows = []
            for doc_id, own, text in zip(frame["doc_id"], frame["own"], frame["text"]):
                made = shingles(text, width)
                odd = np.bincount((made % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                rows.append((doc_id, own, xxhash.xxh3_128_digest(made.tobytes()), len(made), np.packbits(odd.astype(np.uint8)).view(np.int64), signature(made),
                             prefix_of(made, known, rank, threshold).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "own", "key", "n", "bits", "signed", "prefix"])

    return flat.mapInPandas(work, "doc_id bigint, own bigint, key binary, n int, bits array<bigint>, signed binary, prefix array<bigint>")


def keep_first(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", stay: DataFrame | None = None
) -> DataFrame:
    """``docs`` without those that have a near copy with a smaller id: a text whose set of shingles has Jaccard similarity of at
    least ``threshold`` with theirs.

    Words are folded to lower case A-Z.  Texts without words are copies of one another.  Of a repeated row one stays; rows that share
    an id but not the text are told apart.  Rows without an id all stay and take nothing from others.  ``stay`` (``doc_id``, ``own``;
    stored) names rows that another search lets stay: those it does not name go as well.
    """
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), own=own, text=F.coalesce(F.col(text_col), F.lit(""))).where("doc_id IS NOT NULL")
    sets = shingle_sets(flat, width, threshold, frequent_shingles(flat, width))
    stages = []

    def stage(df: DataFrame) -> DataFrame:
        stages.append(cut_lineage(df))
        return stages[-1]

    items = stage(sets.groupBy("key").agg(F.min(F.struct("doc_id", "own", "n", "bits", "signed", "prefix")).alias("it")).select(
        F.struct("it.doc_id", "it.own").alias("id"), "it.n", "it.bits", "it.signed", "it.prefix"))
    points = items.select("id", F.posexplode("prefix").alias("pos", "block"))
    shared = stage(points.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("block"))
    blocks = stage(join_small(items.select("id", "n", F.posexplode("prefix").alias("pos", "block")), shared, ["block"], "left_semi"))

    t, l_n, r_n = F.lit(threshold), F.col("l.n"), F.col("r.n")
    reach = 1 + F.least(l_n - F.col("l.pos") - 1, r_n - F.col("r.pos") - 1) + F.least(F.col("l.pos"), F.col("r.pos"))
    sizes = (r_n >= t * l_n - F.lit(1e-9)) & (l_n >= t * r_n - F.lit(1e-9))
    ok = sizes & (reach >= t / (1 + t) * (l_n + r_n) - F.lit(1e-9))
    texts = flat.select(F.struct("doc_id", "own").alias("id"), F.col("text").alias("payload"))

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(map(differing, a, b)), dtype="int32")

    apart = apart.asNondeterministic()  # else its filter works it out twice

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y, width) >= threshold - 1e-12 for x, y in zip(a, b)], dtype=bool)

    def read(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose texts are similar; each text is fetched once for all its pairs, then once a pair."""
        wanted = stage(pairs.select("id").union(pairs.select(F.col("other").alias("id"))).distinct())
        return stage(_verified(pairs, stage(join_small(texts, wanted, ["id"], "left_semi").dropDuplicates(["id"])), similar))

    def verified(pairs: DataFrame) -> DataFrame:
        signs = items.select("id", F.struct("n", "signed").alias("a"))
        both = lookup_join(pairs, signs, ["id"], "other", "inner", stored=True)
        both = lookup_join(both, signs.select(F.col("id").alias("other"), F.col("a").alias("b")), ["other"], "id", "inner", stored=True)
        most = (F.col("a.n") + F.col("b.n")) * (1 - threshold) / (1 + threshold) + F.lit(1e-6)
        left = stage(both.select("id", "other", apart("a.signed", "b.signed").alias("apart"), most.alias("most")).where("apart <= most").drop("most"))
        best = stage(left.groupBy("id").agg(F.min(F.struct("apart", "other")).alias("m")).select("id", F.col("m.other").alias("other")))
        sure = read(best)
        rest = stage(left.select("id", "other").join(best, ["id", "other"], "left_anti").join(sure.select("id"), "id", "left_anti"))
        return sure.unionByName(read(rest))

    near_bits = lambda pairs: pairs.where(_close_enough(threshold))
    gone = earlier_match(items, blocks, None, ok, verified, items.select("id", "n", "bits"), near_bits, stage)
    left = items.select("id").join(gone.select("id"), "id", "left_anti").select(F.col("id.doc_id").alias("__id"), F.col("id.own").alias("__own"))
    if stay is not None:
        left = left.join(stay.select(F.col("doc_id").alias("__id"), F.col("own").alias("__own")), ["__id", "__own"], "left_semi")
    kept = cut_lineage(left)
    drop_stages(*stages)
    marked = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__own": own})
    stay = join_small(marked, kept, ["__id", "__own"], "left_semi").dropDuplicates(["__id", "__own"])
    return stay.unionByName(marked.where("__id IS NULL")).drop("__id", "__own")
