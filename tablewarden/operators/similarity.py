"""Near duplicates of texts and vectors.

The question asked is "which rows have a similar row before them", because the first row of a cluster is the one to
keep.  That lets the work stay near linear where clusters are large:

1. rows with equal content are folded into their first row before anything is compared;
2. rows meet only in blocks (a rare shared token, a shared hash band, a shared hyperplane bucket);
3. every row is first compared with the leader (first row) of each of its blocks; a hit settles the row, so the
   members of a huge cluster never meet one another;
4. only rows still unsettled are compared with the other earlier members of their blocks, and large blocks are
   split over many tasks.

No block is gathered, no candidate is dropped.  Sets of words share too many words for blocks: the rows that are left there are
compared by size and parity bits in a grid of tasks (:func:`similar_grid`).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import cut_lineage
from .keyed import to_findings
from .skew import digest, lookup_join

COMMON = 1024  # the most frequent tokens; the list is cut to this length, so it is a small literal
CHUNK = 20_000  # members of a block, or rows of a size class, that one task compares
GRID, GRID_BYTES = 4, 16 << 20  # chunks of a size class, unless their parity bits are more than so many bytes
LEADS = 8  # blocks of a set in which it meets their first member
BITS = 512  # parity bits per set
LONGS = T.ArrayType(T.LongType())


def _verified(pairs: DataFrame, items: DataFrame, similar: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of ``pairs`` (id, other) whose payloads pass ``similar``; ids only.  ``items`` is stored."""
    own = items.select("id", F.col("payload").alias("a"))
    other = items.select(F.col("id").alias("other"), F.col("payload").alias("b"))
    with_own = lookup_join(pairs, own, ["id"], "other", "inner", stored=True)
    with_both = lookup_join(with_own, other, ["other"], "id", "inner", stored=True)
    return with_both.where(similar(F.col("a"), F.col("b"))).select("id", "other")


def earlier_match(
    items: DataFrame, blocks: DataFrame, similar: Callable[[Column, Column], Column] | None,
    admissible: Column | None = None, verified: Callable[[DataFrame], DataFrame] | None = None,
    marks: DataFrame | None = None, close: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    store: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Ids with an earlier similar id, and one such id: ``id, other``.

    ``items`` holds ``id, payload``; ``blocks`` holds ``id, block`` and any columns the cheap test ``admissible``
    reads as ``l.*`` (the row) and ``r.*`` (the earlier row).  Both are read several times and should be written
    tables or checkpoints.  ``verified`` takes the place of ``items`` and ``similar`` where payloads are fetched otherwise.

    What is too wide to stand in every block of a row is in ``marks`` (``id`` and columns, stored): ``close`` keeps those of a table of
    pairs ``l, r`` (``id``, the columns of the blocks where they meet, those of the marks) that the marks do not rule out.  Marks are
    fetched by id for the pairs with a leader, and otherwise only for rows of blocks where an unsettled row meets others than the leader.
    """
    check = verified or (lambda pairs: verified_sets(pairs, items, similar))
    ok = F.lit(True) if admissible is None else admissible
    extra = [c for c in blocks.columns if c not in ("id", "block")]
    head = F.min_by(F.struct("id", *extra), F.col("id")) if extra else F.struct(F.min("id").alias("id"))
    heads = store(blocks.groupBy("block").agg(head.alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    led = lookup_join(blocks, heads, ["block"], "id", "inner", stored=True)
    l_side = led.select(F.struct("id", *extra).alias("l"), F.col("head").alias("r"))
    to_heads = store(l_side.where((F.col("r.id") < F.col("l.id")) & ok).select(
        F.col("l.id").alias("id"), F.col("r.id").alias("other")
    ).distinct())
    if marks is not None:
        to_heads = store(_marked_pairs(to_heads, marks, close, store))
    settled = store(
        check(to_heads).groupBy("id").agg(F.min("other").alias("other"))
    )

    # Rows no leader settled, against the other members of their blocks.
    sizes = heads.where("members > 2").select("block", "members", F.col("head.id").alias("head_id"))
    open_rows = blocks.join(settled.select("id"), "id", "left_anti")
    probe = store(lookup_join(open_rows, sizes, ["block"], "id", "inner", stored=True).where("id <> head_id").drop("head_id"))
    # Only blocks that hold such a row are read again.
    probed = store(probe.groupBy("block").agg(F.count(F.lit(1)).alias("probes")))
    stored = lookup_join(blocks, lookup_join(sizes, probed, ["block"], "head_id", "inner", stored=True), ["block"], "id", "inner")
    stored = stored.where("id <> head_id").drop("head_id", "probes")
    if marks is not None:
        more = marks.drop(*extra)
        probe, stored = probe.join(more, "id"), stored.join(more, "id")
        extra = [*extra, *(c for c in more.columns if c != "id")]
    parts = F.ceil(F.col("members") / F.lit(CHUNK)).cast("int")
    # A block of many members is a grid of tasks, each with at most about CHUNK rows on either side.
    mine, every = F.pmod(F.xxhash64("id"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    probe = probe.withColumn("__x", mine).withColumn("__y", F.explode(every))
    stored = stored.withColumn("__y", mine).withColumn("__x", F.explode(every))
    cell = ["block", "__x", "__y"]
    met = (
        probe.select(*cell, F.struct("id", *extra).alias("l"))
        .join(stored.select(*cell, F.struct("id", *extra).alias("r")), cell)
        .where((F.col("r.id") < F.col("l.id")) & ok).select("l", "r")
    )
    pairs = store(close(met).select(F.col("l.id").alias("id"), F.col("r.id").alias("other")).distinct())
    late = check(pairs).groupBy("id").agg(F.min("other").alias("other"))
    return settled.unionByName(late)


def _marked_pairs(pairs: DataFrame, marks: DataFrame, close: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those of ``pairs`` (``id, other``, stored) that ``close`` keeps; only the marks of ids that stand in a pair are fetched."""
    wanted = store(pairs.select("id").union(pairs.select("other")).distinct())
    found = store(marks.join(wanted, "id", "left_semi").select("id", F.struct(*marks.columns).alias("m")))
    both = lookup_join(pairs, found.select("id", F.col("m").alias("l")), ["id"], "other", "inner", stored=True)
    both = lookup_join(both, found.select(F.col("id").alias("other"), F.col("m").alias("r")), ["other"], "id", "inner", stored=True)
    return close(both.select("l", "r")).select(F.col("l.id").alias("id"), F.col("r.id").alias("other"))


def _folded(
    df: DataFrame, key: Column, row_id: str, payload: Column
) -> tuple[DataFrame, DataFrame]:
    """(first row per equal payload as ``id, payload``; later copies as ``id, other``), both stored.

    Payloads are worked out twice and stored once: copies are told by their keys alone.
    """
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), payload.alias("payload"))
    # Filtered after it is written: a filter before would be pushed down and work the payload out once more.
    sized = cut_lineage(rows.select("id", F.size("payload").alias("n"), key.alias("key")))
    keyed = sized.where("n > 0")
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Written as well: used twice, and planned as large as all rows, which would then be shuffled to leave them out.
    copies = cut_lineage(lookup_join(keyed.select("id", "key"), firsts.where("n > 1").drop("n"), ["key"], "id", "inner").where(
        "id > first"
    ).select("id", F.col("first").alias("other")))
    items = cut_lineage(rows.join(copies.select("id"), "id", "left_anti"))
    return items.where("size(payload) > 0"), copies


def common_tokens(items: DataFrame) -> list[int]:
    """The most frequent tokens, the most frequent last; never more than ``COMMON``."""
    top = (
        items.select(F.explode("payload").alias("t")).groupBy("t").count()
        .orderBy(F.desc("count"), "t").limit(COMMON).orderBy("count", F.desc("t"))
    )
    return [r["t"] for r in top.collect()]


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def word_sets(df: DataFrame, col: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Sets of words as sorted 64-bit hashes, which are smaller and quicker to compare than the words."""
    words = F.array_sort(F.array_distinct(F.transform(tokens(F.col(col)), lambda t: F.xxhash64(t))))
    return _folded(df, digest(F.col("payload")), row_id, words)


@F.pandas_udf(LONGS)
def parity_bits(sets: pd.Series) -> pd.Series:
    """``BITS`` bits per set, each the parity of the number of members that hash to it."""
    made = []
    for members in sets:
        counts = np.bincount(np.asarray(members, dtype=np.int64).view(np.uint64).astype(np.uint64) % np.uint64(BITS), minlength=BITS)
        made.append(np.packbits((counts & 1).astype(np.uint8)).view(np.int64))
    return pd.Series(made, dtype=object)


def _close_enough(threshold: float) -> Column:
    """Cheap exact test of a pair ``l, r`` of sets by size and parity bits, before the sets themselves are fetched.

    Sets of ``n`` and ``m`` members with Jaccard similarity >= t differ in at most ``n + m - 2 t (n + m) / (1 + t)``
    members, and every bit that differs stands for at least one of those.
    """
    l_n, r_n, t = F.col("l.n"), F.col("r.n"), F.lit(threshold)
    sizes = (r_n >= t * l_n - F.lit(1e-9)) & (l_n >= t * r_n - F.lit(1e-9))
    differing = sum(
        (F.bit_count(F.col("l.bits")[i].bitwiseXOR(F.col("r.bits")[i])) for i in range(BITS // 64)), F.lit(0)
    )
    return sizes & (differing <= (l_n + r_n) * (1 - t) / (1 + t) + F.lit(1e-6))


def near_duplicate_pairs(df: DataFrame, col: str, threshold: float, row_id: str = "row_id") -> DataFrame:
    """Rows with an earlier row whose word set has Jaccard similarity >= ``threshold``: ``id, other``.  Exact."""
    items, copies = word_sets(df, col, row_id)
    return copies.unionByName(earlier_similar(items, set_marks(items), threshold))


def _size_class(n: int) -> int:
    return int(2 * np.log2(n))


def _signed(own: np.ndarray) -> bytes:
    """Two to eight parity bits per member of a set, equally many in a size class."""
    width = 64 << max(0, int(2 * 2 ** ((_size_class(len(own)) + 1) / 2)) - 1 >> 6).bit_length()
    counts = np.bincount((own >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


@F.pandas_udf(T.BinaryType())
def signed_bits(sets: pd.Series) -> pd.Series:
    return pd.Series([_signed(np.asarray(members, dtype=np.int64).view(np.uint64)) for members in sets], dtype=object)


def set_marks(items: DataFrame) -> DataFrame:
    """What stands for a set where sets are compared (stored): ``id, n, size`` (class of ``n``), ``signed``, ``leads``.

    ``signed`` holds two to eight parity bits per member, equally many in a class.  ``leads`` are ``LEADS`` hashes of two MinHash values
    each, of the members that are not among the most frequent ones; similar sets are likely to share one.
    """
    frequent = np.sort(np.array(common_tokens(items), np.int64).view(np.uint64))
    rng = np.random.default_rng(42)
    factors = rng.integers(1, 2**63, size=2 * LEADS, dtype=np.uint64) | np.uint64(1)

    @F.pandas_udf("n int, size int, signed binary, leads array<bigint>")
    def mark(sets: pd.Series) -> pd.DataFrame:
        rows = []
        for members in sets:
            own = np.asarray(members, dtype=np.int64).view(np.uint64)
            rare = np.setdiff1d(own, frequent, assume_unique=True)
            mixed = np.multiply.outer(rare if len(rare) else own, factors)
            lows = (mixed ^ (mixed >> np.uint64(32))).min(axis=0)
            leads = (lows[::2] * factors[0] ^ lows[1::2]) + np.arange(LEADS, dtype=np.uint64)
            rows.append((len(own), _size_class(len(own)), _signed(own), leads.view(np.int64)))
        return pd.DataFrame(rows, columns=["n", "size", "signed", "leads"])

    return cut_lineage(items.select("id", mark("payload").alias("m")).select("id", "m.*"))


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the members that are in one set only; the longer parity map is folded to the length of the shorter."""
    one, other = sorted((np.frombuffer(x, np.uint64) for x in (a, b)), key=len)
    while len(other) > len(one):
        other = other.reshape(2, -1)[0] ^ other.reshape(2, -1)[1]
    return int(np.bitwise_count(one ^ other).sum())


def _most_apart(n: Column | np.ndarray, m: Column | np.ndarray, threshold: float):
    """Sets of ``n`` and ``m`` members that are similar differ in at most so many."""
    return (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6


def settled_pairs(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (``id, other, apart``, stored) the similar ones, one per ``id``: the likeliest are compared first, the others if it fails."""
    similar = lambda a, b: jaccard(a, b) >= threshold
    best = cut_lineage(pairs.groupBy("id").agg(F.min(F.struct("apart", "other")).alias("m")).select("id", F.col("m.other").alias("other")))
    sure = cut_lineage(verified_sets(best, items, similar))
    rest = cut_lineage(pairs.select("id", "other").join(best, ["id", "other"], "left_anti").join(sure.select("id"), "id", "left_anti"))
    return sure.unionByName(verified_sets(rest, items, similar)).groupBy("id").agg(F.min("other").alias("other"))


def verified_sets(pairs: DataFrame, items: DataFrame, similar: Callable[[Column, Column], Column]) -> DataFrame:
    """``pairs`` (stored) that pass ``similar``; only the payloads that stand in a pair are fetched."""
    wanted = cut_lineage(pairs.select("id").union(pairs.select("other")).distinct())
    return _verified(pairs, cut_lineage(items.join(wanted, "id", "left_semi")), similar)


def led_similar(items: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """``id, other`` (stored) for sets that are similar to the first one under one of their ``leads``; ``items`` and ``marks`` are stored."""
    led = marks.select("id", F.explode("leads").alias("lead"))
    heads = led.groupBy("lead").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    to_heads = cut_lineage(lookup_join(led, heads, ["lead"], "id", "inner").where("other < id").select("id", "other").distinct())

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(map(_apart, a, b)), dtype="int32")

    apart = apart.asNondeterministic()  # else its filter works it out twice
    own = marks.select("id", F.struct("n", "signed").alias("a"))
    other = marks.join(cut_lineage(to_heads.select(F.col("other").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("other"), F.struct("n", "signed").alias("b"))
    both = lookup_join(to_heads, own, ["id"], "other", "inner")
    both = lookup_join(both, other, ["other"], "id", "inner").withColumn("apart", apart("a.signed", "b.signed"))
    likely = cut_lineage(both.where(F.col("apart") <= _most_apart(F.col("a.n"), F.col("b.n"), threshold)).select("id", "other", "apart"))
    return cut_lineage(settled_pairs(likely, items, threshold))


def earlier_similar(items: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """``id, other`` for every set that has an earlier similar one.  Exact; ``items`` and ``marks`` are stored.

    Each set is compared with the first one under each of its ``leads``; those that this leaves open meet the others in
    :func:`similar_grid`, one another once.
    """
    settled = led_similar(items, marks, threshold)
    later = cut_lineage(marks.drop("leads").join(settled.select("id"), "id", "left_anti"))
    done = cut_lineage(marks.drop("leads").join(settled.select("id"), "id", "left_semi"))
    late = similar_grid(later, None, threshold).unionByName(similar_grid(later, done, threshold))
    return settled.unionByName(settled_pairs(cut_lineage(late), items, threshold))


def similar_grid(later: DataFrame, earlier: DataFrame | None, threshold: float) -> DataFrame:
    """Pairs ``id, other, apart`` of a row of ``later`` and one of ``earlier`` with a smaller id that sizes and parity bits do not rule out;
    without ``earlier`` of any two rows of ``later``, each two met once.

    Both are stored sets of marks; if they have a column ``cluster``, pairs within one are left out.  The rows of a size class are dealt
    into chunks, and a task compares two chunks of classes that can hold similar sets, all rows of one with those of the other that are
    neither too small nor too large.  Only ids and parity bits travel, once per chunk met.  A class has at most ``GRID`` chunks of ``CHUNK``
    rows or more, so this does not grow with the rows, until the parity bits of a chunk reach ``GRID_BYTES``.  No pair is missed.
    """
    alone = earlier is None
    sides = (later, later if alone else earlier)
    columns = [c for c in ("id", "n", "signed", "cluster") if all(c in x.columns for x in sides)]
    told = F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.length("signed")).alias("wide")
    sizes = [{r["size"]: r for r in x.groupBy("size").agg(*told).collect()} for x in sides[: 1 if alone else 2]] * (2 if alone else 1)
    chunks = [{s: max(min(-(-r["k"] // CHUNK), GRID), -(-r["k"] * r["wide"] // GRID_BYTES)) for s, r in x.items()} for x in sizes]
    meets = lambda a, b: min(a["most"], b["most"]) >= threshold * max(a["least"], b["least"]) - 1e-9

    def partners(one: int) -> dict:
        own, other = sizes[one], 1 - one
        return {s: [(o, i) for o, b in sizes[other].items() if meets(a, b) for i in range(chunks[other][o])] for s, a in own.items()}

    if not sizes[0] or not sizes[1]:
        return sides[0].select("id", F.col("id").alias("other"), F.lit(0).alias("apart")).where("false")

    def by_size(of: dict, kind: str) -> Column:
        return F.create_map(*[x for s, v in of.items() for x in (F.lit(s), F.lit(v) if isinstance(v, int) else F.array(*[F.struct(F.lit(o).alias("s"), F.lit(i).alias("i")) for o, i in v]))])[F.col("size")].cast(kind)

    def laid(side: int, own: tuple[str, str], met: tuple[str, str]) -> DataFrame:
        dealt = F.pmod(F.xxhash64("id"), by_size(chunks[side], "int")).cast("int")
        at = F.explode(by_size(partners(side), "array<struct<s: int, i: int>>")).alias("met")
        out = sides[side].select(*[F.col(c).alias(c) for c in columns], F.col("size").alias(own[0]), dealt.alias(own[1]), at)
        return out.select(*columns, *own, F.col("met.s").alias(met[0]), F.col("met.i").alias(met[1]))

    cell, first = ["s", "i", "o", "j"], F.struct("s", "i") <= F.struct("o", "j")
    rows, others = laid(0, ("s", "i"), ("o", "j")), laid(1, ("o", "j"), ("s", "i"))
    if alone:
        rows, others = rows.where(first), others.where(first)

    def compare(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = (x.dropna(subset=["id"]).sort_values("n", kind="stable") for x in (one, two))
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
        either = alone and key[:2] != key[2:]  # two chunks that meet here only
        if len(one) and len(two):
            a, b = (np.frombuffer(b"".join(f["signed"]), np.uint64).reshape(len(f), -1) for f in (one, two))
            while a.shape[1] != b.shape[1]:
                a, b = (_half(a), b) if a.shape[1] > b.shape[1] else (a, _half(b))
            a_id, b_id, a_n, b_n = (f[c].to_numpy(np.int64) for c in ("id", "n") for f in (one, two))
            a_in, b_in = (f["cluster"].to_numpy(np.int64) if "cluster" in columns else None for f in (one, two))
            for x, y, gap in _close_rows(a, b, a_n, b_n, threshold):
                ok = (b_id[y] != a_id[x]) if either else (b_id[y] < a_id[x])
                ok &= (a_in[x] != b_in[y]) if a_in is not None else True
                x, y = x[ok], y[ok]
                found[0].append(np.maximum(a_id[x], b_id[y]))
                found[1].append(np.minimum(a_id[x], b_id[y]))
                found[2].append(gap[ok])
        return pd.DataFrame(dict(zip(("id", "other", "apart"), map(np.concatenate, found))))

    return rows.groupBy(*cell).cogroup(others.groupBy(*cell)).applyInPandas(compare, "id bigint, other bigint, apart int").dropDuplicates(["id", "other"])


def _half(bits: np.ndarray) -> np.ndarray:
    """Parity maps folded to half their length."""
    return bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]


def _close_rows(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, threshold: float):
    """Places ``x, y`` and the distance of the parity maps of ``a`` and ``b`` (rows in order of their sizes) that sizes and bits do not rule out.

    All are compared on folded maps, which bound the distance from below as well, and those left on the whole ones.  How far to fold is
    told by a few rows, and steers the time alone.
    """
    some, every = np.linspace(0, len(a) - 1, min(len(a), 32)).astype(int), np.linspace(0, len(b) - 1, min(len(b), 512)).astype(int)
    most, levels, costs = _most_apart(a_n[some, None], b_n[every], threshold), [(a, b)], []
    while levels[-1][0].shape[1] > 1:
        levels.append(tuple(map(_half, levels[-1])))
    for one, two in levels:
        left = np.bitwise_count(one[some, None] ^ two[every]).sum(axis=2, dtype=np.int64) <= most
        costs.append(one.shape[1] + 1 + left.mean() * (20 + 5 * a.shape[1]))
    one, two = levels[int(np.argmin(costs))]
    whole, two = one.shape[1] == a.shape[1], np.ascontiguousarray(two.T)
    at = 0
    while at < len(a):
        lo = np.searchsorted(b_n, math.ceil(threshold * a_n[at] - 1e-6))
        upto = min(len(a), at + 256)
        hi = np.searchsorted(b_n, math.floor(a_n[at : upto].max() / threshold + 1e-6), "right") if threshold > 0 else len(b_n)
        upto = min(upto, at + max(1, (1 << 16) // max(1, hi - lo)))
        if hi > lo:
            part, apart = one[at:upto], np.zeros((upto - at, hi - lo), np.uint16)
            for w in range(len(two)):
                apart += np.bitwise_count(part[:, w, None] ^ two[w, lo:hi])
            bound = _most_apart(a_n[at:upto], b_n[hi - 1], threshold).astype(np.int64).clip(0, 65535).astype(np.uint16)
            x, y = np.divmod(np.flatnonzero(apart <= bound[:, None]), hi - lo)
            gap, x, y = apart[x, y].astype(np.int32), x + at, y + lo
            for piece in range(0, len(x), 1 << 16):
                u, v = x[piece : piece + (1 << 16)], y[piece : piece + (1 << 16)]
                g = gap[piece : piece + (1 << 16)] if whole else np.bitwise_count(a[u] ^ b[v]).sum(axis=1, dtype=np.int32)
                ok = (g <= _most_apart(a_n[u], b_n[v], threshold)) & (np.minimum(a_n[u], b_n[v]) >= threshold * np.maximum(a_n[u], b_n[v]) - 1e-9)
                yield u[ok], v[ok], g[ok]
        at = upto


def near_duplicate_text(
    df: DataFrame, col: str, threshold: float = 0.65, row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """Rows that nearly repeat an earlier text."""
    found = near_duplicate_pairs(df, col, threshold, row_id).withColumnRenamed("id", "row_id")
    return to_findings(found, dataset, col, "duplicate_row", f"near_duplicate_text:{col}", expected=F.col("other"))


def min_hashes(count: int):
    """Vectorised MinHash signature of a set of 64-bit hashes: ``count`` odd multipliers and shifts from a fixed seed."""
    rng = np.random.default_rng(42)
    factors = rng.integers(1, 2**63, size=count, dtype=np.uint64) | np.uint64(1)
    offsets = rng.integers(0, 2**63, size=count, dtype=np.uint64)

    @F.pandas_udf(LONGS)
    def sign(sets: pd.Series) -> pd.Series:
        made = []
        for members in sets:
            h = np.asarray(members, dtype=np.int64).view(np.uint64)
            mixed = np.multiply.outer(h, factors) + offsets
            mixed ^= mixed >> np.uint64(32)
            made.append(mixed.min(axis=0).view(np.int64))
        return pd.Series(made, dtype=object)

    return sign


def near_duplicate_lsh(
    df: DataFrame, col: str, threshold: float = 0.65, bands: int = 20, rows_per_band: int = 4, row_id: str = "row_id",
    dataset: str = "data",
) -> DataFrame:
    """The same by MinHash bands: cheaper on long texts, may miss pairs near the threshold, never reports a false one."""
    items, copies = word_sets(df, col, row_id)

    def band(i: int) -> Column:
        return F.xxhash64(F.lit(i), *[F.col("lows")[i * rows_per_band + j] for j in range(rows_per_band)])

    marks = cut_lineage(items.select("id", F.size("payload").alias("n"), parity_bits("payload").alias("bits"), signed_bits("payload").alias("signed")))
    lows = items.select("id", min_hashes(bands * rows_per_band)("payload").alias("lows"))
    blocks = cut_lineage(lows.select("id", F.explode(F.array(*[band(i) for i in range(bands)])).alias("block")))

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(map(_apart, a, b)), dtype="int32")

    apart = apart.asNondeterministic()  # else its filter works it out twice

    def close(pairs: DataFrame) -> DataFrame:
        most = _most_apart(F.col("l.n"), F.col("r.n"), threshold)
        told = pairs.where(_close_enough(threshold)).select(
            F.struct("l.id").alias("l"), F.struct("r.id").alias("r"), apart("l.signed", "r.signed").alias("apart"), most.alias("most"))
        return told.where("apart <= most")

    found = copies.unionByName(earlier_match(items, blocks, lambda a, b: jaccard(a, b) >= threshold, marks=marks, close=close))
    return to_findings(found.withColumnRenamed("id", "row_id"), dataset, col, "duplicate_row",
                       f"near_duplicate_lsh:{col}", expected=F.col("other"))


def hyperplane(plane: int, dims: int) -> list[int]:
    """Signs of a pseudo-random hyperplane, from the bits of a digest so that any engine can rebuild them."""
    bits: list[int] = []
    block = 0
    while len(bits) < dims:
        raw = hashlib.md5(f"plane:{plane}:{block}".encode()).digest()
        bits.extend(1 if byte >> k & 1 else -1 for byte in raw for k in range(8))
        block += 1
    return bits[:dims]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def bucket_keys(dims: int, tables: int, bits: int):
    """Vectorised function from vectors to one bucket number per table: the signs of ``bits`` projections."""
    planes = np.array([hyperplane(i, dims) for i in range(tables * bits)], dtype=np.float64)
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf(LONGS)
    def buckets(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        signs = (np.stack(vectors.to_numpy()).astype(np.float64) @ planes.T >= 0).reshape(-1, tables, bits)
        numbers = signs.astype(np.int64) @ weights + (np.arange(tables, dtype=np.int64) << bits)
        return pd.Series(list(numbers))

    return buckets


def earlier_in_buckets(items: DataFrame, buckets, threshold: float) -> DataFrame:
    """``id, other`` for every vector with an earlier one at a cosine of at least ``threshold`` in one of its buckets.

    As :func:`earlier_match`, but the rows that no first row of a bucket settles meet in tasks as matrices, so the pairs of a bucket are
    neither listed nor shuffled: a task returns one sure partner per row, or all whose cosine is too near the threshold for rounding,
    and these are looked at by the exact expression.  ``items`` (``id, payload``) is stored.
    """
    similar = lambda a, b: cosine(a, b) >= threshold
    blocks = cut_lineage(items.select("id", F.explode(buckets("payload")).alias("block")))
    heads = cut_lineage(blocks.groupBy("block").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    led = lookup_join(blocks, heads, ["block"], "id", "inner").where("head < id")
    settled = cut_lineage(_verified(cut_lineage(led.select("id", F.col("head").alias("other")).distinct()), items, similar).groupBy("id").agg(F.min("other").alias("other")))

    parts = F.ceil(F.col("members") / F.lit(CHUNK)).cast("int")
    mine, every = F.pmod(F.xxhash64("id"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    sizes = heads.where("members > 2")

    def met(rows: DataFrame, own: str, all_: str) -> DataFrame:
        whole = rows.where("id IS NOT NULL").where(F.forall("payload", lambda x: x.isNotNull()))  # a cosine with a null is no cosine
        dealt = lookup_join(whole.select("id", "payload", F.explode(buckets("payload")).alias("block")), sizes, ["block"], "id", "inner").where("id <> head")
        return dealt.withColumn(own, mine).withColumn(all_, F.explode(every)).select(*[F.col(c).alias(c) for c in ("block", "x", "y", "id", "payload")])

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": [], "other": []}, dtype="int64")]
        if len(one) and len(two):
            b, b_id = np.stack(two["payload"].to_numpy()).astype(np.float64), two["id"].to_numpy(np.int64)
            with np.errstate(all="ignore"):
                b_size = np.sqrt((b * b).sum(axis=1))
                for at in range(0, len(one), 512):
                    part = one.iloc[at : at + 512]
                    a, a_id = np.stack(part["payload"].to_numpy()).astype(np.float64), part["id"].to_numpy(np.int64)
                    size = np.sqrt((a * a).sum(axis=1))[:, None] * b_size[None, :]
                    close = np.where(size == 0, -2.0, a @ b.T / size)
                    earlier = b_id[None, :] < a_id[:, None]
                    sure = ~(close < threshold + 1e-9) & earlier  # what is no number counts as large, as in Spark
                    some = sure.any(axis=1)
                    x, y = np.nonzero((close >= threshold - 1e-9) & earlier & ~some[:, None])
                    found += [pd.DataFrame({"id": a_id[some], "other": b_id[sure[some].argmax(axis=1)]}), pd.DataFrame({"id": a_id[x], "other": b_id[y]})]
        return pd.concat(found)

    cell = ["block", "x", "y"]
    later = met(items.join(settled.select("id"), "id", "left_anti"), "x", "y").groupBy(*cell)
    pairs = later.cogroup(met(items, "y", "x").groupBy(*cell)).applyInPandas(compare, "id bigint, other bigint")
    late = _verified(cut_lineage(pairs.distinct()), items, similar).groupBy("id").agg(F.min("other").alias("other"))
    return settled.unionByName(late)


def semantic_duplicate(
    df: DataFrame, vector: str, dims: int, threshold: float = 0.95, tables: int = 16, bits: int = 8,
    row_id: str = "row_id", dataset: str = "data",
) -> DataFrame:
    """Rows whose vector is nearly parallel to an earlier one in the same bucket of some table.

    Cosines are exact; buckets may miss pairs (for cosine 0.95, 16 tables of 8 bits miss about 1 in 7,000).
    """
    items, copies = _folded(df, digest(F.col("payload")), row_id, F.col(vector))
    found = copies.unionByName(earlier_in_buckets(items, bucket_keys(dims, tables, bits), threshold))
    return to_findings(found.withColumnRenamed("id", "row_id"), dataset, vector, "duplicate_row",
                       f"semantic_duplicate:{vector}", expected=F.col("other"))
