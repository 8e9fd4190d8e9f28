"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together.  Part i gets its own threshold t_i of at least -1, with
sum(t_i + 1) = distance + 1, so any two fingerprints within the distance are within t_i in some part.  The thresholds come from a
dynamic programme on the candidates that each part is estimated to give at each threshold, and on the probes it costs.  Every
fingerprint is indexed under the value of each part in use, and probes the values within t_i of its own; what meets is verified
on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stages_pass
from .common import batches_by_size, cut_lineage, join_small, rows_of, tasks_for
from .components import components

BITS = 64
BUCKET = 4096  # fingerprints compared in one piece; larger buckets become a grid of pieces


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; without words zero."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, so A-Z alone and the six spaces alone
    if not data:
        return 0
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    ends = np.cumsum(sizes)
    starts, line = ends - sizes, b" ".join(data)
    width = min(width, len(data))
    cuts = map(slice, starts[: len(data) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(seed)), np.uint64, len(data) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((counts * 2 > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id``, ``own`` (hash of the text), ``fp`` (the 64 bits as a signed long).  Null text counts as empty."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_by_size(frames, "text", 32_000_000):
            made = np.array([fingerprint(t, width) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "own": frame["own"], "fp": made})

    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), own=_own(text_col), text=text_col)
    return flat.mapInPandas(work, "doc_id bigint, own bigint, fp bigint")


def _own(text_col: str) -> Column:
    """Tells rows that share an id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


# --- the plan: parts and thresholds ----------------------------------------------------------------------------------

def joint_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set, over all of them; 64 x 64 sums reach the driver."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        n = 0
        for frame in frames:
            bits = _bits(frame["fp"].to_numpy()).astype(np.float32)
            total += bits.T @ bits
            n += len(frame)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": [*i, -1], "j": [*j, -1], "n": [*total.ravel(), n]})

    sums = prints.mapInPandas(work, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, count in sums:
        if i < 0:
            n = int(count)
        else:
            both[i, j] = count
    return n, both


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Equal parts, each grown from the bit most correlated with those left by adding the bit most correlated with the part."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (tie[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def within(group: list[int], share: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most e bits of the group, e = 0..most, from each bit's own chance to differ."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for b in group:
        differ = 2 * share[b] * (1 - share[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return np.cumsum(chance[: most + 1])


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds with the least summed cost: ``costs[i, t + 1]`` for t = -1..distance, sum(t_i + 1) = ``total``."""
    best = np.full((len(costs) + 1, total + 1), np.inf)
    best[0, 0], pick = 0.0, np.zeros((len(costs) + 1, total + 1), int)
    for i, row in enumerate(costs):
        for used in range(total + 1):
            for step in range(min(used, len(row) - 1) + 1):
                if (cost := best[i, used - step] + row[step]) < best[i + 1, used]:
                    best[i + 1, used], pick[i + 1, used] = cost, step
    out, used = [], total
    for i in range(len(costs), 0, -1):
        out.append(int(pick[i, used]) - 1)
        used -= pick[i, used]
    return float(best[-1, total]), out[::-1]


def _value(group: list[int]) -> Column:
    """The bits of a group as one number."""
    made = F.lit(0).cast("bigint")
    for at, bit in enumerate(group):
        made = made.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1).cast("bigint")), at))
    return made


def plan(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds for all fingerprints of ``prints``.

    Candidates of a part at threshold e are estimated from the bits' shares, and set right by the pairs that really share a value
    of it (a count over all fingerprints).  A probe costs as much as ``PROBE`` verified candidates.
    """
    n, both = joint_counts(prints)
    share = np.diag(both) / max(n, 1)

    def costs(groups: list[list[int]], factors: list[float]) -> np.ndarray:
        made = np.zeros((len(groups), distance + 2))
        for i, (group, factor) in enumerate(zip(groups, factors)):
            near = within(group, share, distance)
            for e in range(distance + 1):
                made[i, e + 1] = min(factor * near[e], 1.0) * n * n + PROBE * n * ball(len(group), e)
        return made

    options = [group_bits(n, both, m) for m in range(2, distance + 4)]
    groups = min(options, key=lambda g: allocate(costs(g, [1.0] * len(g)), distance + 1)[0])
    shared = prints.select(F.posexplode(F.array(*map(_value, groups))).alias("part", "value")).groupBy("part", "value").agg(F.count(F.lit(1)).cast("double").alias("k"))
    pairs = dict(shared.groupBy("part").agg(F.sum(F.col("k") * F.col("k"))).collect())
    factors = [pairs.get(i, 0.0) / max(n * n * within(g, share, 0)[0], 1e-9) for i, g in enumerate(groups)]
    return list(zip(groups, allocate(costs(groups, factors), distance + 1)[1]))


PROBE = 20


# --- candidates and links --------------------------------------------------------------------------------------------

def _points(part: Column, own: Column, masks: Column) -> Column:
    return F.transform(masks, lambda mask: F.struct(part.alias("part"), own.bitwiseXOR(mask).alias("value")))


def meeting_points(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part``, ``value``, ``fp``: where each fingerprint is indexed and where it probes."""
    points = []
    for i, (group, radius) in enumerate(parts):
        if radius < 0:
            continue
        masks = [sum(1 << b for b in some) for k in range(radius + 1) for some in combinations(range(len(group)), k)]
        points.append(_points(F.lit(i), _value(group), F.array(*[F.lit(m).cast("bigint") for m in masks])))
    return prints.select("fp", F.explode(F.concat(*points)).alias("at")).select("at.part", "at.value", "fp")


def spread_buckets(points: DataFrame) -> DataFrame:
    """Buckets of more than ``BUCKET`` rows are cut into a grid: their fingerprints fall into chunks, and each pair of chunks is
    one piece.  No candidate is lost and no piece exceeds about twice ``BUCKET``."""
    large = cut_lineage(points.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET))
    marked = join_small(points, large, ["part", "value"], "left")
    chunks = F.coalesce(F.ceil(F.col("n") / BUCKET), F.lit(1)).cast("bigint")
    one = marked.select("part", "value", "fp", chunks.alias("k"), F.pmod(F.xxhash64("fp"), chunks).alias("c"))
    pieces = one.withColumn("d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    return pieces.select("part", "value", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"), "fp")


def forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each fingerprint of a piece with the first of its group: reachable by steps within the distance."""
    left, nodes, roots = np.unique(prints), [], []
    while len(left):
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= distance
            if near.any():
                found = left[near]
                nodes.append(found)
                roots.append(np.full(len(found), root))
                todo.extend(found)
                left = left[~near]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *nodes]), np.concatenate([empty, *roots])


def links(points: DataFrame, distance: int, rows: int) -> DataFrame:
    """``a``, ``b``: links that connect the same fingerprints as all pairs within the distance do, at most one per point.

    Small buckets are compared by shifting the sorted rows against themselves; larger ones grow a forest."""
    small = 32

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in _with_end(frames):
            rows = frame if held is None else held if frame is None else pd.concat([held, frame], ignore_index=True)
            if rows is None or rows.empty:
                held = rows
                continue
            keys = rows[["part", "value", "c", "d"]].to_numpy()
            fps = rows["fp"].to_numpy()
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
            starts = np.flatnonzero(new)
            if frame is not None:  # the last bucket may go on in the next batch
                held, fps, new = rows.iloc[starts[-1] :], fps[: starts[-1]], new[: starts[-1]]
                starts = starts[:-1]
            sizes = np.diff(np.append(starts, len(fps)))
            bucket = np.cumsum(new) - 1
            a, b = [], []
            for shift in range(1, min(small, int(sizes.max(initial=0)))):
                hit = (bucket[shift:] == bucket[:-shift]) & (np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= distance) & (sizes[bucket[shift:]] <= small)
                a.append(fps[shift:][hit])
                b.append(fps[:-shift][hit])
            for at in np.flatnonzero(sizes > small):
                one, other = forest(fps[starts[at] : starts[at] + sizes[at]], distance)
                a.append(one)
                b.append(other)
            empty = np.zeros(0, np.int64)
            made = pd.DataFrame({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})
            yield made[made["a"] != made["b"]].drop_duplicates()

    order = ["part", "value", "c", "d"]
    return points.repartition(tasks_for(points.sparkSession, rows, 500_000), *order).sortWithinPartitions(*order).mapInPandas(work, "a bigint, b bigint")


def _with_end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, the smallest id reachable over links of
    at most ``distance`` differing bits, its own included.

    Equal fingerprints are folded before any are compared.  Null and empty texts have the fingerprint zero and are linked like any
    other.  Rows without id are fingerprinted and linked, but give no component its id; where no row has one it is null.  Repeated
    rows are kept.  An empty table gives no rows.
    """
    found = _grouped(docs, distance, width, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, distance: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``own``, ``fp``, ``component_id`` of every row."""
    all_prints = cut_lineage(fingerprints(docs, id_col, text_col, width))
    prints = cut_lineage(all_prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = plan(prints, distance)
    rows = prints.count() * sum(ball(len(g), t) for g, t in parts if t >= 0)
    roots = components(links(spread_buckets(meeting_points(prints.select("fp"), parts)), distance, rows))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return all_prints.join(named, "fp").select("doc_id", "own", "fp", "component_id")


def first_of_groups(docs: DataFrame, distance: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``own`` (hash of the text; stored) of the rows with the smallest id of each component."""
    with stages_pass() as made:
        found = _grouped(docs, distance, width, id_col, text_col)
        first = cut_lineage(found.where("doc_id = component_id").select("doc_id", "own").distinct())
        made.remove(first)
    return first


def keep_one(docs: DataFrame, distance: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (once, if its row is repeated; rows that share an id but
    not the text are told apart).  Rows without an id cannot be told apart and all stay."""
    first = first_of_groups(docs, distance, width, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"))
    marked = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__own": _own(text_col)})
    kept = join_small(marked, first, ["__id", "__own"], "left_semi").dropDuplicates(["__id", "__own"])
    return kept.unionByName(marked.where("__id IS NULL")).drop("__id", "__own")
