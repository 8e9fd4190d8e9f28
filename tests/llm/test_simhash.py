import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tablewarden.llm import simhash
from tablewarden.llm.components import components


def plain_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(pairs):
    """Smallest id of each row's group, over all pairs of fingerprints."""
    parent = {fp: fp for _, fp in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(parent)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                parent[find(x)] = find(y)
    least = defaultdict(list)
    for doc_id, fp in pairs:
        if doc_id is not None:
            least[find(fp)].append(doc_id)
    return [(doc_id, f"{fp:016x}", min(least[find(fp)], default=None)) for doc_id, fp in pairs]


def texts(n=500):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdeé", k=4)) for _ in range(300)]
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.5:
            body = (draw.choice(rows)[1] or "").split(" ")
            body[draw.randrange(len(body))] = draw.choice(words)
            rows.append((i + 10, " ".join(body)))
        else:
            rows.append((i + 10, " ".join(draw.choices(words, k=draw.choice([1, 2, 3, 40, 150])))))
    return rows + [(3, None), (700, ""), (701, " \n"), (None, rows[0][1]), (None, "alone without id here"), (12, rows[0][1]), (12, rows[0][1]), (800, "W " * 200_000), (801, "W X")]


def test_rows_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(plain_groups([(i, plain_print(t)) for i, t in rows]), key=str)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_large_buckets_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw = np.random.default_rng(1)
    centres = draw.integers(0, 2**63, 4)
    prints = {int(c) for c in centres}
    while len(prints) < 800:
        prints.add(int(draw.choice(list(prints))) ^ (1 << int(draw.integers(0, 62))) ^ (1 << int(draw.integers(0, 62))))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for parts in [[(list(range(i * 16, i * 16 + 16)), 0) for i in range(4)], [(list(range(0, 64, 2)), 1), (list(range(1, 64, 2)), 1)], [(list(range(20)), -1), (list(range(20, 42)), 1), (list(range(42, 64)), 1)]]:
        found = components(simhash.links(simhash.spread_buckets(simhash.meeting_points(df, parts)), 3, 1000)).collect()
        root = dict(found)
        want = plain_groups([(p, p) for p in prints])
        assert [root.get(p, p) for p in prints] == [w[2] for w in want]


def test_thresholds_are_the_cheapest():
    from itertools import product

    draw = np.random.default_rng(3)
    for m in (2, 3, 4, 6):
        costs = np.cumsum(draw.random((m, 5)), 1)
        cost, picked = simhash.allocate(costs, 4)
        least = min(sum(costs[i, t + 1] for i, t in enumerate(ts)) for ts in product(range(-1, 4), repeat=m) if sum(ts) == 4 - m)
        assert sum(picked) == 4 - m and cost == pytest.approx(least) and cost == pytest.approx(sum(costs[i, t + 1] for i, t in enumerate(picked)))


def test_correlated_bits_come_together():
    draw = np.random.default_rng(4)
    bits = draw.integers(0, 2, (5000, 64))
    for a, b in [(0, 40), (1, 41), (2, 42)]:
        bits[:, b] = bits[:, a]
    groups = simhash.group_bits(5000, (bits.T @ bits).astype(float), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(any({a, b} <= set(g) for g in groups) for a, b in [(0, 40), (1, 41), (2, 42)])


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "quite another text here"), (None, "a b c d e")]
    kept = simhash.keep_one(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "a b c d e", "s"), (9, "quite another text here", "s"), (None, "a b c d e", "s")], key=str)


def test_an_empty_table_gives_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "a b c d e"), (1, "quite another text here"), (2, "quite another text here"), (2, "and a third one of words")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e"), (1, "quite another text here"), (2, "and a third one of words")]
