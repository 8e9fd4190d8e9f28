"""Components, near-copy clusters and their label votes against plain Python."""

import random

from tablewarden.operators import clusters


def plain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            one, other = sorted((find(a), find(b)))
            root[other] = one
    return {x: find(x) for x in list(root)}


def test_components_equal_union_find(spark):
    draw = random.Random(4)
    links = [(draw.randint(0, 900), draw.randint(0, 900)) for _ in range(600)] + [(5, 5), (None, 3), (7, None)] + [(2000, i) for i in range(2001, 2400)]
    got = {r["id"]: r["cluster"] for r in clusters.connected(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == plain_components(links)
    assert clusters.connected(spark.createDataFrame([], "x long, y long")).count() == 0


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    n, stored = 10_000, []
    keep = clusters.cut_lineage
    monkeypatch.setattr(clusters, "cut_lineage", lambda df: stored.append(1) or keep(df))
    order = list(range(n))
    random.Random(1).shuffle(order)
    got = clusters.connected(spark.createDataFrame(list(zip(order, order[1:])), "x long, y long")).collect()
    assert len(got) == n and {r["cluster"] for r in got} == {0}
    assert len(stored) <= 40


def texts():
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = []
    for i in range(250):
        body = draw.choices(words, k=draw.choice([4, 12, 40]))
        if rows and draw.random() < 0.6:
            body = draw.choice(rows)[1].split()
            for _ in range(draw.randint(0, max(1, len(body) // 6))):
                body[draw.randrange(len(body))] = draw.choice(words)
        rows.append((i, " ".join(body), draw.choice([0, 1])))
    return rows + [(900, None, 1), (901, "", 0), (902, " !", 1), (None, rows[0][1], 1)]


def plain_clusters(rows, threshold):
    sets = {i: set((t or "").lower().split()) for i, t, _ in rows if i is not None}
    sets = {i: s for i, s in sets.items() if s and s != {"!"}}
    close = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    return plain_components(close)


def test_clusters_equal_all_pairs(spark):
    rows = texts()
    for threshold in (0.65, 0.8):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label int, cluster string, n int")
        got = {r["id"]: r["cluster"] for r in clusters.near_clusters(df.drop("cluster"), "text", threshold, "doc_id").collect()}
        assert got == plain_clusters(rows, threshold)


def test_a_bridge_joins_two_groups(spark):
    """c is like a and like b, which are unlike each other: all three are one cluster."""
    base = [f"w{i}" for i in range(20)]
    a, b, c = base[:16], base[4:], base[2:18]
    df = spark.createDataFrame([(1, " ".join(a), 0), (2, " ".join(b), 0), (3, " ".join(c), 1)], "doc_id long, text string, label int")
    assert {tuple(r) for r in clusters.near_clusters(df, "text", 0.75, "doc_id").collect()} == {(1, 1), (2, 1), (3, 1)}
    wrong = clusters.label_by_cluster(df, "text", "label", 0.75, "doc_id").collect()
    assert [(r["row_id"], r["observed"], r["expected"]) for r in wrong] == [(3, "1", "0")]
    assert clusters.label_conflict_near(df, "text", ["label"], 0.75, "doc_id").count() == 3
