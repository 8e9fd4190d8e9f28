"""The plans for tables too large to broadcast give the same rows as the plain ones."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewarden.operators import keyed, ordered, relations, similarity, skew, spelling, statistics
from tablewarden.session import cut_lineage


def hot_rows(spark, n=3000):
    """A third of the rows share one key."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 400)}", rng.randint(0, 1000), float(rng.randint(0, 50))) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, k string, t int, v double").repartition(7)


def test_lookup_join_equals_a_plain_join(no_broadcast):
    rows = hot_rows(no_broadcast)
    facts = rows.groupBy("k").agg(F.max("v").alias("top")).where("k <> 'k7'")
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.lookup_join(rows, facts, ["k"], "row_id", how).select("row_id", "top").collect()), key=str)
        want = sorted(map(tuple, rows.join(facts, "k", how).select("row_id", "top").collect()), key=str)
        assert got == want


def test_a_hot_key_is_spread_over_all_partitions(no_broadcast):
    rows = hot_rows(no_broadcast)
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.lookup_join(rows, facts, ["k"], "row_id", "inner").withColumn("p", F.spark_partition_id())
    biggest = joined.groupBy("p").count().agg(F.max("count")).first()[0]
    no_broadcast.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        biggest = joined.groupBy("p").count().agg(F.max("count")).first()[0]
    finally:
        no_broadcast.conf.set("spark.sql.adaptive.enabled", "true")
    assert biggest < 1000  # the hot key alone has 1000 rows


def test_facts_of_hot_keys_are_repeated_in_step_with_the_partitions(no_broadcast):
    got = {r.k: r["__salts"] for r in skew.hot_salts(hot_rows(no_broadcast), ["k"]).collect()}
    partitions = int(no_broadcast.conf.get("spark.sql.shuffle.partitions"))
    assert len(got) == skew.hot_limit(hot_rows(no_broadcast)) and sum(got.values()) <= (skew.SALTS + 20) * partitions
    assert got["hot"] > 50 * max(v for k, v in got.items() if k != "hot")


@pytest.mark.parametrize("groups", [["k"], []])
def test_carry_in_slices_equals_a_window(spark, groups):
    rows = hot_rows(spark).withColumn("v", F.when(F.col("row_id") % 5 != 0, F.col("v")))
    order = Window.partitionBy(*groups).orderBy("t", "row_id")
    back, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    want = {r.row_id: (r.a, r.b) for r in rows.select(
        "row_id", F.last("v", ignorenulls=True).over(back).alias("a"), F.max("v").over(so_far).alias("b")).collect()}
    last = skew.carry(rows, "v", "t", "row_id", groups, "last", split=True)
    top = skew.carry(rows, "v", "t", "row_id", groups, "max", split=True)
    assert {r.row_id: r.carried for r in last.collect()} == {k: v[0] for k, v in want.items()}
    assert {r.row_id: r.carried for r in top.collect()} == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("how", ["last", "max"])
def test_carry_agrees_in_slices_with_missing_and_equal_orders(spark, how):
    rows = [(i, "g" if i % 2 else "h", None if i % 5 == 0 else 7 if i % 3 else i, None if i % 7 == 0 else float(i % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, k string, t int, v double").repartition(5)
    for groups in (["k"], []):
        whole, cut = (skew.carry(df, "v", "t", "row_id", groups, how, split=s).select("row_id", "carried").collect() for s in (False, True))
        assert sorted(whole) == sorted(cut)


def test_one_shared_order_value_is_cut_into_slices(spark):
    df = spark.range(10_000).select(F.col("id").alias("row_id"), F.lit(1).alias("t"), F.col("id").cast("double").alias("v"))
    cut = skew.carry(df, "v", "t", "row_id", [], "max", split=True)
    assert {r.row_id: r.carried for r in cut.collect()} == {i: float(i) for i in range(10_000)}
    assert "Window [" in cut._jdf.queryExecution().executedPlan().toString()


def test_few_facts_of_a_large_aggregate_are_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        rows = spark.range(200_000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("k"))
        facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        plan = skew.lookup_join(rows, facts, ["k"], "row_id", "inner")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.set(key, before)


def test_carry_slices_text_order(spark):
    rows = hot_rows(spark).withColumn("name", F.lpad(F.col("t").cast("string"), 5, "x"))
    got = {r.row_id: r.carried for r in skew.carry(rows, "v", "name", "row_id", ["k"], split=True).collect()}
    want = {r.row_id: r.carried for r in skew.carry(rows, "v", "name", "row_id", ["k"], split=False).collect()}
    assert got == want


def test_quantiles_by_brackets_are_exact(no_broadcast, monkeypatch):
    monkeypatch.setattr(statistics, "WHOLE", 100)
    monkeypatch.setattr(statistics, "SKETCH", 100)
    rows = hot_rows(no_broadcast, 4000).withColumn("v", F.col("v") + F.col("t") / 7)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: tuple(r[f"q{i}"] for i in range(5)) for r in statistics.exact_quantiles(rows, "k", "v", shares).collect()}
    want = {r.k: tuple(r.p) for r in rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


def test_copies_of_a_hot_key(no_broadcast):
    rows = hot_rows(no_broadcast)
    got = {(r.row_id, int(r.expected)) for r in keyed.duplicate_key(rows, ["k"]).collect()}
    first = {}
    for r in rows.collect():
        first[r.k] = min(first.get(r.k, r.row_id), r.row_id)
    assert got == {(r.row_id, first[r.k]) for r in rows.collect() if r.row_id > first[r.k]}


def words(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))


def near_texts(spark, n=160):
    """A third of the texts are near copies of one, some are exact copies."""
    rng, rows = random.Random(11), []
    base = words(rng, 40)
    for i in range(n):
        if i % 3 == 0:
            parts = base.split()
            for _ in range(rng.randint(0, 6)):
                parts[rng.randrange(len(parts))] = f"z{rng.randint(0, 9)}"
            rows.append((i, " ".join(parts)))
        elif i % 10 == 1:
            rows.append((i, rows[rng.randrange(len(rows))][1].upper()))
        else:
            rows.append((i, words(rng, rng.randint(1, 30))))
    return rows, spark.createDataFrame(rows, "row_id long, text string").repartition(5)


@pytest.mark.parametrize("threshold, chunk", [(0.65, 20_000), (0.8, 3), (1.0, 20_000)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, threshold, chunk):
    monkeypatch.setattr(similarity, "CHUNK", chunk)
    rows, df = near_texts(spark)
    sets = [(i, set(t.lower().split())) for i, t in rows]
    want = {i for i, a in sets if any(j < i and len(a & b) / len(a | b) >= threshold - 1e-12 for j, b in sets)}
    got = [r.row_id for r in similarity.near_duplicate_text(df, "text", threshold).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))


def test_near_duplicates_of_tables_too_large_to_broadcast(no_broadcast, monkeypatch):
    monkeypatch.setattr(similarity, "COMMON", 5)
    rows, df = near_texts(no_broadcast, 90)
    sets = [(i, set(t.lower().split())) for i, t in rows]
    want = {i for i, a in sets if any(j < i and len(a & b) / len(a | b) >= 0.65 for j, b in sets)}
    assert {r.row_id for r in similarity.near_duplicate_text(df, "text", 0.65).collect()} == want
    lsh = {r.row_id for r in similarity.near_duplicate_lsh(df, "text", 0.65).collect()}
    assert lsh <= want and len(lsh) > len(want) / 2


def test_semantic_duplicates_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=16) for _ in range(60)]
    for i in range(40):
        vectors.append(vectors[i % 7] * 2 + rng.normal(size=16) * 0.05)
    unit = [v / np.linalg.norm(v) for v in vectors]
    want = {i for i in range(100) if any(float(unit[i] @ unit[j]) >= 0.95 for j in range(i))}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "row_id long, e array<float>").repartition(4)
    assert {r.row_id for r in similarity.semantic_duplicate(df, "e", 16, 0.95).collect()} == want


def test_spelling_blocks_find_every_near_word(spark):
    rng = random.Random(2)
    lexicon = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    seen = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(120)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    for k in (1, 2):
        want = {}
        for v in set(seen) - set(lexicon):
            near = sorted((distance(v, w), w) for w in set(lexicon) if distance(v, w) <= k)
            if near:
                want[v] = near[0]
        got = spelling.near_words(
            spark.createDataFrame([(v,) for v in seen], "v string"), "v", spark.createDataFrame([(w,) for w in lexicon], "w string"), "w", k)
        assert {r.value: (r.distance, r.nearest) for r in got.collect()} == want


def test_orphans_and_sums(no_broadcast):
    spark = no_broadcast
    child = spark.createDataFrame([(i, 9 if i % 3 else i % 4, 1.5) for i in range(60)], "row_id long, fk long, amount double")
    parent = spark.createDataFrame([(i, 30.0) for i in range(4)], "pk long, total double")
    found = {r.row_id for r in relations.referential_integrity(child, "fk", parent, "pk").collect()}
    assert found == {i for i in range(60) if i % 3}
    sums = {r.row_id for r in relations.aggregate_match(parent, "pk", "total", child, "fk", F.col("amount")).collect()}
    want = {k for k in range(4) if abs(1.5 * sum(1 for i in range(0, 60, 3) if i % 4 == k) - 30.0) > 0.01}
    assert sums == want


def test_gaps_and_repeats(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 2, 5, 6, 9, None])], "row_id long, id long").repartition(3)
    got = {(r.row_id, r.issue_type, r.expected) for r in ordered.sequential_id(df, "id").collect()}
    assert got == {(3, "inconsistent_value", "4"), (5, "inconsistent_value", "8"), (2, "duplicate_row", "1")}
    late = spark.createDataFrame([(2, 3), (3, 4)], "row_id long, id long")
    assert [r.expected for r in ordered.sequential_id(late, "id").collect()] == ["2"]
    assert ordered.sequential_id(late, "id", start=None).count() == 0


def test_chronology_steps_over_missing_times(spark):
    rows = [(1, 10), (2, None), (3, 5), (4, 7), (5, 6)]
    df = spark.createDataFrame(rows, "row_id long, ts int").repartition(3)
    assert {r.row_id for r in ordered.chronological(df, "ts", "row_id").collect()} == {3, 5}


def test_slices_follow_the_stored_size_not_the_planned_one(spark, monkeypatch):
    """Joins of joins are planned as the product of their inputs; the carried table is small all the same."""
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("k"), F.col("id").alias("t"), (F.col("id") * 31 % 97).alias("v"))
    wide = skew.cut_lineage(rows)
    joined = wide
    for i in range(6):
        joined = joined.join(skew.cut_lineage(rows).select("row_id", F.col("v").alias(f"v{i}")).hint("merge"), "row_id")
    assert skew.plan_bytes(joined) > 1 << 50
    stored = []
    monkeypatch.setattr(skew, "cut_lineage", lambda df: stored.append(cut_lineage(df)) or stored[-1])
    got = {r["row_id"]: r["best"] for r in skew.carry(joined, "v", "t", "row_id", ["k"], "max", "best").select("row_id", "best").collect()}
    best, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["t"]):
        best[r["k"]] = max(best.get(r["k"], -1), r["v"])
        want[r["row_id"]] = best[r["k"]]
    assert got == want
    assert sum(len(df.inputFiles()) for df in stored) <= 20


def test_texts_that_share_words_leave_few_rows_behind(spark, monkeypatch):
    """Meeting points are a few hashes a text, not a third of its words, and only likely pairs are kept."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.sample(vocabulary, 40))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(20)]
    stored = []
    monkeypatch.setattr(similarity, "cut_lineage", lambda df: stored.append(cut_lineage(df)) or stored[-1])
    got = similarity.near_duplicate_text(spark.createDataFrame(rows, "row_id long, text string"), "text", 0.65)
    assert {(r.row_id, r.expected) for r in got.collect()} == {(200 + i, str(i)) for i in range(20)}
    assert max(df.count() for df in stored) <= 8 * len(rows)


def test_slices_follow_the_rows_and_not_only_the_stored_columns(spark):
    """A table of equal values is stored as next to nothing; its rows still are not read by two tasks."""
    rows = spark.range(300_000).select(F.lit("e").alias("k"), F.col("id").alias("t"), *[F.lit(1.0).alias(f"v{i}") for i in range(40)])
    before, skew.SLICE_BYTES = skew.SLICE_BYTES, 8 << 20
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        carried = skew.carry(rows, "v0", "t", "t", ["k"], "max", "best")
        assert carried.where("best = 1.0").count() == 300_000
        assert skew.row_bytes(rows) * 300_000 > 10 * skew.SLICE_BYTES and len(carried.inputFiles()) > 10  # a stored slice is a file
    finally:
        skew.SLICE_BYTES = before
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_of_a_bucket_meet_without_a_list_of_pairs(spark):
    """Against brute force over shared buckets, with zero vectors, nulls, no numbers, pairs at the threshold; and one bucket of all rows
    hands on one pair a row."""
    import numpy as np

    draw = np.random.default_rng(4)
    v = draw.normal(size=(160, 8)).astype(np.float32)
    v[80:120] = v[:40] * 2 + draw.normal(size=(40, 8)).astype(np.float32) * np.float32(0.15)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(200, [0.0] * 8), (201, [0.0] * 7 + [None]), (202, [float("nan")] * 8)]
    items = cut_lineage(spark.createDataFrame(rows, "id long, payload array<float>"))
    want, cos = set(), lambda a, b: float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b))
    w = v.astype(np.float64)
    for i in range(160):
        if any(cos(w[i], w[j]) >= 0.9 for j in range(i)):
            want.add(i)
    one_bucket = F.udf(lambda x: [1], "array<long>")
    got = {r["id"]: r["other"] for r in similarity.earlier_in_buckets(items, one_bucket, 0.9).collect()}
    assert {i for i in got if i < 200} == want and 202 in got and 200 not in got and 201 not in got
    assert all(j < i for i, j in got.items())
    assert all(cos(w[i], w[j]) >= 0.9 - 1e-9 for i, j in got.items() if i < 200)


def test_long_texts_that_share_words_are_told_apart_before_their_words_travel(spark, monkeypatch):
    """512 parity bits say nothing about sets of a thousand words; bits in step with the size leave hardly a pair but the true ones."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, rng.sample(vocabulary, 1500)) for i in range(150)]
    rows += [(200 + i, rows[i][1][:1450] + ["more"]) for i in range(10)]
    rows = [(i, " ".join(t)) for i, t in rows]
    stored = []
    monkeypatch.setattr(similarity, "cut_lineage", lambda df: stored.append(cut_lineage(df)) or stored[-1])
    got = similarity.near_duplicate_lsh(spark.createDataFrame(rows, "row_id long, text string"), "text", 0.65)
    assert {(r.row_id, r.expected) for r in got.collect()} == {(200 + i, str(i)) for i in range(10)}
    sets = [df for df in stored if "payload" in df.columns and "key" not in df.columns]
    assert len(sets) > 1 and sum(df.count() for df in sets[1:]) <= 40  # beside the items themselves: sets fetched to be compared


def test_rows_of_blocks_meet_with_their_marks(no_broadcast):
    """Every pair of a block that the marks do not rule out is looked at, also in a grid of tasks and beside the leader."""
    spark = no_broadcast
    items = cut_lineage(spark.createDataFrame([(i, [i % 5, i % 2]) for i in range(60)], "id long, payload array<int>"))
    blocks = cut_lineage(spark.createDataFrame([(i, i % 3) for i in range(60)] + [(i, 7) for i in range(60)], "id long, block int"))
    marks = cut_lineage(items.select("id", F.col("payload")[0].alias("m")))
    before, similarity.CHUNK = similarity.CHUNK, 7
    try:
        found = similarity.earlier_match(items, blocks, lambda a, b: a == b, marks=marks, close=lambda pairs: pairs.where("l.m = r.m"))
        got = {r["id"]: r["other"] for r in found.collect()}
    finally:
        similarity.CHUNK = before
    assert set(got) == set(range(10, 60))
    assert all(j < i and (i - j) % 10 == 0 for i, j in got.items())


@pytest.mark.parametrize("grid", [1, 3])
def test_a_grid_meets_every_pair_once_and_rows_travel_in_step_with_it(spark, monkeypatch, grid):
    """Against all pairs, with and without clusters; however many rows a size class has, a row goes to few chunks."""
    import numpy as np

    monkeypatch.setattr(similarity, "CHUNK", 10)
    monkeypatch.setattr(similarity, "GRID", grid)
    draw, rows = random.Random(8), []
    for i in range(240):
        own = draw.sample(range(5000), draw.choice([1, 3, 8, 40, 60, 90])) if i % 3 else [x + (draw.random() < 0.1) for x in draw.choice(rows)[1]] if rows else [1, 2]
        rows.append((i, sorted({x * 7919 % 2**40 for x in own}) if i % 3 else sorted(set(own))))
    items = cut_lineage(spark.createDataFrame(rows, "id long, payload array<long>"))
    marks = similarity.set_marks(items).drop("leads").withColumn("cluster", F.col("id") % 4)
    signed = {i: (len(s), similarity._signed(np.array(s, np.int64).view(np.uint64))) for i, s in rows}
    close = lambda i, j: min(signed[i][0], signed[j][0]) >= 0.65 * max(signed[i][0], signed[j][0]) and similarity._apart(signed[i][1], signed[j][1]) <= similarity._most_apart(signed[i][0], signed[j][0], 0.65)
    want = {(i, j): similarity._apart(signed[i][1], signed[j][1]) for i in range(240) for j in range(i) if close(i, j)}
    pairs = lambda df: {(r["id"], r["other"]): r["apart"] for r in df.collect()}
    assert pairs(similarity.similar_grid(marks.drop("cluster"), None, 0.65)) == want and len(want) > 40
    assert pairs(similarity.similar_grid(marks, None, 0.65)) == {p: n for p, n in want.items() if (p[0] - p[1]) % 4}
    odd, even = marks.drop("cluster").where("id % 2 = 1"), marks.drop("cluster").where("id % 2 = 0")
    assert pairs(similarity.similar_grid(odd, even, 0.65)) == {p: n for p, n in want.items() if p[0] % 2 and not p[1] % 2}
    assert similarity.similar_grid(odd, even.where("false"), 0.65).count() == 0


def test_shuffles_of_a_stage_are_deleted_with_its_write(spark):
    frame = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "k")
    left = lambda: set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = left()
    stored = cut_lineage(frame.groupBy("k").count())
    for _ in range(50):
        more = [f for f in left() - before if "shuffle_" in f]
        if not more:
            break
        time.sleep(0.1)
    assert not more and stored.count() == 7
    assert frame.groupBy("k").count().count() == 7  # plans of before are worked out anew
